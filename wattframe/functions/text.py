"""Dispatch claims in free text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wattframe.functions.scalar import col

# "discharge 15 MW", "curtail 5.5 mwh": verb, amount, unit, in any case.
CLAIM = r"(?i)\b(discharge|charge|dispatch|curtail|curtailment|shift)\s+(\d+(?:\.\d+)?)\s*(mw|mwh)\b"


def claim_texts(text: str | Column) -> Column:
    return F.regexp_extract_all(col(text), F.lit(CLAIM), F.lit(0))


def claim_amounts(text: str | Column) -> Column:
    return F.transform(F.regexp_extract_all(col(text), F.lit(CLAIM), F.lit(2)), lambda x: x.cast("double"))
