"""Registry of queries: a Spark plan, and the SQL it must agree with."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattframe.plans.sql_views import with_views
from wattframe.session import use_utc

Plan = Callable[["Tables"], DataFrame]


class Tables:
    """The tables of one data folder, read lazily."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = use_utc(spark)
        self.folder = folder

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


@dataclass(frozen=True)
class Query:
    plan: Plan
    sql: str | None
    rounded: tuple[str, ...]

    def run(self, spark: SparkSession, folder: str) -> DataFrame:
        return _at_the_edge(self.plan(Tables(spark, folder)), self.rounded)

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        body = with_views(self.sql)
        if not self.rounded:
            return body
        rounded = ", ".join(f"round({c}, {places}) + 0.0 AS {c}" for c, places in _places(self.rounded).items())
        return f"SELECT * REPLACE ({rounded}) FROM ({body})"


QUERIES: dict[str, Query] = {}


def _places(rounded: Sequence[str]) -> dict[str, int]:
    """`name` compares at 6 decimal places, `name:3` at 3 (large magnitudes)."""
    return {name: int(places or 6) for name, _, places in (r.partition(":") for r in rounded)}


def query(name: str, sql: str | None = None, rounded: Sequence[str] = ()) -> Callable[[Plan], Plan]:
    """Register a plan. `rounded` lists the double columns, see `_places`."""

    def register(plan: Plan) -> Plan:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = Query(plan, sql, tuple(rounded))
        return plan

    return register


def _at_the_edge(df: DataFrame, rounded: Sequence[str]) -> DataFrame:
    """Zone-free stamps, 64-bit counts and rounded doubles, as the SQL gives them."""
    out, places = [], _places(rounded)
    for field in df.schema:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.TimestampType):
            column = column.cast("timestamp_ntz")
        elif isinstance(field.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            column = column.cast("long")
        elif field.name in places:
            column = F.round(column, places[field.name]) + F.lit(0.0)
        out.append(column.alias(field.name))
    return df.select(*out)
