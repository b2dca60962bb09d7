"""Imports every query module; the registry is complete afterwards."""

from __future__ import annotations

import importlib
import pkgutil

import wattframe.plans as plans
from wattframe.plans.registry import QUERIES, Query


def load_queries() -> dict[str, Query]:
    for module in pkgutil.iter_modules(plans.__path__):
        if module.name.endswith("_queries"):
            importlib.import_module(f"wattframe.plans.{module.name}")
    return dict(QUERIES)
