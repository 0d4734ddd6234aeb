"""Registry of checked queries: every entry reads the driver tables (or data Spark
derives from them) in full, and most have a DuckDB SQL twin."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_MODULES = [
    "tabsight.plans.checks_profile",
    "tabsight.plans.checks_quality",
    "tabsight.plans.checks_metrics",
    "tabsight.plans.checks_features",
    "tabsight.plans.checks_catalog",
    "tabsight.plans.checks_models",
    "tabsight.plans.checks_runs",
    "tabsight.plans.checks_charts",
]


def _mods():
    return [importlib.import_module(m) for m in _MODULES]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict[str, Callable] = {}
    for m in _mods():
        out.update(m.QUERIES)
    return out


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _mods():
        out.update(m.oracle())
    return out


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tabsight.operators import stats
    from tabsight.session import read_table
    return stats.column_stats(read_table(spark, sf_dir, "orders"))
