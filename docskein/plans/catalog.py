"""The query catalogue: one query per operator, each with its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docskein.plans.catalog_base import BASE, RULES, VIEW_PATTERNS
from docskein.plans.catalog_graph import CHAINS

__all__ = ["CATALOG", "RULES", "VIEW_PATTERNS"]

CATALOG: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {**BASE, **CHAINS}
