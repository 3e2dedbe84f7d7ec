"""Names of the corpus queries, and the SQL of those that SQL can express."""

from __future__ import annotations

import importlib

MODULES = ("ogg", "topk", "packing", "pieces", "jaccard", "secrets", "langid", "warc", "pii", "line_dedup", "alignment", "variants", "mixing")


def _modules():
    return [importlib.import_module(f"docskein.llm.{m}") for m in MODULES]


def queries():
    return {m.NAME: m.query for m in _modules()}


def oracle_sql():
    return {m.NAME: m.ORACLE_SQL for m in _modules() if getattr(m, "ORACLE_SQL", None)}
