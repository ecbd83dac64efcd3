"""The operators' registered queries and the SQL of those that SQL can say."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

MODULES = {
    "op1_jaccard_join": "jaccard",
    "op10_html_extraction": "html_text",
    "op11_importance_resampling": "importance",
    "op12_token_alignment": "token_align",
    "op13_url_filters": "url_filter",
    "op2_lm_scoring": "suffix_tree_lm",
    "op3_exact_dedup": "exact_dedup",
    "op4_decontamination": "decontaminate",
    "op5_sharding": "sharding",
    "op6_suffix_dedup": "suffix_dedup",
    "op7_warc": "warc",
    "op8_language_id": "langid",
    "op9_mixing": "mixing",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {q: getattr(importlib.import_module(f"ravelin.llm.{m}"), q) for q, m in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found = {q: getattr(importlib.import_module(f"ravelin.llm.{m}"), "SQL", None) for q, m in MODULES.items()}
    return {q: sql for q, sql in found.items() if sql}
