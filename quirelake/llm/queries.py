"""The queries of this subpackage and, where SQL can state them, their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: Query: its module here.
MODULES = {
    "op1_simhash": "simhash",
    "op2_quality_rules": "quality",
    "op3_top_k": "topk",
    "op4_lm_score": "lm_score",
    "op5_mixing": "mixing",
    "op6_bpe": "bpe",
    "op7_langid": "langid",
    "op8_chat_format": "chat",
    "op9_warc": "warc",
    "op10_licenses": "licenses",
    "op11_collocations": "phrases",
    "op12_align": "align",
    "op13_line_dedup": "lines",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: getattr(import_module(f"{__package__}.{module}"), name) for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(import_module(f"{__package__}.{module}"), "SQL", None) for name, module in MODULES.items()}
    return {name: sql for name, sql in found.items() if sql}
