"""The queries opN_<name>: each applies its operator, with production parameters, to a whole table."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from .common import table

#: Query, module of this subpackage and the tables it takes.
_QUERIES = {
    "op1_embeddings": ("embeddings", ["embeddings"]),
    "op2_minhash": ("minhash", ["documents"]),
    "op3_mixing": ("mixing", ["documents"]),
    "op4_warc": ("warc", ["pages"]),
    "op5_lm": ("lm", ["documents"]),
    "op6_best_fit_packing": ("packing", ["documents"]),
    "op10_substrings": ("substrings", ["documents"]),
    "op7_toxicity": ("toxicity", ["documents", "labels"]),
    "op8_fingerprints": ("fingerprints", ["documents"]),
    "op9_sharding": ("sharding", ["documents"]),
    "op11_sentencepiece": ("sentencepieces", ["documents"]),
    "op12_spelling": ("spelling", ["documents"]),
    "op13_periodic_runs": ("runs", ["documents"]),
}


def _query(module: str, tables: list[str]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return import_module(f"{__package__}.{module}").query(*[table(spark, sf_dir, t) for t in tables])

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _query(*what) for name, what in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of the queries that SQL can express on whole tables."""
    found = {name: getattr(import_module(f"{__package__}.{module}"), "SQL", None) for name, (module, _) in _QUERIES.items()}
    return {name: sql for name, sql in found.items() if sql}
