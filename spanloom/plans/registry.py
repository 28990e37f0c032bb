"""The engine's own queries by name, with their SQL where SQL can express them."""

from __future__ import annotations

import importlib

from pyspark.sql import DataFrame, SparkSession

MODULES = ["operators.recognizers", "operators.mapping", "operators.cases", "operators.rewrite", "operators.structure", "operators.selection", "operators.evaluation", "operators.lists", "operators.search", "operators.language", "operators.history", "operators.rules", "operators.filters", "operators.syntax", "operators.fixes", "operators.tables", "operators.review", "operators.shapes", "operators.names", "operators.windows", "sources.imports", "sources.convert", "streaming.events"]


def _entries():
    for module in MODULES:
        yield from importlib.import_module(f"spanloom.{module}").QUERIES


def queries() -> dict:
    return {name: query for name, query, _ in _entries()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, _, sql in _entries() if sql}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["alias_numbering"](spark, sf_dir)
