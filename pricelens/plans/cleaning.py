"""Queries that make clean tables out of logs, package contents and nested payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pricelens.operators.loglines import parse_logs
from pricelens.operators.nested import flatten_nested
from pricelens.operators.quantities import standardise_quantities
from pricelens.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every entry of every collector's log."""
    return parse_logs(table(spark, sf_dir, "runs_summary"), {"stdout": "stdout_log", "stderr": "stderr_log"})


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Package contents of the listings in g, ml or pieces."""
    return standardise_quantities(table(spark, sf_dir, "cba_premium_mejor_por_supermercado"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products, categories, items and promotions of the payloads with their parents."""
    return flatten_nested(table(spark, sf_dir, "bff_calefacci_n"))


QUERIES = {"p1_found": p1_found, "p6_found": p6_found, "p7_found": p7_found}
