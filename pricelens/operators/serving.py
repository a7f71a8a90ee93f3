"""Reads behind a search page: summaries, search, comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pricelens.functions.text import matches_search


def counts_by(df: DataFrame, column: str, top: int | None = None) -> DataFrame:
    """Rows by value, null as a value of its own; the commonest if ``top`` is given."""
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), F.col(column).asc_nulls_first()).limit(top) if top else counts


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """The distinct values that aren't null."""
    return df.where(F.col(column).isNotNull()).select(column).distinct()


def search(df: DataFrame, query: str, columns: list[str], market: str | None = None, limit: int | None = None, fold: bool = False, tie: str = "sku") -> DataFrame:
    """Rows in whose columns every token of the query occurs; prices of 0 and less count as unknown. With a limit, the cheapest."""
    hay = F.concat_ws(" ", *columns)
    hits = df.where(matches_search(hay, F.lit(query), fold))
    if market is not None:
        hits = hits.where(F.lower("supermarket") == market.lower())
    price = F.when(F.col("price") > 0, F.col("price"))
    hits = hits.withColumn("price", price)
    return hits.orderBy(F.col("price").asc_nulls_last(), F.col("name").asc_nulls_last(), tie).limit(limit) if limit else hits


def compare(df: DataFrame, query: str, columns: list[str], per_market: int, fold: bool = False, tie: str = "sku") -> DataFrame:
    """The cheapest hits of each market; a null market is one of its own."""
    hits = search(df, query, columns, fold=fold)
    cheapest = Window.partitionBy("supermarket").orderBy(F.col("price").asc_nulls_last(), F.col("name").asc_nulls_last(), tie)
    return hits.withColumn("puesto", F.row_number().over(cheapest)).where(F.col("puesto") <= per_market)


def comparable_only(options: DataFrame, item: str) -> DataFrame:
    """The comparable options of an item if it has any, else all."""
    some = F.max(F.col("comparable").cast("int")).over(Window.partitionBy(item))
    return options.withColumn("some", some).where((F.col("some") == 0) | F.col("comparable")).drop("some")
