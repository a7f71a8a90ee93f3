"""Snapshots and duplicates: latest files and rows, last, first and best of several."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FILE_TIME = r"(20\d{6}_\d{6})"


def file_timestamp(name: Column) -> Column:
    """The time that a file name carries as yyyyMMdd_HHmmss; null if none."""
    return F.try_to_timestamp(F.nullif(F.regexp_extract(name, FILE_TIME, 1), F.lit("")), F.lit("yyyyMMdd_HHmmss"))


def file_prefix(name: Column) -> Column:
    """The part of a file name before its time."""
    return F.regexp_replace(name, r"_?20\d{6}_\d{6}.*$", "")


def latest_files(files: DataFrame, folder: str, path: str, modified: str | None = None) -> DataFrame:
    """The newest file of each folder: by time of modification if given (ties by name), else the last name."""
    newest = F.max_by(path, F.struct(modified, path)) if modified else F.max(path)
    return files.where(F.col(path).isNotNull()).groupBy(folder).agg(newest.alias(path))


def latest_snapshot(rows: DataFrame, folder: Sequence[str], file: str) -> DataFrame:
    """The rows of each folder's last file: the short list of last files is joined, the rows aren't sorted."""
    last = rows.where(F.col(file).isNotNull()).groupBy(*folder).agg(F.max(file).alias(file))
    return rows.join(last, [*folder, file], "left_semi")


def keep_last(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Of rows with equal keys (null equals null) the last in the order."""
    return _keep(rows, keys, F.max_by, F.struct(*order))


def keep_first(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Of rows with equal keys (null equals null) the first in the order."""
    return _keep(rows, keys, F.min_by, F.struct(*order))


def keep_best(rows: DataFrame, keys: Sequence[str], quality: Column, order: Sequence[str]) -> DataFrame:
    """Of rows with equal keys the one of best quality, the first in the order among equals."""
    return _keep(rows, keys, F.min_by, F.struct((-quality).alias("q"), *order))


def _keep(rows: DataFrame, keys: Sequence[str], pick, key: Column) -> DataFrame:
    best = rows.groupBy(*keys).agg(pick(F.struct(*rows.columns), key).alias("best"))
    return best.select(*[F.col("best")[c].alias(c) for c in rows.columns])


def split_lines(text: Column) -> Column:
    """The distinct lines or comma-separated parts of a text, in order."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), r"[\n,;]+"), F.trim)
    return F.array_distinct(F.filter(parts, lambda p: p != ""))


def union_all(*tables: DataFrame) -> DataFrame:
    """All rows; columns that a table lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def run_summary(runs: DataFrame) -> DataFrame:
    """Runs, seconds and longest run by status."""
    return runs.groupBy("status").agg(F.count("*").alias("corridas"), F.round(F.sum("duration_sec"), 2).alias("segundos"), F.max("duration_sec").alias("mas_larga"))
