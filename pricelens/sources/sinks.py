"""Tables into files: versioned delimited text, fixed-name overwrite, JSON snapshots, a catalogue of what is there."""

from __future__ import annotations

import json
from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_versioned(df: DataFrame, folder: str, base: str, at: datetime | None = None, separator: str = ";") -> str:
    """A new folder named by base and time; earlier ones stay."""
    path = f"{folder.rstrip('/')}/{base}_{(at or datetime.now()).strftime('%Y%m%d_%H%M%S')}"
    df.write.mode("errorifexists").csv(path, header=True, sep=separator)
    return path


def write_fixed(df: DataFrame, path: str, separator: str = ";") -> str:
    """The same name each time; what was there is replaced."""
    df.write.mode("overwrite").csv(path, header=True, sep=separator)
    return path


def json_lines(df: DataFrame) -> DataFrame:
    """One JSON text a row; nulls are left out, NaN counts as null."""
    doubles = [c for c, t in df.dtypes if t in ("double", "float")]
    clean = df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in doubles})
    return clean.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in clean.columns])).alias("json"))


def write_snapshot(df: DataFrame, path: str, most: int) -> int:
    """A small table as one JSON file on the driver, at most so many records (a preview's limit)."""
    records = [json.loads(r["json"]) for r in json_lines(df.limit(most)).collect()]
    with open(path, "w", encoding="utf-8") as f:
        json.dump(records, f, ensure_ascii=False)
    return len(records)


def catalogue(spark: SparkSession, tables: dict[str, str]) -> DataFrame:
    """(clave, existe, ruta, filas) of named Parquet tables."""
    rows = []
    for key, path in tables.items():
        try:
            rows.append((key, True, path, spark.read.parquet(path).count()))
        except AnalysisException as e:  # no such path, or no table in it; any other error is one
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            rows.append((key, False, path, None))
    return spark.createDataFrame(rows, "clave string, existe boolean, ruta string, filas bigint")


class TableCache:
    """Tables kept by path and time of modification, the least recently used dropped beyond ``most``."""

    def __init__(self, spark: SparkSession, most: int = 32):
        self.spark, self.most, self.kept = spark, most, {}

    def get(self, path: str) -> DataFrame:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        status = p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p)
        key = (path, status.getModificationTime(), status.getLen())
        if key in self.kept:
            self.kept[key] = self.kept.pop(key)
            return self.kept[key]
        for old in [k for k in self.kept if k[0] == path]:
            self.kept.pop(old).unpersist()
        while len(self.kept) >= self.most:
            self.kept.pop(next(iter(self.kept))).unpersist()
        self.kept[key] = self.spark.read.parquet(path).cache()
        return self.kept[key]
