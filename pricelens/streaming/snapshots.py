"""An extension: listings as they arrive, each seller's article once, latest by event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def listing_stream(spark: SparkSession, folder: str, schema: StructType, files_a_batch: int = 100) -> DataFrame:
    """New Parquet files of a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(folder)


def first_captures(stream: DataFrame, keys: list[str], event_time: str, late: str = "1 day") -> DataFrame:
    """The first capture of each article within the watermark; state older than it is dropped."""
    return stream.withWatermark(event_time, late).dropDuplicatesWithinWatermark(keys)


def offers_a_window(stream: DataFrame, event_time: str, window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Offers and least price by seller and window."""
    grouped = stream.withWatermark(event_time, late).groupBy(F.window(event_time, window), "supermarket")
    return grouped.agg(F.count("*").alias("n"), F.min("price_num").alias("precio_minimo")).select("window.start", "window.end", "supermarket", "n", "precio_minimo")
