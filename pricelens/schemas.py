"""Declared schemas: every raw column is read as text, the standard relation has 26 columns."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_INT, _TS = {"page_num"}, {"timestamp_archivo", "mtime_archivo"}
# The columns of the standard relation in order.
PRODUCT_COLUMNS = (
    "sku name brand price list_price discount_price in_offer net_content unit price_per_unit price_per_unit_list saving_text image_url detail_url "
    "category subcategory last_category category_url page_num extracted_at supermarket archivo ruta_archivo timestamp_archivo mtime_archivo category_std"
).split()
PRODUCT = T.StructType([T.StructField(c, T.IntegerType() if c in _INT else T.TimestampType() if c in _TS else T.StringType()) for c in PRODUCT_COLUMNS])
# The columns of raw listings.
RAW_LISTING = "sku name brand price list_price in_offer detail_url image_url subcat_name subcat_url source_json_url page_num extracted_at".split()
# What each seller's columns are called in the standard relation.
RENAMES = {
    "jumbo": {"categoria": "category", "subcat_name": "last_category"},
    "unimarc": {"categoria": "category", "group_name": "subcategory", "category_name": "last_category"},
    "lider": {"categoria": "category", "subcat_name": "subcategory"},
}


def to_schema(df: DataFrame, schema: T.StructType, renames: Mapping[str, str] | None = None) -> DataFrame:
    """The declared columns in order and type; absent ones are null, others are dropped."""
    df = df.withColumnsRenamed({a: b for a, b in (renames or {}).items() if a in df.columns and b not in df.columns})
    return df.select(*[(F.col(f"`{f.name}`") if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def ensure_columns(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """The table with the missing columns (name -> type) added as null."""
    return df.withColumns({c: F.lit(None).cast(t) for c, t in columns.items() if c not in df.columns})
