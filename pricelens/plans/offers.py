"""The offers relation: what the driver's star schema looks like as listings of markets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricelens.session import table

# The unit that a part type stands for.
TYPE_UNITS = {"ECONOMY": "kg", "STANDARD": "g", "PROMO": "ml", "LARGE": "l", "MEDIUM": "un", "SMALL": "cc"}
# Suppliers that are broadcast; beyond it a join.
MOST_SENT_SUPPLIERS = 2_000_000


def offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(idx, sku, supermarket, name, brand, category_std, amount, unit, price, list_price): each part once a region."""
    line = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    place = table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_regionkey").alias("r_regionkey"))
    place = F.broadcast(place) if place.count() <= MOST_SENT_SUPPLIERS else place
    market = table(spark, sf_dir, "region").select("r_regionkey", F.lower("r_name").alias("supermarket")).distinct()
    unit_price = F.col("l_extendedprice") / F.col("l_quantity")
    # prices are aggregated before any text is joined, so that only keys and sums are shuffled
    priced = (
        line.join(place, F.col("l_suppkey") == F.col("s_suppkey"))
        .groupBy("l_partkey", "r_regionkey")
        .agg(F.min(unit_price).alias("list_price"), F.min(unit_price * (1 - F.col("l_discount"))).alias("price"))
        .join(market, "r_regionkey")
    )
    unit = F
    for kind, name in TYPE_UNITS.items():
        unit = unit.when(F.col("p_type") == kind, F.lit(name))
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size", unit.alias("unit"))
    joined = priced.join(part, F.col("l_partkey") == F.col("p_partkey"))
    return joined.select(
        (F.col("p_partkey") * 10 + F.col("r_regionkey")).alias("idx"),
        F.col("p_partkey").cast("string").alias("sku"),
        "supermarket",
        F.concat_ws(" ", "p_name", "p_brand", F.col("p_size").cast("string"), "unit").alias("name"),
        F.col("p_brand").alias("brand"),
        F.col("p_type").alias("category_std"),
        F.col("p_size").cast("double").alias("amount"),
        "unit",
        "price",
        "list_price",
    )


OFFERS_SQL = """offers AS (
  SELECT p_partkey * 10 + r_regionkey AS idx, CAST(p_partkey AS VARCHAR) AS sku, lower(r_name) AS supermarket,
    p_name || ' ' || p_brand || ' ' || CAST(p_size AS VARCHAR) || ' ' || u AS name, p_brand AS brand, p_type AS category_std,
    CAST(p_size AS DOUBLE) AS amount, u AS unit, min(l_extendedprice / l_quantity * (1 - l_discount)) AS price, min(l_extendedprice / l_quantity) AS list_price
  FROM lineitem JOIN (SELECT *, CASE p_type WHEN 'ECONOMY' THEN 'kg' WHEN 'STANDARD' THEN 'g' WHEN 'PROMO' THEN 'ml' WHEN 'LARGE' THEN 'l' WHEN 'MEDIUM' THEN 'un' WHEN 'SMALL' THEN 'cc' END AS u FROM part) p
    ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  GROUP BY ALL)"""
