"""Baskets: cost, coverage and ranking of markets over the items of a list."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricelens.functions.numbers import percent, percent_text
from pricelens.operators.ranking import coherent_rows


def best_offers(offers: DataFrame, item: str, market: str, cost: str, tie: str) -> DataFrame:
    """The cheapest offer of each item in each market."""
    return coherent_rows(offers.where(F.col(cost).isNotNull()), [market, item], [(cost, False), (tie, False)])


def market_summary(best: DataFrame, item: str, market: str, cost: str, items: int) -> DataFrame:
    """Items covered and total cost of each market, and its coverage of a list of so many items."""
    sums = best.groupBy(market).agg(F.count_distinct(item).alias("items_cubiertos"), F.sum(cost).alias("costo_total"))
    share = percent(F.col("items_cubiertos"), F.lit(items))
    return sums.withColumn("items_totales", F.lit(items)).withColumn("cobertura_pct", share).withColumn("cobertura_pct_fmt", percent_text(share))


def optimal_basket(best: DataFrame, item: str, market: str, cost: str) -> DataFrame:
    """The cheapest market of each item."""
    return coherent_rows(best, [item], [(cost, False), (market, False)])


def coverage(items: DataFrame, offers: DataFrame, item: str, market: str, found: str) -> DataFrame:
    """Offers, markets and state of every item of the list, found or not."""
    counts = offers.where(F.col(item).isNotNull()).groupBy(item).agg(
        F.count(found).alias("candidatos_detectados"), F.count_distinct(market).alias("supermercados_detectados"), F.max(F.when(F.col(found).isNotNull(), 1).otherwise(0)).alias("tiene_match")
    )
    all_items = items.select(item).join(counts, item, "left").fillna(0, ["candidatos_detectados", "supermercados_detectados", "tiene_match"])
    return all_items.withColumn("estado", F.when(F.col("tiene_match") == 1, "cubierto").otherwise("faltante"))


def covered_items(best: DataFrame, item: str, market: str) -> DataFrame:
    """The items of each market, sorted, and their number."""
    return best.groupBy(market).agg(F.sort_array(F.collect_set(item)).alias("xs")).select(market, F.array_join("xs", "; ").alias("items"), F.size("xs").alias("n_items"))


def overcost(summary: DataFrame, optimal_total: float | None, cost: str = "costo_total") -> DataFrame:
    """What each market's basket costs over the optimal mix."""
    best = F.lit(optimal_total).cast("double")
    return summary.withColumns({"costo_optimo": best, "sobrecosto": F.col(cost) - best, "sobrecosto_pct": percent(F.col(cost) - best, best)})


def key_values(summary: DataFrame, columns: list[str]) -> DataFrame:
    """A one-row summary as (indicador, valor), every value as text."""
    pairs = ", ".join(f"'{c}', cast(`{c}` as string)" for c in columns)
    return summary.selectExpr(f"stack({len(columns)}, {pairs}) as (indicador, valor)")


def winner(counts: DataFrame, column: str) -> DataFrame:
    """The most frequent value, the first in order among equals."""
    known = counts.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    return known.orderBy(F.desc("n"), column).limit(1)


def complete_totals(options: DataFrame, item: str, market: str, price: str, items: int) -> DataFrame:
    """Sum and items found of each market, and which of the complete ones is cheapest."""
    sums = options.where(F.col(price).isNotNull()).groupBy(market).agg(F.sum(price).alias("total"), F.count_distinct(item).alias("encontrados"))
    least = sums.where(F.col("encontrados") == items).agg(F.min("total")).first()[0]
    return sums.withColumn("completo", F.col("encontrados") == items).withColumn("mas_barato", F.coalesce(F.col("completo") & (F.col("total") == F.lit(least).cast("double")), F.lit(False)))


def cart_summary(best: DataFrame, item: str, market: str, price: str, score: str, tie: str, markets: Sequence[str], name: str = "name", brand: str = "brand", url: str = "detail_url") -> DataFrame:
    """The cart's lines in 17 columns: the cheapest and the dearest market of each item, what lies between, every market's price.

    ``best`` has an item's best offer of each market. Higher scores win among equal prices, then ``tie``. One aggregate,
    no join; items and markets that are null count as none; a market that isn't listed can win but has no column.
    """
    known = best.where(F.col(item).isNotNull() & F.col(market).isNotNull() & F.col(price).isNotNull())
    row = F.struct(F.col(market).alias("m"), F.col(name).alias("n"), F.col(brand).alias("b"), F.col(url).alias("u"), F.col(price).alias("p"))
    second = (F.coalesce(-F.col(score), F.lit(float("inf"))).alias("s"), F.col(tie).alias("t"))
    low, high = F.min_by(row, F.struct(F.col(price).alias("p"), *second)), F.min_by(row, F.struct((-F.col(price)).alias("p"), *second))
    lines = known.groupBy(item).agg(
        low.alias("l"), high.alias("h"), F.count_distinct(market).alias("supermercados_encontrados"), *[F.min(F.when(F.col(market) == m, F.col(price))).alias(f"precio_{m}") for m in markets]
    )
    saved = F.col("h.p") - F.col("l.p")
    return lines.select(
        F.col(item).alias("producto_buscado"), "supermercados_encontrados", F.col("l.m").alias("supermercado_mas_conveniente"), F.col("l.n").alias("producto_mas_conveniente"), F.col("l.b").alias("marca_mas_conveniente"), F.col("l.p").alias("precio_mas_bajo"),
        F.col("h.m").alias("supermercado_mas_caro"), F.col("h.n").alias("producto_mas_caro"), F.col("h.b").alias("marca_mas_caro"), F.col("h.p").alias("precio_mas_alto"), saved.alias("ahorro_abs"), percent(saved, F.col("h.p")).alias("ahorro_pct_vs_mas_caro"),
        *[f"precio_{m}" for m in markets], F.col("l.u").alias("url_mas_conveniente"), F.col("h.u").alias("url_mas_caro"),
    )
