"""Best rows of groups: coherent rows, first known values, ranks, pivots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pricelens.session import Stage


def _after_nulls(value: Column, descending: bool, kind: str) -> list[Column]:
    """Sort keys for min_by over a struct: nulls last, numbers turned round where the order is descending."""
    return [value.isNull(), -value if descending else value] if kind != "string" or not descending else [value.isNull(), value]


def sort_struct(df: DataFrame, order: Sequence[tuple[str, bool]]) -> Column:
    """A struct whose smallest value belongs to the first row; ``order`` holds (column, descending) pairs.

    Text columns can only be ascending.
    """
    kinds = dict(df.dtypes)
    keys: list[Column] = []
    for i, (name, descending) in enumerate(order):
        if descending and kinds[name] == "string":
            raise ValueError(f"{name}: a text can't be turned round")
        keys += [k.alias(f"k{i}_{j}") for j, k in enumerate(_after_nulls(F.col(name), descending, kinds[name]))]
    return F.struct(*keys)


def coherent_rows(df: DataFrame, groups: Sequence[str], order: Sequence[tuple[str, bool]]) -> DataFrame:
    """One whole row a group, the first in the order; groups with a null key are left out."""
    known = df.where(" and ".join(f"`{g}` is not null" for g in groups))
    rest = [c for c in df.columns if c not in groups]
    best = known.groupBy(*groups).agg(F.min_by(F.struct(*rest), sort_struct(df, order)).alias("best"))
    return best.select(*groups, *[F.col("best")[c].alias(c) for c in rest])


def first_known_values(df: DataFrame, groups: Sequence[str], order: Sequence[tuple[str, bool]], columns: Sequence[str]) -> DataFrame:
    """Each column's own first non-null value in the order, so that values of several rows may mix."""
    known = df.where(" and ".join(f"`{g}` is not null" for g in groups))
    key = sort_struct(df, order)
    return known.groupBy(*groups).agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), key)).alias(c) for c in columns])


def top_per_group(df: DataFrame, groups: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first n rows of each group in the order."""
    return df.withColumn("puesto", F.row_number().over(Window.partitionBy(*groups).orderBy(*order))).where(F.col("puesto") <= n)


def ranked_by_cost(df: DataFrame, cost: str, tie: str, rank: str = "ranking") -> DataFrame:
    """A short summary with ranks from 1, and the difference to the cheapest in money and percent."""
    everything = Window.partitionBy()
    least = F.min(cost).over(everything)
    return df.withColumns({"ahorro_vs_mas_barato": F.col(cost) - least, "ahorro_pct_vs_mas_barato": F.when(least > 0, F.bround((F.col(cost) - least) / least * 100, 2))}).withColumn(
        rank, F.row_number().over(Window.orderBy(F.col(cost).asc_nulls_last(), tie))
    )


def prices_by_market(df: DataFrame, item: str, market: str, price: str, markets: Sequence[str], prefix: str = "precio_") -> DataFrame:
    """One row an item with the first price of every given market; a market without one has null."""
    wide = df.where(F.col(item).isNotNull()).groupBy(item).pivot(market, list(markets)).agg(F.min(price))
    return wide.select(item, *[F.col(f"`{m}`").alias(prefix + m) for m in markets])


def dense_labels(df: DataFrame, label: str, out: str = "group_id") -> DataFrame:
    """Labels renumbered 1, 2, ... in their order.

    The distinct labels are dealt by range and numbered within their parts; only the parts' sizes meet on the driver.
    """
    stage = Stage(df.sparkSession, "labels")
    dealt = df.select(label).distinct().repartitionByRange(label).sortWithinPartitions(label)
    placed = dealt.select(label, F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("row"))
    numbered = stage.cut(placed.select(label, "part", F.col("row").bitwiseAND((1 << 33) - 1).alias("row")))
    before, offsets = 0, []
    for r in numbered.groupBy("part").count().orderBy("part").collect():
        offsets.append((r["part"], before))
        before += r["count"]
    starts = df.sparkSession.createDataFrame(offsets or [(0, 0)], "part int, start bigint")
    ids = numbered.join(F.broadcast(starts), "part").select(label, (F.col("start") + F.col("row") + 1).alias(out))
    return df.join(ids, label)
