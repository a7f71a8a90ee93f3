"""The N best rows of every group by simultaneous bisection of the groups' cutoffs.

Score, tie-breakers and identifier become order-preserving 64-bit codes, the better the larger; read one after another
they are one long code that no two rows share. In each round every undecided group's range of codes is cut at
MIDPOINTS points, the rows between the points are counted (map-side first, so that a hot group costs a few rows of
counts a partition, not a task), and the range shrinks to the part that holds the cutoff. Only rows in the shrunken
range go into the next round. A group is decided as soon as exactly as many rows lie above a point as it still needs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pricelens.session import Stage

MIDPOINTS = 15
#: Undecided groups up to this number go to the workers by broadcast, more by a join on the group.
MOST_BROADCAST_GROUPS = 50_000
_LEAST = -(2**63)


def order_code(values: pd.Series, descending: bool = True) -> np.ndarray:
    """Doubles as 64-bit integers in the same order; null and NaN come last of all."""
    numbers = values.to_numpy(dtype="float64", na_value=np.nan) + 0.0  # no negative zero
    bits = numbers.view("int64")
    codes = np.where(bits >= 0, bits, bits ^ np.int64(2**63 - 1))
    codes = codes if descending else ~codes
    return np.where(np.isnan(numbers), np.int64(_LEAST), codes)


def _joined(rows: DataFrame, state: DataFrame, n_groups: int, keys: list[str], how: str = "inner") -> DataFrame:
    return rows.join(F.broadcast(state) if n_groups <= MOST_BROADCAST_GROUPS else state, keys, how)


def _at_level(columns: list[str], shift: int = 0) -> Column:
    """The code column of the group's level; null beyond the last."""
    return F.coalesce(*[F.when(F.col("level") == i - shift, F.col(c)) for i, c in enumerate(columns)])


def top_n(
    df: DataFrame, groups: list[str], score: str, ties: list[tuple[str, bool]], identifier: str, n: int = 3, rank: str = "puesto"
) -> DataFrame:
    """(groups..., rank, identifier) of the n best rows of each group.

    ``ties`` are (column, descending) pairs, settled in turn; the identifier (an integer), ascending, comes last. Rows
    with a null group or a null or NaN score don't count; null and NaN in a tie column come last. Repeated rows that
    agree in everything are each other's equals: as many of them come out as fit. Groups with fewer rows give fewer;
    an empty table gives no rows. Extra columns are ignored. Every intermediate table lies in the shared folder.
    """
    spark = df.sparkSession
    stage = Stage(spark, "topn")
    keys = [f"g{i}" for i in range(len(groups))]
    codes = [f"c{i}" for i in range(len(ties) + 2)]

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = {k: batch[k] for k in keys}
            out["c0"] = order_code(batch["s"])
            for i, (_, descending) in enumerate(ties):
                out[f"c{i + 1}"] = order_code(batch[f"t{i}"], descending)
            out[codes[-1]] = ~batch["i"].to_numpy(dtype="int64")
            yield pd.DataFrame(out)

    counted = df.where(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")) & reduce(Column.__and__, [F.col(g).isNotNull() for g in groups])).select(
        *[F.col(g).cast("string").alias(k) for g, k in zip(groups, keys, strict=True)],
        F.col(score).cast("double").alias("s"),
        *[F.col(t).cast("double").alias(f"t{i}") for i, (t, _) in enumerate(ties)],
        F.col(identifier).cast("bigint").alias("i"),
    )
    schema = ", ".join([f"{k} string" for k in keys] + [f"{c} bigint" for c in codes])
    rows = stage.cut(counted.mapInPandas(encode, schema))

    first = rows.groupBy(*keys).agg(F.count("*").alias("size"), F.min("c0").alias("lo"), F.max("c0").alias("hi"))
    fixed = [F.lit(_LEAST).alias(f"k{i}") for i in range(len(codes))]
    state = stage.cut(first.where(F.col("size") > n).select(*keys, F.lit(n).cast("bigint").alias("need"), F.lit(0).alias("level"), "lo", "hi", *fixed))

    def in_range(some: DataFrame, ranges: DataFrame, n_groups: int) -> DataFrame:
        """The rows whose code lies in their group's range: tied with the cutoff in all levels before."""
        both = _joined(some, ranges, n_groups, keys).withColumn("code", _at_level(codes)).where("code between lo and hi")
        return both.where(reduce(Column.__and__, [(F.col("level") <= i) | (F.col(c) == F.col(f"k{i}")) for i, c in enumerate(codes)]))

    undecided, open_groups = rows, state.count()
    decided: list[DataFrame] = []
    while open_groups:
        # points lo < p1 < ... < hi, in decimals as hi - lo may be beyond 64 bits
        width = (F.col("hi").cast("decimal(20,0)") - F.col("lo").cast("decimal(20,0)")) / F.lit(MIDPOINTS + 1)
        points = F.array(*[(F.col("lo").cast("decimal(20,0)") + F.ceil(width * F.lit(j))).cast("bigint") for j in range(1, MIDPOINTS + 1)])
        parts = in_range(undecided, state.withColumn("points", points), open_groups)
        parts = parts.withColumn("part", F.size(F.filter("points", lambda p: F.col("code") >= p))).withColumn("next", _at_level(codes, 1))
        counts = parts.groupBy(*keys, "part").agg(
            F.count("*").alias("n"), F.min("code").alias("mn"), F.max("code").alias("mx"), F.min("next").alias("next_lo"), F.max("next").alias("next_hi")
        )
        above = Window.partitionBy(*keys).orderBy(F.desc("part"))
        placed = _joined(counts.withColumn("upto", F.sum("n").over(above)), state.drop("lo", "hi"), open_groups, keys)
        cutting = placed.where((F.col("upto") >= F.col("need")) & (F.col("upto") - F.col("n") < F.col("need")))
        tied = F.col("mn") == F.col("mx")
        done = (F.col("upto") == F.col("need")) | (tied & (F.col("level") == len(codes) - 1))
        pinned = [F.when((F.col("level") == i) & (done | tied), F.col("mn")).otherwise(F.col(f"k{i}")).alias(f"k{i}") for i in range(len(codes))]
        step = stage.cut(
            cutting.select(
                *keys,
                done.alias("done"),
                (F.col("need") - (F.col("upto") - F.col("n"))).alias("need"),
                (F.col("level") + F.when(tied, 1).otherwise(0)).alias("level"),
                F.when(tied, F.col("next_lo")).otherwise(F.col("mn")).alias("lo"),
                F.when(tied, F.col("next_hi")).otherwise(F.col("mx")).alias("hi"),
                *pinned,
            )
        )
        decided.append(step.where("done").select(*keys, *[f"k{i}" for i in range(len(codes))]))
        state = step.where("not done").drop("done")
        open_groups = state.count()
        if open_groups:
            before, undecided = undecided, stage.cut(in_range(undecided, state, open_groups).select(*keys, *codes))
            if before is not rows:
                stage.drop(before)
    kept = rows
    if decided:
        cutoffs = reduce(DataFrame.union, decided)
        kept = _joined(rows, cutoffs, cutoffs.count(), keys, "left")
        # the long code compared part by part
        reaches = F.lit(True)
        for i in reversed(range(len(codes))):
            reaches = (F.col(codes[i]) > F.col(f"k{i}")) | ((F.col(codes[i]) == F.col(f"k{i}")) & reaches)
        kept = kept.where(F.col("k0").isNull() | reaches)
    best_first = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in codes])
    ranked = kept.withColumn(rank, F.row_number().over(best_first)).where(F.col(rank) <= n)
    return ranked.select(
        *[F.col(k).cast(df.schema[g].dataType).alias(g) for g, k in zip(groups, keys, strict=True)],
        F.col(rank).cast("int").alias(rank),
        F.bitwise_not(F.col(codes[-1])).alias(identifier),
    )
