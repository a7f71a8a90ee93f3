"""Documents of several sources mixed to target shares of all tokens.

Temperature mixing: source shares are raised to an exponent, which is bisected.

* Towards target shares a source weighs its natural share times (target / natural share) ^ exponent. The exponent is
  bisected until the mixture's mean log ratio of target to natural share, its cross entropy against the corpus less that
  against the targets, is that of the targets; where a wanted total doesn't allow this within the repetition limits, it
  is bisected on down to the largest that does. Without a wanted total the largest total is taken that the limits allow.
* Towards a target entropy, without target shares, a source weighs its natural share ^ exponent: 1 is the corpus, 0 all
  sources alike. The exponent is bisected until the entropy is the wanted one.

Each source's weight then becomes a budget of tokens: whole passes over the source and one partial pass, made of blocks
of documents in a hashed order; only the block that the budget ends in is gone through document by document.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pricelens.llm.tokens import TOKENIZER_FILE, encode
from pricelens.session import Stage, spread

#: Documents a block, about; the number of blocks follows the size of the source up to MOST_BLOCKS, then the blocks grow.
BLOCK_DOCUMENTS, MOST_BLOCKS = 2_000, 65_536
BISECTIONS = 60
#: Exponents lie between 0 and this.
MOST_EXPONENT = 16.0
#: The list of sources and their targets is short; a longer one is an error.
MOST_SOURCES = 10_000


class Share(NamedTuple):
    source: str
    tokens: int
    target: float
    max_repeats: int
    weight: float
    budget: int


def weights_at(exponent: float, natural: dict[str, float], target: dict[str, float]) -> dict[str, float]:
    """Normalised weights: natural share x (target / natural share) ^ exponent; 0 where either share is 0."""
    raw = {s: natural[s] * (target[s] / natural[s]) ** exponent if natural.get(s) and target[s] > 0 else 0.0 for s in target}
    whole = sum(raw.values())
    return {s: (w / whole if whole else 0.0) for s, w in raw.items()}


def heated(exponent: float, natural: dict[str, float]) -> dict[str, float]:
    """Normalised weights: natural share ^ exponent."""
    raw = {s: n**exponent for s, n in natural.items()}
    whole = sum(raw.values())
    return {s: w / whole for s, w in raw.items()}


def entropy(weights: dict[str, float]) -> float:
    """In nats."""
    return -sum(w * math.log(w) for w in weights.values() if w > 0)


def bisect(low: float, high: float, holds: Callable[[float], bool]) -> float:
    """The largest exponent between low and high, about, up to which ``holds`` does; low if it never does."""
    if holds(high):
        return high
    for _ in range(BISECTIONS):
        middle = (low + high) / 2
        low, high = (middle, high) if holds(middle) else (low, middle)
    return low


def plan_mixture(
    tokens: dict[str, int], target: dict[str, float], max_repeats: dict[str, int], total: int | None = None, target_entropy: float | None = None
) -> tuple[list[Share], float]:
    """Budgets of the sources and the exponent used. Sources without tokens get nothing and the others their part.

    With ``target_entropy`` the target shares say only which sources take part.
    """
    there = {s: t for s, t in target.items() if tokens.get(s, 0) > 0 and t > 0 and max_repeats.get(s, 0) > 0}
    whole = sum(tokens[s] for s in there)
    if not whole:
        return [], 0.0
    natural = {s: tokens[s] / whole for s in there}
    room = {s: max_repeats[s] * tokens[s] for s in there}
    listed = sum(there.values())
    wanted = {s: t / listed for s, t in there.items()}

    def weights(exponent: float) -> dict[str, float]:
        return heated(exponent, natural) if target_entropy is not None else weights_at(exponent, natural, wanted)

    def largest(exponent: float) -> float:
        return min(room[s] / w for s, w in weights(exponent).items() if w > 0)

    if target_entropy is not None:  # the higher the exponent the lower the entropy
        exponent = bisect(0.0, MOST_EXPONENT, lambda x: entropy(weights(x)) >= target_entropy)
    else:  # the mean log ratio grows with the exponent
        ratio = {s: math.log(wanted[s] / natural[s]) for s in there}
        goal = sum(wanted[s] * ratio[s] for s in there)
        alike = max(abs(r) for r in ratio.values()) < 1e-12  # the corpus has the target shares: any exponent meets them
        exponent = 1.0 if alike else bisect(0.0, MOST_EXPONENT, lambda x: sum(w * ratio[s] for s, w in weights(x).items()) <= goal)
    if total is None:
        total = math.floor(largest(exponent) * (1 + 1e-12))
    elif largest(exponent) < total:  # go back towards the corpus as it is
        corpus = 1.0 if target_entropy is not None else 0.0
        if largest(corpus) < total:  # not even the natural shares allow it
            total, exponent = math.floor(largest(corpus)), corpus
        else:
            way = bisect(0.0, 1.0, lambda x: largest(corpus + x * (exponent - corpus)) >= total)
            exponent = corpus + way * (exponent - corpus)
    w = weights(exponent)
    return [Share(s, tokens[s], target[s], max_repeats[s], w[s], min(room[s], math.floor(w[s] * total))) for s in sorted(there)], exponent


def target_entropy_of(targets: DataFrame) -> float:
    """The entropy of a short list's target shares."""
    shares = [float(r[0]) for r in _short(targets.select("target_share").dropna().where("target_share > 0"))]
    return entropy({str(i): x / sum(shares) for i, x in enumerate(shares)}) if shares else 0.0


def _short(targets: DataFrame) -> list:
    rows = targets.limit(MOST_SOURCES + 1).collect()
    if len(rows) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources are listed")
    return rows


def mix_sources(
    df: DataFrame,
    targets: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    total: int | None = None,
    target_entropy: float | None = None,
    seed: int = 0,
    tokenizer: str = TOKENIZER_FILE,
) -> DataFrame:
    """(key, source, n_tokens, repeticiones, share_objetivo, share_logrado) of every document that is drawn.

    ``targets`` is a short list (source, target_share, max_repeats); see the module on ``total`` and ``target_entropy``.
    ``repeticiones`` is how often the document occurs,
    never more than its source's max_repeats; ``share_logrado`` is its source's share of all drawn tokens. Documents
    with null or empty text, and of null or unlisted sources, aren't drawn; repeated texts are documents of their own;
    an empty table gives no rows. Ties of the hashed order are settled by the key; extra columns are ignored.
    """
    spark = df.sparkSession
    stage = Stage(spark, "mixing")
    key_type = df.schema[key].dataType.simpleString()
    wanted = {r[0]: (float(r[1]), int(r[2])) for r in _short(targets.select("source", "target_share", "max_repeats").dropna())}
    listed = spark.createDataFrame([(s,) for s in sorted(wanted)] or [(None,)], "source string")

    def sized(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"k": b["k"], "source": b["source"], "size": [len(encode(t, tokenizer)) for t in b["t"]]})

    texts = df.where(F.length(text) > 0).select(F.col(key).alias("k"), F.col(source).alias("source"), F.col(text).alias("t")).join(F.broadcast(listed), "source", "left_semi")
    documents = stage.cut(spread(texts.select("k", "source", "t")).mapInPandas(sized, f"k {key_type}, source string, size bigint").where("size > 0"))
    held = {r["source"]: (r["tokens"], r["n"]) for r in documents.groupBy("source").agg(F.sum("size").alias("tokens"), F.count("*").alias("n")).collect()}
    shares, _ = plan_mixture({s: t for s, (t, _) in held.items()}, {s: t for s, (t, _) in wanted.items()}, {s: m for s, (_, m) in wanted.items()}, total, target_entropy)
    plan = [(x.source, x.target, x.budget // x.tokens, x.budget % x.tokens, min(MOST_BLOCKS, math.ceil(held[x.source][1] / BLOCK_DOCUMENTS))) for x in shares]
    budgets = F.broadcast(spark.createDataFrame(plan or [(None, 0.0, 0, 0, 1)], "source string, share_objetivo double, passes bigint, over bigint, blocks bigint"))
    order = F.xxhash64("k", F.lit(seed))
    dealt = documents.join(budgets, "source").withColumn("order", order).withColumn("block", F.pmod(F.shiftrightunsigned("order", 17), F.col("blocks")))
    # whole blocks, in their order, as far as the budget of the partial pass goes
    sums = dealt.groupBy("source", "block", "over").agg(F.sum("size").alias("tokens"))
    upto = F.sum("tokens").over(Window.partitionBy("source").orderBy("block"))
    before = sums.withColumn("upto", upto).select("source", "block", (F.col("over") - (F.col("upto") - F.col("tokens"))).alias("room"), F.col("tokens").alias("block_tokens"))
    placed = dealt.join(before, ["source", "block"])
    inside = placed.where("room > 0 and room < block_tokens")
    so_far = F.sum("size").over(Window.partitionBy("source", "block").orderBy("order", "k"))
    last_block = inside.withColumn("more", (so_far <= F.col("room")).cast("int"))
    others = placed.where("not (room > 0 and room < block_tokens)").withColumn("more", (F.col("room") >= F.col("block_tokens")).cast("int"))
    drawn = others.unionByName(last_block).withColumn("repeticiones", (F.col("passes") + F.col("more")).cast("int")).where("repeticiones > 0")
    drawn = stage.cut(drawn.select("k", "source", "size", "repeticiones", "share_objetivo"))
    reached = drawn.groupBy("source").agg(F.sum(F.col("size") * F.col("repeticiones")).alias("got"))
    ratio = reached.select("source", F.round(F.col("got") / F.sum("got").over(Window.partitionBy()), 6).alias("share_logrado"))
    return drawn.join(F.broadcast(ratio), "source").select(F.col("k").alias(key), "source", F.col("size").alias("n_tokens"), "repeticiones", "share_objetivo", "share_logrado")


def share_report(drawn: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, documentos, n_tokens, share_objetivo, share_logrado, max_usado) of every listed source."""
    got = drawn.groupBy("source").agg(
        F.count("*").alias("documentos"), F.sum(F.col("n_tokens") * F.col("repeticiones")).alias("n_tokens"), F.max("share_logrado").alias("share_logrado"), F.max("repeticiones").alias("max_usado")
    )
    return targets.select("source", F.col("target_share").alias("share_objetivo")).join(got, "source", "left").fillna(0)
