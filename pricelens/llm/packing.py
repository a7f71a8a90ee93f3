"""Containers of fixed capacity filled with documents by lexical retrieval.

The tokens' document frequencies are counted over all documents. Documents are dealt to shards of bounded size, likes
with likes; each shard holds a BM25 inverted index over the token ids of its documents. The longest document that is
still unused seeds a container; the index returns its unused neighbours, which fill the container in order of their
score as long as they fit; what room they leave goes to the unused documents that fit best. A document longer than the
capacity is cut into full containers and a rest, which is packed like any other document.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricelens.llm.tokens import TOKENIZER_FILE, encode
from pricelens.session import Stage, spread

#: Documents a shard: the index, its postings and the fill loop of one task are bounded by it.
SHARD_DOCUMENTS = 3_000
#: So many partitions at most; beyond that a partition holds several shards, one after another.
MOST_PARTS = 20_000
#: A seed asks with all its terms but those that more than this share of all documents has: they tell no likeness.
COMMON = 0.5
#: The list of containers is short; a longer one is an error.
MOST_KINDS = 1_000
K1, B = 1.2, 0.75


class Placed(NamedTuple):
    document: int
    container: int
    position: int
    first_token: int
    size: int


class Index:
    """BM25 postings of a shard: term -> documents and their score for it."""

    def __init__(self, terms: list[np.ndarray], counts: list[np.ndarray], sizes: np.ndarray, frequency: dict[int, int], documents: int):
        self.n = len(terms)
        mean = max(1.0, float(sizes.mean())) if self.n else 1.0
        owner = np.repeat(np.arange(self.n), [len(t) for t in terms])
        term = np.concatenate(terms) if self.n else np.empty(0, "int32")
        count = np.concatenate(counts).astype("float64") if self.n else np.empty(0)
        distinct, place = np.unique(term, return_inverse=True)
        idf = np.array([math.log(1 + (documents - (f := frequency.get(int(t), 1)) + 0.5) / (f + 0.5)) for t in distinct])
        weight = idf[place] * count * (K1 + 1) / (count + K1 * (1 - B + B * sizes[owner] / mean)) if self.n else np.empty(0)
        order = np.argsort(place, kind="stable")
        self.documents, self.weights = owner[order].astype("int32"), weight[order]
        self.starts = np.searchsorted(place[order], np.arange(len(distinct) + 1))
        rare = np.array([frequency.get(int(t), 1) <= COMMON * documents for t in distinct], dtype=bool)
        # what each document asks with
        self.asks: list[np.ndarray] = []
        ends = np.cumsum([len(t) for t in terms])
        for i in range(self.n):
            a, b = ends[i] - len(terms[i]), ends[i]
            own = place[a:b]
            self.asks.append(own[rare[own]])

    def scores(self, document: int) -> np.ndarray:
        """BM25 of every document of the shard for one of them."""
        parts = [slice(self.starts[t], self.starts[t + 1]) for t in self.asks[document]]
        if not parts:
            return np.zeros(self.n)
        return np.bincount(np.concatenate([self.documents[p] for p in parts]), np.concatenate([self.weights[p] for p in parts]), self.n)


def fill(index: Index, sizes: np.ndarray, capacity: int) -> list[Placed]:
    """Every document of the shard put into containers of that capacity."""
    out: list[Placed] = []
    container = 0
    rest = sizes.copy()
    for i in np.flatnonzero(sizes > capacity):
        for k in range(int(sizes[i]) // capacity):
            out.append(Placed(int(i), container, 1, k * capacity, capacity))
            container += 1
        rest[i] = sizes[i] % capacity
    first = sizes - rest
    unused = rest > 0
    # documents by size, to find the one that fits a room best
    by_size: dict[int, list[int]] = {}
    for i in np.argsort(-rest, kind="stable"):
        if rest[i] > 0:
            by_size.setdefault(int(rest[i]), []).append(int(i))
    there = np.zeros(capacity + 1, dtype=bool)
    there[list(by_size)] = True

    def take(i: int, position: int) -> None:
        unused[i] = False
        out.append(Placed(i, container, position, int(first[i]), int(rest[i])))

    def best_fit(room: int) -> int | None:
        """An unused document of the largest size that fits."""
        while True:
            fitting = np.flatnonzero(there[: room + 1])
            if not len(fitting):
                return None
            size = int(fitting[-1])
            stack = by_size[size]
            while stack and not unused[stack[-1]]:
                stack.pop()
            if stack:
                return stack.pop()
            there[size] = False

    for seed in np.argsort(-rest, kind="stable"):
        if not unused[seed]:
            continue
        take(int(seed), 1)
        room, position = capacity - int(rest[seed]), 2
        if room:
            scores = index.scores(int(seed))
            scores[~unused | (rest > room)] = 0.0
            likely = np.flatnonzero(scores > 0)
            likely = likely[np.lexsort((likely, -scores[likely]))]
            while len(likely):  # the best that fits, then the best of those behind it that still fit
                take(int(likely[0]), position)
                room, position = room - int(rest[likely[0]]), position + 1
                likely = likely[1:]
                likely = likely[rest[likely] <= room]
            while room and (i := best_fit(room)) is not None:
                take(i, position)
                room, position = room - int(rest[i]), position + 1
        container += 1
    return out


def pack_documents(
    df: DataFrame, containers: DataFrame, key: str = "doc_id", text: str = "text", alike: tuple[str, ...] = ("lang", "cba_name"), tokenizer: str = TOKENIZER_FILE
) -> DataFrame:
    """(contenedor, caja, posicion, key, primer_token, n_tokens) of every document, or piece of one, in each kind of container.

    ``containers`` is a short list of (contenedor, capacidad_tokens). Null and empty texts take no room and are in no
    container; blank ones are packed by their tokens; repeated texts are packed each; an empty table gives no rows;
    null values in ``alike`` count as a value; a capacity that is null or under one token is passed over.
    """
    spark = df.sparkSession
    stage = Stage(spark, "packing")
    kinds = [(r[0], int(r[1])) for r in containers.select("contenedor", "capacidad_tokens").where("capacidad_tokens >= 1").orderBy("capacidad_tokens", "contenedor").limit(MOST_KINDS + 1).collect()]
    if len(kinds) > MOST_KINDS:
        raise ValueError(f"more than {MOST_KINDS} kinds of containers are listed")
    key_type = df.schema[key].dataType.simpleString()

    def sized(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, group, t in zip(b["k"], b["group"], b["t"], strict=True):
                ids = encode(t, tokenizer)
                terms, counts = np.unique(ids, return_counts=True)
                rows.append((k, group, len(ids), terms.astype("int32"), counts.astype("int32")))
            yield pd.DataFrame(rows, columns=["k", "group", "size", "terms", "counts"])

    group = F.concat_ws("\t", *[F.coalesce(F.lower(F.col(c).cast("string")), F.lit("")) for c in alike]) if alike else F.lit("")
    source = df.where(F.length(text) > 0).select(F.col(key).alias("k"), group.alias("group"), F.col(text).alias("t"))
    documents = stage.cut(spread(source).mapInPandas(sized, f"k {key_type}, `group` string, size int, terms array<int>, counts array<int>"))
    n = documents.count()
    # the vocabulary bounds this table
    frequency = {r["t"]: r["count"] for r in documents.select(F.explode("terms").alias("t")).groupBy("t").count().collect()}
    shared = spark.sparkContext.broadcast((frequency, n, kinds))

    def shards(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The documents of a partition, which come likes by likes, SHARD_DOCUMENTS at a time (all of them: what is left
        at the end of a partition is a smaller shard)."""
        waiting: list[pd.DataFrame] = []
        for b in batches:
            while len(b):
                free = SHARD_DOCUMENTS - sum(map(len, waiting))
                waiting.append(b.iloc[:free])
                b = b.iloc[free:]
                if sum(map(len, waiting)) == SHARD_DOCUMENTS:
                    yield pd.concat(waiting, ignore_index=True)
                    waiting = []
        if waiting:
            yield pd.concat(waiting, ignore_index=True)

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frequency, n, kinds = shared.value
        number = TaskContext.get().partitionId()
        for shard_number, shard in enumerate(shards(batches)):
            shard = shard.sort_values(["size", "k"], ascending=[False, True], ignore_index=True)
            sizes = shard["size"].to_numpy(dtype="int64")
            index = Index([np.asarray(t, dtype="int32") for t in shard["terms"]], [np.asarray(c) for c in shard["counts"]], sizes, frequency, n)
            keys = shard["k"].to_numpy()
            for name, capacity in kinds:
                placed = fill(index, sizes, capacity)
                yield pd.DataFrame(
                    {
                        "contenedor": name,
                        "caja": [f"{number:06d}-{shard_number:06d}-{p.container:07d}" for p in placed],
                        "posicion": [p.position for p in placed],
                        key: keys[[p.document for p in placed]],
                        "primer_token": [p.first_token for p in placed],
                        "n_tokens": [p.size for p in placed],
                    }
                )

    parts = min(MOST_PARTS, max(1, math.ceil(n / SHARD_DOCUMENTS)))
    # large groups are dealt to blocks of about a shard by the hash of the key, the same in every run
    groups = documents.groupBy("group").agg(F.ceil(F.count("*") / SHARD_DOCUMENTS).alias("blocks"))
    dealt = documents.join(groups, "group").withColumn("block", F.pmod(F.xxhash64("k"), F.col("blocks"))).drop("blocks")
    dealt = dealt.repartition(parts, "group", "block").sortWithinPartitions("group", "block", F.xxhash64("k"))
    return dealt.mapInPandas(pack, f"contenedor string, caja string, posicion int, `{key}` {key_type}, primer_token int, n_tokens int")


def fill_report(packed: DataFrame, containers: DataFrame) -> DataFrame:
    """(contenedor, cajas, n_tokens, llenado): how full the containers of each kind are."""
    sums = packed.groupBy("contenedor").agg(F.count_distinct("caja").alias("cajas"), F.sum(F.col("n_tokens").cast("bigint")).alias("n_tokens"))
    return sums.join(F.broadcast(containers.select("contenedor", "capacidad_tokens")), "contenedor").select(
        "contenedor", "cajas", "n_tokens", F.round(F.col("n_tokens") / (F.col("cajas") * F.col("capacidad_tokens")), 4).alias("llenado")
    )
