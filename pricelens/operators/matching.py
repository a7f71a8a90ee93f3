"""Product matching across markets: blocks, TF-IDF within the block, pairs, components, price comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pricelens.functions.scores import brand_score, match_score
from pricelens.functions.text import clean_text, name_signature
from pricelens.functions.units import similar_size, size_bucket
from pricelens.operators.ranking import dense_labels
from pricelens.session import Stage

BLOCK = ["category_std", "unit_family", "size_bucket", "signature", "split"]
WORDING = ["clean_name", "clean_brand", "size_std"]
CELL = ["block", "wording", "supermarket"]
TEXT_LEAST, FINAL_LEAST, MOST_IN_BLOCK, MAX_DF = 0.60, 0.75, 300, 0.95
# How work is dealt, without effect on results: split blocks that are broadcast (a join beyond), ids of a run, pairs of offers a part.
MOST_SENT_BLOCKS, RUN, PAIRS_IN_PART = 200_000, 1000, 4_000_000


def prepare(offers: DataFrame) -> DataFrame:
    """Offers (idx, supermarket, name, brand, category_std, unit_family, size_std, price) with their block.

    A block of more than MOST_IN_BLOCK rows is split by the first letters of the brand. The cleaned offers are cut, so
    that what they were made of is read once.
    """
    stage = Stage(offers.sparkSession, "prepare")
    p = stage.cut(
        offers.withColumns(
            {
                "clean_name": clean_text(F.col("name")),
                "clean_brand": clean_text(F.col("brand")),
                "signature": name_signature(F.col("name")),
                "size_bucket": size_bucket(F.col("size_std")),
            }
        )
    )
    first = ["category_std", "unit_family", "size_bucket", "signature"]
    sizes = stage.cut(p.groupBy(*first).agg(F.count("*").alias("block_rows")).where(F.col("block_rows") > MOST_IN_BLOCK))
    sizes = F.broadcast(sizes) if sizes.count() <= MOST_SENT_BLOCKS else sizes
    joined = p.alias("p").join(sizes.alias("s"), [F.col(f"p.{c}").eqNullSafe(F.col(f"s.{c}")) for c in first], "left")
    return joined.select("p.*", F.when(F.col("block_rows").isNotNull(), F.substring("p.clean_brand", 1, 4)).alias("split"))


def _hash(names: list[str]) -> Column:
    return F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in names])


def keyed(prepared: DataFrame) -> DataFrame:
    """Prepared offers with their block and wording: offers of a block that agree in all that matching looks at."""
    return prepared.withColumns({"block": _hash(BLOCK), "wording": _hash(WORDING)})


def cells(prepared: DataFrame) -> DataFrame:
    """(block, wording, clean_name, clean_brand, size_std, supermarket, offers, least): a wording's offers of one market and their least id."""
    return keyed(prepared).groupBy("block", "wording", *WORDING, "supermarket").agg(F.count("*").alias("offers"), F.min("idx").alias("least"))


def grams(cleaned: Column) -> Column:
    """Words of two and more letters, and pairs of neighbours."""
    w = F.regexp_extract_all(cleaned, F.lit(r"\b\w\w+\b"), 0)
    pairs = F.when(F.size(w) > 1, F.transform(F.slice(w, 1, F.size(w) - 1), lambda x, i: F.concat(x, F.lit(" "), F.element_at(w, i + 2)))).otherwise(F.array().cast("array<string>"))
    return F.concat(w, pairs)


def wording_similarity(cells: DataFrame, max_df: float = MAX_DF, near: bool = False) -> DataFrame:
    """(block, wording_1, wording_2, text_similarity): cosine of the TF-IDF vectors fitted within each block; wording_1 <= wording_2.

    Offers of one wording have one vector, so that work follows the wordings; rows and frequencies count all offers.
    With ``near``, only wordings of similar size.
    """
    open_blocks = cells.groupBy("block").agg(F.sum("offers").alias("n"), F.min("supermarket").alias("a"), F.max("supermarket").alias("b")).where("n > 1 and a <> b").select("block", "n")
    rows = cells.groupBy("block", "wording", *WORDING).agg(F.sum("offers").alias("offers")).join(open_blocks, "block")
    key = ["block", "wording", "size_std", "n", "offers"]
    tf = rows.select(*key, F.explode(grams(F.col("clean_name"))).alias("gram")).groupBy(*key, "gram").agg(F.count("*").alias("tf"))
    weighed = tf.withColumn("df", F.sum("offers").over(Window.partitionBy("block", "gram"))).where(F.col("df") <= F.lit(max_df) * F.col("n"))
    weighed = weighed.withColumn("w", F.col("tf") * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("block", "wording")))
    unit = Stage(cells.sparkSession, "vectors").cut(weighed.select("block", "gram", "wording", "size_std", (F.col("w") / norm).alias("w")))
    one, two = unit.toDF("block", "gram", "wording_1", "size_1", "w_1"), unit.toDF("block", "gram", "wording_2", "size_2", "w_2")
    pairs = one.join(two, ["block", "gram"]).where("wording_1 <= wording_2")
    pairs = pairs.where(similar_size(F.col("size_1"), F.col("size_2"))) if near else pairs
    return pairs.groupBy("block", "wording_1", "wording_2").agg(F.sum(F.col("w_1") * F.col("w_2")).alias("text_similarity"))


def wording_matches(cells: DataFrame, text_least: float = TEXT_LEAST, final_least: float = FINAL_LEAST) -> DataFrame:
    """Pairs of wordings, a wording with itself among them, whose names, sizes and brands agree; offers_1 and offers_2 count each one's offers."""
    similar = wording_similarity(cells, near=True).where(F.col("text_similarity") >= text_least)
    side = cells.groupBy("block", "wording", "clean_brand").agg(F.sum("offers"))
    both = similar.join(side.toDF("block", "wording_1", "brand_1", "offers_1"), ["block", "wording_1"]).join(side.toDF("block", "wording_2", "brand_2", "offers_2"), ["block", "wording_2"])
    scored = both.withColumn("brand_score", brand_score(F.col("brand_1"), F.col("brand_2")))
    scored = scored.withColumn("final_score", match_score(F.col("text_similarity"), F.col("brand_score"))).where(F.col("final_score") >= final_least)
    return scored.select("block", "wording_1", "wording_2", "text_similarity", "brand_score", "final_score", "offers_1", "offers_2")


def _sides(pairs: DataFrame, side: DataFrame) -> DataFrame:
    """Pairs of wordings with what ``side`` has of each one's markets: every two different markets once."""
    of = lambda n: side.toDF(*[c if c == "block" else f"{c}_{n}" for c in side.columns])
    met = pairs.join(of(1), ["block", "wording_1"]).join(of(2), ["block", "wording_2"])
    return met.where("supermarket_1 <> supermarket_2 and (wording_1 <> wording_2 or supermarket_1 < supermarket_2)")


def _offers_of(pairs: DataFrame, prepared: DataFrame, stage: Stage) -> DataFrame:
    """Pairs of wordings (with offers_1 and offers_2) as pairs of offers (idx_1 < idx_2) of different markets.

    A pair of wordings travels as one row with the ids of both, in runs of at most RUN, and is paired by market and id
    where the result is used. Rows lie by their second wording; only if one of these is too much for a task, they are
    dealt out once more.
    """
    known = keyed(prepared).where("idx is not null and supermarket is not null").select(*CELL, "idx")
    place = F.row_number().over(Window.partitionBy("block", "wording").orderBy("supermarket", "idx"))
    of_market = known.withColumn("run", F.floor((place - 1) / RUN)).groupBy("block", "wording", "run", "supermarket").agg(F.sort_array(F.collect_list("idx")).alias("ids"))
    runs = stage.cut(of_market.groupBy("block", "wording", "run").agg(F.collect_list(F.struct("supermarket", "ids")).alias("run_ids")).select("block", "wording", "run_ids"))
    rows = pairs.groupBy("block", "wording_2").agg(F.sum(F.col("offers_1") * F.col("offers_2")).alias("rows"))
    total, most = rows.agg(F.sum("rows"), F.max("rows")).first()
    parts = max(2 * prepared.sparkSession.sparkContext.defaultParallelism, (total or 0) // PAIRS_IN_PART)
    first = pairs.drop("offers_1", "offers_2").join(runs.toDF("block", "wording_1", "runs_1"), ["block", "wording_1"])
    met = first.repartition(parts, "block", "wording_2").join(runs.toDF("block", "wording_2", "runs_2"), ["block", "wording_2"])
    met = met.repartition(parts, F.xxhash64("block", "wording_1", "wording_2", "runs_1", "runs_2")) if (most or 0) > PAIRS_IN_PART else met
    sides = met.withColumn("x", F.explode("runs_1")).drop("runs_1").withColumn("y", F.explode("runs_2")).drop("runs_2")
    sides = sides.where("x.supermarket <> y.supermarket and (wording_1 <> wording_2 or x.supermarket < y.supermarket)")
    sides = sides.select(*[c for c in pairs.columns if c not in ("block", "wording_1", "wording_2", "offers_1", "offers_2")], F.col("x.supermarket").alias("one"), F.col("y.supermarket").alias("two"), F.col("x.ids").alias("ids_1"), F.col("y.ids").alias("ids_2"))
    each = sides.withColumn("a", F.explode("ids_1")).drop("ids_1").withColumn("b", F.explode("ids_2")).drop("ids_2")
    is_first = F.col("a") < F.col("b")
    ordered = {"supermarket_1": F.when(is_first, F.col("one")).otherwise(F.col("two")), "supermarket_2": F.when(is_first, F.col("two")).otherwise(F.col("one")), "idx_1": F.least("a", "b"), "idx_2": F.greatest("a", "b")}
    return each.withColumns(ordered)


def block_similarity(prepared: DataFrame, max_df: float = MAX_DF) -> DataFrame:
    """(idx_1, idx_2, text_similarity): cosine of the TF-IDF vectors fitted within each block, for pairs across markets.

    Blocks of one row or market are left out before any gram is made. A gram in more than max_df of a block's rows
    doesn't count, so that in a block of two rows nothing that they share does. Ids are unique; an offer without id or
    market counts in its block, but is in no pair.
    """
    stage = Stage(prepared.sparkSession, "similarity")
    c = stage.cut(cells(prepared))
    counts = c.groupBy("block", "wording").agg(F.sum("offers"))
    similar = wording_similarity(c, max_df).join(counts.toDF("block", "wording_1", "offers_1"), ["block", "wording_1"]).join(counts.toDF("block", "wording_2", "offers_2"), ["block", "wording_2"])
    return _offers_of(stage.cut(similar), prepared, stage).select("idx_1", "idx_2", "text_similarity")


def match_offers(prepared: DataFrame, text_least: float = TEXT_LEAST, final_least: float = FINAL_LEAST) -> DataFrame:
    """Edges between offers of different markets whose names, sizes and brands agree."""
    stage = Stage(prepared.sparkSession, "matches")
    c = stage.cut(cells(prepared))
    scores = ("text_similarity", "brand_score", "final_score")
    matches = stage.cut(wording_matches(c, text_least, final_least).withColumns({x: F.round(x, 4) for x in scores}))
    return _offers_of(matches, prepared, stage).select("idx_1", "idx_2", "supermarket_1", "supermarket_2", *scores)


def cell_components(prepared: DataFrame, text_least: float = TEXT_LEAST, final_least: float = FINAL_LEAST) -> DataFrame:
    """(block, wording, supermarket, component) of the cells whose offers match some other.

    A cell's offers have the same neighbours, so that its least id stands for all; no edge between offers is made.
    """
    stage = Stage(prepared.sparkSession, "cells")
    c = stage.cut(cells(prepared))
    side = c.where("least is not null and supermarket is not null").select(*CELL, "least")
    found = components(_sides(wording_matches(c, text_least, final_least), side), "least_1", "least_2")
    return stage.cut(side.join(found, side["least"] == found["idx"]).select(*CELL, "component"))


def match_components(prepared: DataFrame) -> DataFrame:
    """(idx, component): what ``components`` gives for the edges of ``match_offers``, without making them."""
    return keyed(prepared).where("idx is not null").select(*CELL, "idx").join(cell_components(prepared), CELL).select("idx", "component")


def match_groups(prepared: DataFrame) -> DataFrame:
    """What ``groups_of`` gives for the edges of ``match_offers``, without making them."""
    return keyed(prepared).where("idx is not null").join(dense_labels(cell_components(prepared), "component"), CELL).drop("block", "wording")


def components(edges: DataFrame, a: str = "idx_1", b: str = "idx_2") -> DataFrame:
    """(idx, component): the smallest id of each node's component.

    Each round every node takes the least label of its neighbours and that label's own label, so that the number of
    rounds grows with the logarithm of a path's length; rounds end when no label changes. Labels lie in the shared
    folder between rounds.
    """
    stage = Stage(edges.sparkSession, "components")
    arcs = stage.cut(edges.select(F.col(a).alias("x"), F.col(b).alias("y")).union(edges.select(F.col(b), F.col(a))).distinct())
    labels = stage.cut(arcs.groupBy("x").agg(F.least("x", F.min("y")).alias("label")))
    while True:
        near = arcs.join(labels.toDF("y", "near"), "y").groupBy("x").agg(F.min("near").alias("near"))
        lower = labels.join(near, "x").select("x", "label", F.least("label", "near").alias("new"))
        jumped = lower.join(labels.toDF("new", "of_new"), "new", "left").select("x", "label", F.least("new", F.coalesce("of_new", "new")).alias("new"))
        step = stage.cut(jumped)
        changed = step.where("new < label").limit(1).count()
        stage.drop(labels)
        path = step._stage_path
        labels = step.select("x", F.col("new").alias("label"))
        labels._stage_path = path
        if not changed:
            return labels.toDF("idx", "component")


def groups_of(prepared: DataFrame, edges: DataFrame) -> DataFrame:
    """The offers that match some other, with group_id 1, 2, ... in the order of their least id."""
    return dense_labels(prepared.join(components(edges), "idx"), "component")


def compare_prices(grouped: DataFrame) -> DataFrame:
    """Cheapest offer, number of options and markets of each group with priced offers of two markets and more."""
    priced = grouped.where("price is not null").withColumn("place", F.struct("price", "idx"))
    # first by market, so that no set of markets is kept for each offer
    of_market = priced.groupBy("group_id", "supermarket").agg(F.min_by(F.struct("name", "brand", "supermarket", "price"), "place").alias("b"), F.min("place").alias("place"), F.count("*").alias("n"))
    best = of_market.groupBy("group_id").agg(
        F.min_by("b", "place").alias("b"),
        F.sum("n").alias("cantidad_opciones_comparadas"),
        F.array_join(F.sort_array(F.collect_set("supermarket")), ", ").alias("supermercados_presentes"),
        F.count("supermarket").alias("markets"),
    )
    return best.where("markets > 1").select(
        "group_id", F.col("b.name").alias("producto_referencia"), F.col("b.brand").alias("marca_referencia"), F.col("b.supermarket").alias("supermercado_mas_barato"), F.col("b.price").alias("precio_mas_barato"),
        "cantidad_opciones_comparadas", "supermercados_presentes",
    )
