"""Many offers of few wordings: work between them follows the wordings, not the pairs of offers."""

import random

import pytest

from pricelens.operators import matching
from pricelens.plans import reference

PARTS = 1200
NAMES = ["pan de molde blanco", "pan de molde integral", "pan de molde blanco grande", "pan de molde integral grande", "leche entera", "leche descremada", "", None]


@pytest.fixture(scope="module")
def repeated(spark, tmp_path_factory):
    """Parts of two names, all offered in two markets: 2 400 offers, 720 000 edges."""
    folder = tmp_path_factory.mktemp("repeated")
    rows = {
        "region": ([(0, "A"), (1, "B")], "r_regionkey int, r_name string"),
        "nation": ([(0, 0), (1, 1)], "n_nationkey int, n_regionkey int"),
        "supplier": ([(0, 0), (1, 1)], "s_suppkey bigint, s_nationkey int"),
        "part": ([(i, "red bolt", "Brand#12", "LARGE", 20 + 20 * (i % 2)) for i in range(PARTS)], "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int"),
        "lineitem": ([(i, s, 1.0, 100.0 + i + s, 0.0) for i in range(PARTS) for s in range(2)], "l_partkey bigint, l_suppkey bigint, l_quantity double, l_extendedprice double, l_discount double"),
    }
    for name, (values, schema) in rows.items():
        spark.createDataFrame(values, schema).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def shuffled(spark) -> int:
    """Bytes of shuffle written so far."""
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty(30_000)
    found = sc.statusStore().executorList(False)
    return sum(found.apply(i).totalShuffleWrite() for i in range(found.size()))


def test_group_prices(spark, repeated):
    before = shuffled(spark)
    got = [tuple(r) for r in reference.a10_group_prices(spark, repeated).orderBy("group_id").collect()]
    assert got == [(1, "red bolt Brand#12 20 l", "Brand#12", "a", 100.0, PARTS, "a, b"), (2, "red bolt Brand#12 40 l", "Brand#12", "a", 101.0, PARTS, "a, b")]
    assert shuffled(spark) - before < 3e6


def test_components(spark, repeated):
    before = shuffled(spark)
    got = reference.g1_components(spark, repeated).groupBy("component").count().collect()
    assert sorted((r["component"], r["count"]) for r in got) == [(0, PARTS), (10, PARTS)]
    assert shuffled(spark) - before < 3e6


def test_components_of_cells_are_those_of_the_edges(spark):
    rng = random.Random(11)
    word = lambda *w: rng.choice(w)
    rows = [(i, word("a", "b", "c", None), word(*NAMES), word("x", "x y", "", None), word("c", None), "mass", word(None, 0.0, 100.0, 104.0, 120.0), 5.0) for i in range(400)]
    rows.append((None, "a", NAMES[0], "x", "c", "mass", 100.0, 5.0))
    df = spark.createDataFrame(rows, "idx int, supermarket string, name string, brand string, category_std string, unit_family string, size_std double, price double")
    prepared = matching.prepare(df)
    wanted = sorted(map(tuple, matching.components(matching.match_offers(prepared)).collect()))
    assert len({c for _, c in wanted}) > 2 and wanted == sorted(map(tuple, matching.match_components(prepared).collect()))
    assert matching.match_components(matching.prepare(df.limit(0))).count() == 0


def test_match_edges(spark, repeated):
    before = shuffled(spark)
    edges = reference.j1_match_edges(spark, repeated)
    got = edges.groupBy("supermarket_1", "supermarket_2").agg({"idx_1": "min", "idx_2": "max", "final_score": "min", "*": "count"}).collect()
    assert sum(r["count(1)"] for r in got) == 2 * (PARTS // 2) ** 2 and {r["min(final_score)"] for r in got} == {1.0}
    assert {(r["supermarket_1"], r["supermarket_2"]) for r in got} == {("a", "b"), ("b", "a")}
    assert shuffled(spark) - before < 3e6
    assert edges.where("idx_1 >= idx_2").count() == 0 and edges.select("idx_1", "idx_2").distinct().count() == 2 * (PARTS // 2) ** 2


def test_match_edges_of_many_wordings(spark):
    """200 wordings of five offers each in five markets: pairs of wordings move, not pairs of their markets."""
    rows = [(i * 10 + m, str(m), "pan de molde blanco " + ("chico", "grande")[i % 2], "x", "c", "mass", 101.0 + i / 100, 5.0) for i in range(200) for m in range(5)]
    df = spark.createDataFrame(rows, "idx bigint, supermarket string, name string, brand string, category_std string, unit_family string, size_std double, price double")
    before = shuffled(spark)
    edges = matching.match_offers(matching.prepare(df))
    got = edges.select("idx_1", "idx_2", "supermarket_1", "supermarket_2").collect()
    used = shuffled(spark) - before
    assert {tuple(r) for r in got} == {(a[0], b[0], a[1], b[1]) for a in rows for b in rows if a[0] < b[0] and a[1] != b[1] and a[2] == b[2]}
    assert len(got) == 200_000 and used < 3e6, used


def test_match_edges_in_runs(spark, monkeypatch):
    """Runs of two ids, and second wordings that are too much for a task: the same edges."""
    rng = random.Random(12)
    rows = [(i, rng.choice(["a", "b", "c", None]), rng.choice(NAMES), "x", "c", "mass", 100.0, 5.0) for i in range(200)]
    df = matching.prepare(spark.createDataFrame([*rows, (None, "a", NAMES[0], "x", "c", "mass", 100.0, 5.0)], "idx int, supermarket string, name string, brand string, category_std string, unit_family string, size_std double, price double"))
    wanted = sorted(map(tuple, matching.match_offers(df).collect()))
    monkeypatch.setattr(matching, "RUN", 2)
    monkeypatch.setattr(matching, "PAIRS_IN_PART", 50)
    assert wanted and wanted == sorted(map(tuple, matching.match_offers(df).collect()))
