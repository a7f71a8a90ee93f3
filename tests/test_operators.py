import itertools
import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from pricelens.operators import basket, dedup, matching, ranking, rules, serving
from pricelens.schemas import PRODUCT, ensure_columns, to_schema
from pricelens.sources import payloads, readers, sinks


def test_first_known_and_coherent(spark):
    df = spark.createDataFrame([("i", 1.0, "a", None), ("i", 2.0, "b", "S"), (None, 0.0, "z", "z")], "item string, price double, brand string, sub string")
    assert [tuple(r) for r in ranking.first_known_values(df, ["item"], [("price", False)], ["brand", "sub"]).collect()] == [("i", "a", "S")]
    assert [tuple(r) for r in ranking.coherent_rows(df, ["item"], [("price", False)]).collect()] == [("i", 1.0, "a", None)]
    assert [tuple(r) for r in ranking.coherent_rows(df, ["item"], [("price", True)]).collect()] == [("i", 2.0, "b", "S")]
    with pytest.raises(ValueError):
        ranking.coherent_rows(df, ["item"], [("brand", True)])


def test_keep(spark):
    df = spark.createDataFrame([("k", 1, 5), ("k", 2, 4), (None, 3, 3), (None, 4, 2)], "k string, seq int, q int")
    pick = lambda d: sorted(r.seq for r in d.collect())
    assert pick(dedup.keep_last(df, ["k"], ["seq"])) == [2, 4] and pick(dedup.keep_first(df, ["k"], ["seq"])) == [1, 3]
    assert pick(dedup.keep_best(df, ["k"], F.col("q"), ["seq"])) == [1, 3]


def test_latest_by_name_and_time(spark):
    files = spark.createDataFrame([("c", "a_20260101_000000.csv", 2), ("c", "b_20250101_000000.csv", 9), ("c", "z_20240101_000000.csv", 1)], "folder string, path string, modified int")
    assert dedup.latest_files(files, "folder", "path").first()["path"][0] == "z" and dedup.latest_files(files, "folder", "path", "modified").first()["path"][0] == "b"
    t = files.select(dedup.file_timestamp(F.col("path")).cast("string").alias("t"), dedup.file_prefix(F.col("path")).alias("p")).collect()
    assert [(r.t, r.p) for r in t][0] == ("2026-01-01 00:00:00", "a")
    assert spark.range(1).select(dedup.file_timestamp(F.lit("x.csv")).alias("t")).first()["t"] is None


def test_rules(spark):
    listed = spark.createDataFrame([("pan", ["pan de molde", "marraqueta"], [], ["integral"], "mass", 100.0, 900.0), ("nada", ["x"], [], [], None, None, None)], rules.RULE_SCHEMA)
    products = spark.createDataFrame([(1, "pan de molde blanco", "mass", 500.0), (2, "pan de molde integral", "mass", 500.0), (3, "pan de molde", None, 500.0), (4, "marraqueta", "mass", None), (5, "panera marraqueta", "mass", 5.0), (6, None, "mass", 5.0)], "id int, t string, f string, s double")
    met = rules.match_rules(products, listed, "t", "f", "s")
    assert sorted(r.id for r in met.collect()) == [1, 4]
    assert sorted((r.rule, r.id) for r in rules.with_missing(listed, met).collect() if r.rule == "nada") == [("nada", None)]


def test_components_against_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 360)]
    edges = [(a, b) for a, b in edges if a != b]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.idx: r.component for r in matching.components(spark.createDataFrame(edges, "idx_1 int, idx_2 int")).collect()}
    assert got == {x: find(x) for x in parent}
    assert matching.components(spark.createDataFrame([], "idx_1 int, idx_2 int")).count() == 0


def test_block_similarity_against_plain_python(spark):
    rng = random.Random(5)
    names = [" ".join(rng.choice(["pan", "de", "molde", "blanco", "x1", "integral", "grande"]) for _ in range(4)) for _ in range(25)]
    rows = [(i, rng.choice("ab"), n, "marca", "cat", "mass", 100.0, 5.0) for i, n in enumerate(names)] + [(99, "a", None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "idx int, supermarket string, name string, brand string, category_std string, unit_family string, size_std double, price double")
    prepared = matching.prepare(df)
    got = {(r.idx_1, r.idx_2): r.text_similarity for r in matching.block_similarity(prepared).collect()}
    blocks = defaultdict(list)
    for r in prepared.collect():
        blocks[r.category_std, r.unit_family, r.size_bucket, r.signature, r.split].append(r)
    wanted = {}
    for members in blocks.values():
        n = len(members)
        if n < 2 or len({m.supermarket for m in members}) < 2:
            continue
        vectors, df_ = {}, defaultdict(int)
        for m in members:
            w = [x for x in m.clean_name.split() if len(x) > 1]
            grams = w + [f"{a} {b}" for a, b in itertools.pairwise(w)]
            tf = {g: grams.count(g) for g in grams}
            vectors[m.idx] = (m.supermarket, tf)
            for g in tf:
                df_[g] += 1
        unit = {}
        for i, (s, tf) in vectors.items():
            v = {g: k * (math.log((1 + n) / (1 + df_[g])) + 1) for g, k in tf.items() if df_[g] <= 0.95 * n}
            norm = math.sqrt(sum(x * x for x in v.values()))
            unit[i] = (s, {g: x / norm for g, x in v.items()} if norm else {})
        for i, j in itertools.combinations(sorted(unit), 2):
            shared = set(unit[i][1]) & set(unit[j][1])
            if unit[i][0] != unit[j][0] and shared:
                wanted[i, j] = sum(unit[i][1][g] * unit[j][1][g] for g in shared)
    assert got.keys() == wanted.keys() and all(abs(got[k] - wanted[k]) < 1e-9 for k in got)


def test_basket(spark):
    offers = spark.createDataFrame([("m", "a", 5.0, 1), ("m", "a", 3.0, 2), ("m", "b", 2.0, 3), ("n", "a", 1.0, 4), ("n", None, 9.0, 5), ("n", "b", None, 6)], "market string, item string, cost double, id int")
    best = basket.best_offers(offers, "item", "market", "cost", "id")
    assert sorted((r.market, r.item, r.cost) for r in best.collect()) == [("m", "a", 3.0), ("m", "b", 2.0), ("n", "a", 1.0)]
    summary = {r.market: (r.items_cubiertos, r.costo_total, r.cobertura_pct_fmt) for r in basket.market_summary(best, "item", "market", "cost", 2).collect()}
    assert summary == {"m": (2, 5.0, "100,00%"), "n": (1, 1.0, "50,00%")}
    assert {r.item: r.market for r in basket.optimal_basket(best, "item", "market", "cost").collect()} == {"a": "n", "b": "m"}
    assert {r.market: r.mas_barato for r in basket.complete_totals(best, "item", "market", "cost", 2).collect()} == {"m": True, "n": False}
    items = spark.createDataFrame([("a",), ("z",)], "item string")
    assert {r.item: r.estado for r in basket.coverage(items, offers, "item", "market", "cost").collect()} == {"a": "cubierto", "z": "faltante"}
    assert {(r.indicador, r.valor) for r in basket.key_values(spark.createDataFrame([("x", 1)], "a string, b int"), ["a", "b"]).collect()} == {("a", "x"), ("b", "1")}


def test_serving(spark):
    df = spark.createDataFrame([("1", "Jumbo", "Pan Rojo", 5.0), ("2", "jumbo", "pan rojo", -1.0), ("3", None, "pan rojo", 2.0)], "sku string, supermarket string, name string, price double")
    assert [r.sku for r in serving.search(df, "rojo pan", ["name"], limit=9).collect()] == ["3", "1", "2"]
    assert [r.sku for r in serving.search(df, "pan", ["name"], market="JUMBO", limit=1).collect()] == ["1"]
    assert serving.compare(df, "pan", ["name"], 1).count() == 3


def test_schemas(spark):
    df = spark.createDataFrame([("1", "x")], "sku string, other string")
    out = to_schema(df, PRODUCT)
    assert out.columns == [f.name for f in PRODUCT] and out.first()["sku"] == "1" and out.first()["page_num"] is None
    assert ensure_columns(df, {"sku": "string", "z": "double"}).columns == ["sku", "other", "z"]


def test_readers(spark, tmp_path):
    for folder, name, body, when in (("c1", "a_20260101_000000.csv", "﻿sku;name\n1;Ñandú\n", 5), ("c1", "b_20250101_000000.csv", 'sku,name\n2,"x\ny"\n', 9), ("c2", "e_20260101_000000.csv", "", 1)):
        path = tmp_path / folder / name
        path.parent.mkdir(exist_ok=True)
        path.write_bytes(body.encode())
        __import__("os").utime(path, (when, when))
    latin = tmp_path / "latin.csv"
    latin.write_bytes("sku;name\n3;Ñandú\n".encode("latin-1"))
    assert readers.read_delimited(spark, str(latin)).first()["name"] == "Ñandú"
    got = readers.consolidate_market(spark, f"file://{tmp_path}/c*", "m").collect()
    assert [(r.sku, r.name, r.categoria, r.supermarket) for r in got] == [("2", "x\ny", "c1", "m")]
    got = readers.consolidate_market(spark, f"file://{tmp_path}/c1", "m", by_time=False).collect()
    assert [(r.sku, str(r.timestamp_archivo)) for r in got] == [("2", "2025-01-01 00:00:00")]
    (tmp_path / "cart.txt").write_text("# lista\n\n pan \nleche\n")
    assert [r.item for r in readers.read_list(spark, str(tmp_path / "cart.txt")).collect()] == ["pan", "leche"]
    texts = spark.createDataFrame([(1, "Anexo\nArroz largo\nfino G 1,5 2 3.000,5\nPan CC 1 2 3\nresto"), (2, None)], "id int, t string")
    rows = readers.parse_rows(readers.table_rows(texts, "id", "t", ["anexo"])).collect()
    assert [(r.row_no, r.alimento, r.unidad, r.cantidad_dia, r.valor_mensual) for r in rows] == [(1, "Arroz largo fino", "G", 1.5, 3000.5), (2, "Pan", "CC", 1.0, 3.0)]


def test_payload_products(spark):
    text = '{"facets": [{"id": 1}, {"id": 2}, {"id": 3}], "x": {"products": [{"productId": "p1", "categories": [{"name": "c"}], "items": [{"name": "A", "price": 5}]}, {"productId": "p2", "name": "B", "sellers": [{"price": 7, "listPrice": 9}]}, {"productId": "p2", "name": "C", "price": "$ 1.000"}]}}'
    df = spark.createDataFrame([(1, text), (2, "[]"), (3, None), (4, "{")], "id int, payload string")
    got = [tuple(r) for r in payloads.extract_products(df, "id", "payload").collect()]
    assert got == [(1, "p1", "A", None, 5, None, None), (1, "p2", "C", None, 1000, None, None)]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, float("nan")), (2, 2.0)], "a int, b double")
    path = sinks.write_versioned(df, str(tmp_path), "base")
    assert "base_20" in path and readers.read_delimited(spark, path).count() == 2
    assert sinks.write_snapshot(df.orderBy("a"), str(tmp_path / "x.json"), 10) == 2 and '"b"' not in (tmp_path / "x.json").read_text().split("}")[0]
    df.write.parquet(str(tmp_path / "t"))
    assert {(r.clave, r.existe, r.filas) for r in sinks.catalogue(spark, {"t": str(tmp_path / "t"), "u": str(tmp_path / "u")}).collect()} == {("t", True, 2), ("u", False, None)}
    cache = sinks.TableCache(spark, 1)
    assert cache.get(str(tmp_path / "t")) is cache.get(str(tmp_path / "t"))
