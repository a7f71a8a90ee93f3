import random
from collections import defaultdict

import numpy as np
import pytest

from pricelens.llm import mixing, packing, tokens
from pricelens.llm.packing import Index, fill, fill_report, pack_documents

pytest.importorskip("public_tokenizers")

DOCS = "doc_id bigint, text string, lang string, cba_name string, source string, size int, k int, terms string"
KINDS = "contenedor string, capacidad_tokens int"


def test_index_against_plain_bm25():
    rng = np.random.default_rng(1)
    terms = [np.unique(rng.integers(0, 40, 12)).astype("int32") for _ in range(30)]
    counts = [rng.integers(1, 4, len(t)) for t in terms]
    sizes = np.array([c.sum() for c in counts])
    frequency = {t: sum(t in x for x in terms) for t in range(40)}
    index = Index(terms, counts, sizes, frequency, 30)
    for q in (0, 7):
        for d in range(30):
            score = 0.0
            for t in terms[q]:
                where = np.flatnonzero(terms[d] == t)
                if len(where):
                    f, df = counts[d][where[0]], frequency[int(t)]
                    score += np.log(1 + (30 - df + 0.5) / (df + 0.5)) * f * (packing.K1 + 1) / (f + packing.K1 * (1 - packing.B + packing.B * sizes[d] / sizes.mean()))
            assert index.scores(q)[d] == pytest.approx(score)


@pytest.mark.parametrize("capacity", [1, 7, 64, 1000])
def test_fill_places_everything_once(capacity):
    rng = np.random.default_rng(2)
    sizes = rng.integers(0, 200, 150)
    terms = [np.unique(rng.integers(0, 50, 8)).astype("int32") for _ in sizes]
    placed = fill(Index(terms, [np.ones(len(t), int) for t in terms], sizes, {}, 150), sizes, capacity)
    room, pieces = defaultdict(int), defaultdict(list)
    for p in placed:
        room[p.container] += p.size
        pieces[p.document].append((p.first_token, p.size))
    assert max(room.values()) <= capacity
    for i, size in enumerate(sizes):
        at = 0
        for first, n in sorted(pieces[i]):
            assert first == at
            at += n
        assert at == size and (size > capacity or len(pieces[i]) <= 1)
    positions = defaultdict(list)
    for p in placed:
        positions[p.container].append(p.position)
    assert all(sorted(x) == list(range(1, len(x) + 1)) for x in positions.values())


def documents(spark, n=400):
    rng = random.Random(3)
    words = ["precio", "arroz", "vino", "de", "la", "tienda", "oferta", "米", "ราคา", "queso"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 120))), rng.choice(["es", None]), rng.choice(["a", None]), rng.choice(["s1", "s1", "s2", "s3", None, "otro"]), 1, 2, "x") for i in range(n)]
    rows += [(n, None, None, None, "s1", None, None, None), (n + 1, "", None, None, "s1", None, None, None), (n + 2, "   ", None, None, "s2", None, None, None), (n + 3, "arroz " * 60_000, None, None, "s2", None, None, None), (n + 4, rows[0][1], None, None, "s1", 0, 0, "")]
    return spark.createDataFrame(rows, DOCS)


def test_packing(spark):
    docs, kinds = documents(spark), spark.createDataFrame([("chico", 64), ("grande", 512), ("mal", 0), ("nulo", None)], KINDS)
    packed = pack_documents(docs, kinds)
    rows = packed.collect()
    sizes = {r.doc_id: len(tokens.encode(r.text)) for r in docs.collect() if r.text}
    for kind, capacity in (("chico", 64), ("grande", 512)):
        room, got = defaultdict(int), defaultdict(int)
        for r in rows:
            if r.contenedor == kind:
                room[r.caja] += r.n_tokens
                got[r.doc_id] += r.n_tokens
        assert got == sizes and max(room.values()) <= capacity
    report = {r.contenedor: r.llenado for r in fill_report(packed, kinds).collect()}
    assert set(report) == {"chico", "grande"} and min(report.values()) > 0.9
    assert pack_documents(docs.limit(0), kinds).count() == 0 and pack_documents(docs, kinds.limit(0)).count() == 0


def test_long_texts_are_encoded_whole():
    text = ("arroz con leche\n" * 5000) + "x" * 45_000
    ids = tokens.encode(text)
    assert tokens.encoding().decode(list(ids)) == text


def test_plan():
    target, repeats = {"a": 0.5, "b": 0.3, "c": 0.2, "none": 0.1}, {"a": 2, "b": 1, "c": 5, "none": 1}
    shares, exponent = mixing.plan_mixture({"a": 1000, "b": 9000, "c": 400}, target, repeats)
    # the exponent is found inside 0 to MOST_EXPONENT, where the mixture has the targets
    assert exponent == pytest.approx(1.0) and sum(s.budget for s in shares) <= 4000 and {s.source for s in shares} == {"a", "b", "c"}
    assert all(s.weight == pytest.approx(target[s.source]) for s in shares)
    shares, exponent = mixing.plan_mixture({"a": 1000, "b": 9000, "c": 400}, target, repeats, total=8000)
    assert 0 <= exponent < 1 and all(s.budget <= s.tokens * s.max_repeats for s in shares) and sum(s.budget for s in shares) == pytest.approx(8000, abs=5)
    assert mixing.plan_mixture({}, target, repeats) == ([], 0.0)
    assert mixing.plan_mixture({"a": 10}, {"a": 1.0}, {"a": 1}, total=1000)[0][0].budget == 10


def test_plan_of_an_entropy():
    tokens_of, repeats = {"a": 1000, "b": 9000, "c": 400}, {"a": 3, "b": 3, "c": 3}
    shares, exponent = mixing.plan_mixture(tokens_of, {"a": 0.4, "b": 0.4, "c": 0.2}, repeats, target_entropy=0.9)
    weights = {s.source: s.weight for s in shares}
    assert 0 < exponent < 1 and mixing.entropy(weights) == pytest.approx(0.9)
    raw = {s: (n / 10_400) ** exponent for s, n in tokens_of.items()}
    assert all(weights[s] == pytest.approx(raw[s] / sum(raw.values())) for s in raw)
    assert all(s.budget <= s.tokens * s.max_repeats for s in shares) and any(s.budget >= 0.999 * s.tokens * s.max_repeats for s in shares)
    # a total that this doesn't allow takes the exponent back towards the corpus
    wider, nearer = mixing.plan_mixture(tokens_of, {"a": 0.4, "b": 0.4, "c": 0.2}, repeats, total=20_000, target_entropy=0.9)
    assert exponent < nearer < 1 and sum(s.budget for s in wider) == pytest.approx(20_000, abs=5)


def test_too_long_a_list_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MOST_SOURCES", 2)
    targets = spark.createDataFrame([(f"s{i}", 0.2, 1) for i in range(3)], "source string, target_share double, max_repeats int")
    with pytest.raises(ValueError):
        mixing.mix_sources(documents(spark, 10), targets)


def test_mixing(spark):
    docs = documents(spark, 900)
    targets = spark.createDataFrame([("s1", 0.5, 1), ("s2", 0.2, 2), ("s3", 0.3, 4), ("leer", 0.1, 1), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    small = docs.where("doc_id <> 903")
    drawn = mixing.mix_sources(small, targets)
    rows = drawn.collect()
    assert len({r.doc_id for r in rows}) == len(rows) and {r.source for r in rows} <= {"s1", "s2", "s3"}
    limit = {"s1": 1, "s2": 2, "s3": 4}
    got = defaultdict(int)
    for r in rows:
        assert 1 <= r.repeticiones <= limit[r.source]
        got[r.source] += r.n_tokens * r.repeticiones
    total = sum(got.values())
    for s, t in (("s1", 0.5), ("s2", 0.2), ("s3", 0.3)):
        assert abs(got[s] / total - t) < 0.02
    assert sorted(map(tuple, mixing.mix_sources(small, targets).collect())) == sorted(map(tuple, rows))
    assert {r.source: r.documentos for r in mixing.share_report(drawn, targets.where("source is not null")).collect()}["leer"] == 0
    assert mixing.mix_sources(docs.limit(0), targets).count() == 0 and mixing.mix_sources(docs, targets.limit(0)).count() == 0
