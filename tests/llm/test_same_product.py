import itertools
import random
import sys
import zlib

import pytest

from pricelens.llm.same_product import LEAST_CHANGE, THRESHOLD, _graph, _meetings, _over_threshold, _scores, _settled, _wordings, content_in_name, label_products, product_pairs, words_of
from pricelens.session import Stage

COLUMNS = "listing_id bigint, name string, brand string, net_content string, unit string, size_std double, unit_family string, cba_name string, supermarket string, sku string, terms string, product string"


@pytest.mark.parametrize(
    "name, words",
    [
        ("500GR Pimentón Lakijoga Baby", ["pimenton", "lakijoga", "baby"]), ("Pimentón S/Gluten Pack 4 × 350 g", ["pimenton", "sin", "gluten"]), ("Café 70% Cacao un kilo", ["cafe", "70pct", "cacao"]),
        ("Ñoquis N° 5 1/2 kilo", ["noquis", "n5"]), ("Kétchup E.V. 0.25 L", ["ketchup", "ev"]), ("AlmidÃ³n de MaÃ­z", ["almidon", "de", "maiz"]), ("", []),
    ],
)
def test_words(name, words):
    assert words_of(name)[0] == words


@pytest.mark.parametrize("name, content", [("Pan 0,5 kg", "mass:500"), ("Leche pack 6 un 1 litro", "volume:6000"), ("Huevos 12 un", "unit:12"), ("Arroz kilo y medio", "mass:1500"), ("Pan", None)])
def test_content_in_name(name, content):
    assert content_in_name(name, None) == content


def market(seed=4, n=1500, each=6, dense=False):
    """Listings of products made up of kind, variety, brand and content, in many wordings; ``dense``: of every product."""
    rng = random.Random(seed)
    kinds = {f"item {k}": k for k in ["arroz", "pimenton", "ketchup", "galleta", "queso crema", "atun"]}
    varieties = {"integral": ["integral", "int."], "organico": ["organico", "org."], "clasico": ["clasico"], "picante": ["picante"]}
    brands = ["".join(rng.choice("bcdfgklmnpstvz") + rng.choice("aeiou") for _ in range(4)) for _ in range(5 if dense else 40)]
    offers = ["oferta", "super ahorro", "lleva mas", "imperdible", "recien llegado", "", ""]
    products = [(rng.choice(sorted(kinds)), rng.choice(sorted(varieties)), rng.choice(brands), rng.choice([250, 500, 1000])) for _ in range(n // each)]
    truth, rows = {}, []
    for i in range(n):
        item, variety, brand, grams = rng.choice(products)
        size = rng.choice([f"{grams} g", f"{grams / 1000:g} kg".replace(".", ","), f"{grams}gr."])
        parts = [kinds[item], varieties[variety][0] if dense else rng.choice(varieties[variety]), rng.choice([brand, brand.upper(), f"Don {brand}"])]
        rng.shuffle(parts)
        name = " ".join([*parts, rng.choice(["bolsa", "caja", "", ""]), size, rng.choice(offers)])
        key = (item, variety, brand, grams)
        truth[i] = key
        sku = f"s{zlib.crc32(repr(key).encode())}" if rng.random() < 0.6 else None
        rows.append((i, name, brand if rng.random() < 0.7 else None, None, None, None, None, item if rng.random() < 0.95 else None, rng.choice("mn"), sku, "x", "y"))
    return truth, rows


@pytest.mark.parametrize("dense", [False, True])
def test_pairs_of_a_market(spark, dense):
    """Where every brand has every variety in every size, cells tell nothing and mustn't join what words keep apart."""
    truth, rows = market(dense=dense)
    got = {tuple(r) for r in product_pairs(spark.createDataFrame(rows, COLUMNS)).collect()}
    wanted = {(a, b) for a, b in itertools.combinations(sorted(truth), 2) if truth[a] == truth[b]}
    right = len(got & wanted)
    assert right / len(got) > 0.98 and right / len(wanted) > 0.95
    assert all(a < b for a, b in got)


def test_odd_tables(spark):
    assert product_pairs(spark.createDataFrame([], COLUMNS)).count() == 0
    nothing = [(i, None, None, None, None, None, None, None, None, None, None, None) for i in range(5)]
    assert product_pairs(spark.createDataFrame(nothing, COLUMNS)).count() == 0
    _, rows = market(n=300)
    rows += [rows[0]] * 3 + [(1000, "z " * 20_000 + "1 kg", "z", None, None, float("nan"), "q", "", "", "", None, None), *nothing]
    labels = label_products(spark.createDataFrame(rows, COLUMNS)).collect()
    assert len({(r.p1, r.p2) for r in labels if r.listing_id == 0}) == 1 and len([r for r in labels if r.listing_id == 0]) == 4


def test_article_numbers_are_not_looked_at(spark):
    _, rows = market(n=300)
    unnumbered = [(*r[:9], None, *r[10:]) for r in rows]
    one, two = ({tuple(r) for r in label_products(spark.createDataFrame(x, COLUMNS)).collect()} for x in (rows, unnumbered))
    assert one == two and len(one) > 250


def test_words_known_by_join_give_the_same(spark):
    info = spark.createDataFrame(
        [("arozz", "arroz", None, None, False, False), ("kibo", None, "kibo", None, False, False), ("kibbo", None, "kibo", "kibo", False, False), ("oferta", None, None, None, True, True), ("con_tapa", None, None, None, False, True)],
        "w string, spelling string, brand string, brand_spelling string, even boolean, noise boolean",
    )
    texts = [("arozz integral kibo oferta", ""), ("arroz con tapa", "kibbo"), ("", ""), ("arozz integral kibo oferta", "otra")]
    parsed = spark.createDataFrame([(i, None, w, b, "mass:1") for i, (w, b) in enumerate(texts)], "listing_id bigint, item string, words string, brand_words string, content string")
    sent, joined = ({tuple(r) for r in _wordings(parsed, info, set(), Stage(spark, "test"), most).select("listing_id", "brand", "wording", "content", "name").collect()} for most in (100, 0))
    assert sent == joined and {(r[0], r[1], r[2]) for r in sent} == {(0, "kibo", "arroz integral"), (1, "kibo", "arroz"), (2, None, ""), (3, "kibo", "arroz integral")}


def test_every_pair_over_the_threshold_is_found(spark):
    rng = random.Random(7)
    terms = [f"t{i}" for i in range(14)]
    worded = sorted({(k, " ".join(sorted({"kind", *rng.sample(terms, rng.randrange(0, 6))} - ({"kind"} if rng.random() < 0.4 else set())))) for k in ("a", "b") for _ in range(120)})
    sizes = spark.createDataFrame([(k, w, 1) for k, w in worded if w], "kind string, wording string, n bigint")
    rarity = {(k, t): 0.02 if t == "kind" else rng.uniform(0.5, 6) for k in ("a", "b") for t in ["kind", *terms]}
    weight = {t: rng.choice([0.01, 0.3, 1.0]) for t in terms[:10]}

    def mass(k, words):
        return sum(rarity[k, t] * weight.get(t, 1.0) for t in words)

    wanted = set()
    for (k, x), (k2, y) in itertools.combinations([r for r in worded if r[1]], 2):
        a, b = set(x.split()), set(y.split())
        if k == k2 and mass(k, a & b) >= THRESHOLD * mass(k, a | b):
            wanted.add((k, x, y))
    rare = spark.createDataFrame([(*kt, r) for kt, r in rarity.items()], "kind string, term string, rarity double")
    got = [tuple(r) for r in _over_threshold(sizes, rare, spark.createDataFrame(list(weight.items()), "term string, weight double")).collect()]
    assert set(got) == wanted and len(got) == len(wanted) > 20


def test_reinforcement_settles_and_tells_varieties_from_spellings(spark):
    """Wordings that come and go within cells are one, those that keep to their own cells aren't, whatever the words."""
    stage = Stage(spark, "test")
    rng = random.Random(3)
    cells = []
    for i in range(60):
        variety = [["int", "integral"], ["organico", "org"], ["blanco"]][i % 3]
        cells += [("k", i, w) for w in (rng.choice(variety) for _ in range(4))]
    contexts = [(k, n, 1, 4, w, sum(1 for c in cells if c[1] == n and c[2] == w)) for k, n, w in sorted(set(cells))]
    contexts = spark.createDataFrame(contexts, "kind string, node bigint, cells bigint, n bigint, wording string, a bigint")
    sizes = spark.createDataFrame([("k", w, 10) for w in ("int", "integral", "organico", "org", "blanco")], "kind string, wording string, n bigint")
    rarity = spark.createDataFrame([("k", w, 1.0) for w in ("int", "integral", "organico", "org", "blanco")], "kind string, term string, rarity double")
    more = spark.createDataFrame([("k", "blanco", "integral"), ("k", "int", "org")], "kind string, w1 string, w2 string")
    met, candidates = _meetings(contexts, sizes, stage)
    graph = _graph(contexts, met, candidates.union(more).distinct(), sizes, rarity, stage)
    weights, rounds = _settled(graph, stage)
    score = {(r.w1, r.w2): r.score for r in _scores(graph, weights).collect()}
    joined = {(r.w1, r.w2): r.score for r in _scores(graph._replace(small=False), weights).collect()}
    assert all(abs(joined[k] - v) < 1e-9 for k, v in score.items())
    assert score["int", "integral"] > THRESHOLD and score["org", "organico"] > THRESHOLD
    assert score["int", "org"] < 0.2 and score["blanco", "integral"] < 0.2
    assert rounds > 1 and weights.where(f"change >= {LEAST_CHANGE}").count() == 0


def test_plain_words_cost_little():
    """A word that tells no amount takes few steps, whatever else the name holds."""

    def steps(name):
        count = 0

        def trace(frame, event, _):
            nonlocal count
            if frame.f_code is not words_of.__code__:
                return None
            count += event == "line"
            return trace

        before = sys.gettrace()
        sys.settrace(trace)
        try:
            words_of(name)
        finally:
            sys.settrace(before)
        return count

    assert steps("arroz " * 101) - steps("arroz") <= 700
    assert words_of("Café Nº 5 Moliéndo 2x500gr 3pctx 4% n 7 Ñandú") == (["cafe", "no", "moliendo", "pctx", "4pct", "n7", "nandu"], ["5", "2", "x", "500", "gr", "3"])
