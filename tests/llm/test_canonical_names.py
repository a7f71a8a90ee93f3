import pytest

from pricelens.llm.canonical_names import Mapper, letter_distance, likeness, map_to_list

ITEMS = [(1, "Arroz blanco pulido", "arroz de mesa;arroz graneado"), (2, "Mijo pelado", None), (3, "Jugo exprimido de naranja", "zumo de naranja"), (4, "Jugo de limón concentrado", "limón exprimido"), (5, "Vinagre de manzana turbio", "vinagre de sidra"), (6, None, ";;"), (7, "Ñoquis de papa", "gnocchi")]


@pytest.mark.parametrize(
    "value, entry",
    [
        ("ARROZ GRANEADO", 1), ("arrz blanco puldo", 1), ("pulido blanco arroz - urgente", 1), ("Arr. blan.", 1), ("2 x mijo pelado (2 un)", 2), ("mijo_pelado 1 kg", 2), ("ojalá en oferta zumo de naranja!!", 3), ("limon exprimido", 4),
        ("ñoqis de papa", 7), ("Gnocchi 500 g", 7), ("vinagre de limpieza", -1), ("arroz para gatos", -1), ("asdf", -1), ("s/i", -1), ("0", -1), ("jugo", -1), ("?", -1), ("x" * 10_000, -1),
    ],
)
def test_values(value, entry):
    assert Mapper(ITEMS).map(value) == entry


def test_longest_mention_wins():
    m = Mapper([(1, "leche", None), (2, "leche de coco", None), (3, "coco", None)])
    assert [e for e, _, _ in m.mentions("la leche de coco fresca")] == [2]


def test_letters():
    assert letter_distance("abcd", "abdc", 2) == 1 and letter_distance("kitten", "sitting", 3) == 3 and letter_distance("a", "abcdef", 2) == 3
    assert likeness("tost\x01", "tostado") == 0.95 and likeness("mijo", "trigo") < 0.6


def test_operator_on_odd_rows(spark):
    df = spark.createDataFrame([(1, "mijo pelado", "a"), (1, "mijo pelado", "b"), (2, None, None), (3, "  \xa0 ", None), (None, "nada", None), (4, "mijo pelado " * 3000, None)], "id bigint, v string, k string")
    ref = spark.createDataFrame(ITEMS, "e int, n string, a string")
    got = sorted((tuple(r) for r in map_to_list(df, "t", "id", "v", ref, "e", "n", "a").collect()), key=str)
    assert got == sorted([("t", 1, 2), ("t", 1, 2), ("t", None, -1), ("t", 4, 2)], key=str)
    assert {r.e for r in map_to_list(df, "t", "id", "v", ref.limit(0), "e", "n", "a").collect()} == {-1}
    assert map_to_list(df.limit(0), "t", "id", "v", ref, "e", "n", "a").count() == 0


def test_the_index_finds_every_word_that_is_alike():
    import random

    from pricelens.llm.canonical_names import LEAST_LIKENESS, Mapper, likeness

    rng = random.Random(5)
    words = sorted({"".join(rng.choice("abcde") for _ in range(rng.randrange(2, 14))) for _ in range(300)})
    mapper = Mapper([(i, w, None) for i, w in enumerate(words)])
    for _ in range(400):
        token = list(rng.choice(words))
        for _ in range(rng.randrange(0, 4)):
            at = rng.randrange(len(token) + 1)
            token[at : at + rng.randrange(0, 2)] = rng.choice(["", "a", "x", "ea"])
        token = "".join(token) + rng.choice(["", "", "s", "\x01"])
        assert mapper._alike(token) == {w: s for w in words if (s := likeness(token, w)) >= LEAST_LIKENESS}
