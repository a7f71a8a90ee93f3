import pytest

from pricelens.llm.encoding_repair import find_damaged, restore, search, trusted_words

CLEAN = [
    "Champiñones 1ª Calidad", "5 € Menos Café", "½ Precio 2da Unidad", "N° 5", "São Tomé", "Açaí", "MAÇÃ", "Forêt", "Smörgås", "Über", "Â.M.", "Pack 4 × 350 g", "¿Qué? ¡Sí!", "café", "Piña",
    "ATÚN", "(±2%)", "plain ascii", "Menú del día: cazuela, postre y jugo", "NELOSASÍ",
]
ORIGINALS = ["Selección Andina", "KÉTCHUP BALSÁMICO", "Jamón & Cía", "Lasaña N° 5", "ATÚN EN LATA", "Té Helado ½ Precio", "5 € Menos"]
DAMAGE = {
    "once": lambda t: t.encode().decode("latin-1"),
    "twice": lambda t: t.encode().decode("latin-1").encode().decode("latin-1"),
    "mac": lambda t: t.encode().decode("mac_roman"),
    "dos": lambda t: t.encode().decode("cp850"),
    "cyrillic": lambda t: t.encode().decode("cp1251"),
}


@pytest.mark.parametrize("text", CLEAN)
def test_clean_texts_stay(text):
    assert restore(text) is None


@pytest.mark.parametrize("kind", DAMAGE)
@pytest.mark.parametrize("text", ORIGINALS)
def test_round_trip(text, kind):
    try:
        damaged = DAMAGE[kind](text)
    except UnicodeError:
        pytest.skip("can't be damaged so")
    assert damaged != text and restore(damaged) == text


@pytest.mark.parametrize("damaged, text", [("CafÚ molido", "Café molido"), ("Lim¾n", "Limón"), ("Org·nico", "Orgánico"), ("AliÒos", "Aliños"), ("LASA—A", "LASAÑA"), ("SELECCIﾃ哲", "SELECCIÓN"), ("jamﾃｳn", "jamón"), ("Café, TÃ©", "Café, Té"), ("Pi&ntilde;a", "Piña")])
def test_single_cases(damaged, text):
    assert restore(damaged) == text


@pytest.mark.parametrize("lost", ["T?RTOLA", "C?a", "Lim�n", "Caf? molido", "Caf?", "5 ? Menos", "Ã³ y �"])
def test_lost_characters(lost):
    assert restore(lost) == ""


def test_lexicon_tells_readings_apart():
    words = trusted_words({"forêt": 50, "café": 90, "cafú": 3})
    assert "forêt" in words and "cafú" not in words
    assert search("ForÛt", words)[0] == "Forêt"


def test_operator_on_odd_rows(spark):
    rows = [(1, "JamÃ³n", None, "x"), (1, "JamÃ³n", "T?RTOLA", None), (2, None, "", None), (None, "ok", "Lim¾n", None), (3, "Ã±" * 3000, "abc " * 50_000, None)]
    df = spark.createDataFrame(rows, "id bigint, name string, valor string, campo string")
    got = sorted((tuple(r) for r in find_damaged(df, "t", "id", ["name", "valor"]).collect()), key=str)
    assert got == sorted([("t", 1, "name", "Jamón"), ("t", 1, "name", "Jamón"), ("t", 1, "valor", ""), ("t", None, "valor", "Limón"), ("t", 3, "name", "ñ" * 3000)], key=str)
    assert find_damaged(spark.createDataFrame([], "id bigint, name string"), "t", "id", ["name"]).count() == 0


@pytest.mark.parametrize("text", ["Sm\u00f8rrebr\u00f8d", "Arroz \u2265 1 kg", "\u0152ufs", "2 \u00b5g", "\u0141oso\u015b w\u0119dzony", "\u03a0\u03af\u03c4\u03b1", "Mate \u8336 verde", "\u0412\u043e\u0434\u043a\u0430", "P\u00e3o de queijo \u2615", "Jalape\u00f1o\u2019s"])
@pytest.mark.parametrize("lexicon", [frozenset(), frozenset({"jalape\u00f1o", "caf\u00e9", "\u00fa"})])
def test_rare_letters_are_no_damage(text, lexicon):
    assert restore(text, lexicon) is None


def test_many_damaged_words_of_several_kinds():
    """Twelve words, damaged in three ways, with no word known: the search has no cap to end by."""
    words = ["Pl\u00e1tano", "Pi\u00f1a", "Caf\u00e9", "Az\u00facar", "Ma\u00edz", "At\u00fan", "Jam\u00f3n", "Pur\u00e9", "\u00d1oquis", "Man\u00ed", "Or\u00e9gano", "Lim\u00f3n"]
    damage = [lambda w: w.encode().decode("cp1252", "replace"), lambda w: w.encode().decode("mac_roman"), lambda w: w.encode().decode("cp850")]
    broken = [damage[i % 3](w) for i, w in enumerate(words)]
    assert restore(" ".join(broken)) in (" ".join(words), "") or all("\ufffd" in b for b in broken)
    whole = [w for w, b in zip(words, broken, strict=True) if "\ufffd" not in b]
    assert restore(" ".join(b for b in broken if "\ufffd" not in b)) == " ".join(whole) and len(whole) >= 11
