import pytest
from pyspark.sql import functions as F

from pricelens.functions import numbers, scores, text, units


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "function, given, wanted",
    [
        (numbers.price_dot_decimal, "$1.234,5", 1234.5), (numbers.price_dot_decimal, "6.990", 6.99), (numbers.price_dot_decimal, "1,5", 1.5), (numbers.price_dot_decimal, "1,234,567", 1234567.0),
        (numbers.price_dot_decimal, "1.234.567", None), (numbers.price_dot_decimal, None, None), (numbers.price_dot_thousands, "6.990", 6990.0), (numbers.price_dot_thousands, "2490", 2490.0),
        (numbers.price_dot_thousands, "2490.0", 2490.0), (numbers.price_dot_thousands, "1.234,5", 1234.5), (numbers.digits_only, "$ 1.290", 1290), (numbers.digits_only, "", None),
        (numbers.number_cl, "1.234,5", 1234.5), (numbers.number_cl, "x", None), (numbers.first_amount, "desde $1.290 x kg", 1290.0), (numbers.client_price, "", 0.0), (numbers.client_price, "1.234,5", 1234.5),
        (numbers.client_price, "x", None), (numbers.to_number, "12x", None),
        (text.clean_text, "Plátano  Ñandú!", "platano nandu"), (text.clean_text, "1/2-kg.", "1 2 kg"), (text.clean_text, None, ""), (text.fold_accents, "Añejo ½ ﬁn", "Anejo 1⁄2 fin"),
        (text.slug, " Frutas & Verduras ", "frutas-verduras"), (text.normal_url, "https://a.example/x/?q=1#z", "https://a.example/x"), (text.name_signature, "El pan de molde blanco", "pan molde blanco"),
        (text.stable_id, "https://a.example/p/521937400", "521937400"), (units.unit_family, " KG ", "mass"), (units.unit_family, "litro", None),
    ],
)
def test_scalar(spark, function, given, wanted):
    assert one(spark, function(F.lit(given).cast("string"))) == wanted


def test_parity_switch(spark):
    assert one(spark, numbers.price_dot_thousands(F.lit("2490.0"), parity=True)) == 24900.0


def test_percent(spark):
    assert one(spark, numbers.percent_text(F.lit(87.34))) == "87,34%" and one(spark, numbers.percent_text(F.lit(-35.86))) == "-35,86%"
    assert one(spark, numbers.percent_text(F.lit(None).cast("double"))) is None
    assert one(spark, numbers.percent(F.lit(1.0), F.lit(0.0))) is None
    assert one(spark, numbers.currency_text(F.lit(1234567.0))) == "$1.234.567"


def test_sizes(spark):
    def sim(a, b):
        return one(spark, units.similar_size(F.lit(a).cast("double"), F.lit(b).cast("double")))

    assert sim(1000, 920) and not sim(1000, 919) and sim(None, 5) and not sim(0, 5)
    assert [one(spark, units.size_bucket(F.lit(x))) for x in (50.0, 50.1, 2001.0, 0.0)] == ["0_50", "51_100", "2000_plus", None]
    assert one(spark, units.size_in_text(F.lit("pack 6 un 1,5 l"))).asDict() == {"size": 1500.0, "family": "volume"}
    assert one(spark, units.size_in_text(F.lit("harina 1 kilo"))).asDict() == {"size": 1000.0, "family": "mass"}
    assert one(spark, units.size_in_text(F.lit("pan"))).asDict() == {"size": None, "family": None}
    assert one(spark, units.size_in_text(F.lit("pan x 6"))).asDict() == {"size": None, "family": None}
    assert one(spark, units.size_by_pattern(F.lit("galletas x 6"))).asDict() == {"size": 6.0, "family": "unit"}
    assert one(spark, units.size_by_pattern(F.lit("pack 6 un 1,5 l"))).asDict() == {"size": 1500.0, "family": "volume"}
    assert one(spark, units.family_or_named(F.lit("pote"), F.lit("te 20 un"))) == "unit"
    assert one(spark, units.size_or_named(F.lit("1,5"), F.lit("KG"), F.lit("x 6"))) == 1500.0
    assert one(spark, units.size_or_named(F.lit(None).cast("string"), F.lit("kg"), F.lit("x 6"))) == 6.0
    assert one(spark, units.content_or_named(F.lit("x"), F.lit("kg"), F.lit("2 lts"))).asDict() == {"size": 2000.0, "family": "volume"}


def test_patterns(spark):
    assert one(spark, text.name_patterns(F.lit("aceite de maravilla y palta con sal"))) == ["aceite", "maravilla", "palta"]
    assert one(spark, text.name_patterns(F.lit("te"))) == ["te"]
    assert one(spark, text.has_strong_token(F.lit("te verde"), F.array(F.lit("te"), F.lit("verde")))) is True
    assert one(spark, text.has_strong_token(F.lit("te negro"), F.array(F.lit("te"), F.lit("verde")))) is False
    assert one(spark, text.has_strong_token(F.lit("mate"), F.array(F.lit("te")))) is True
    assert one(spark, units.item_cost(F.lit(2.0), F.lit(0.0), F.lit(990.0))) == 990.0
    assert one(spark, units.comparable_price(F.lit(100.0), F.lit(200.0), F.lit(500.0))) == 250.0


def test_words_and_substrings(spark):
    phrases = F.array(F.lit("pet"))
    assert one(spark, text.contains_any(F.lit("petit beurre"), phrases)) and not one(spark, text.contains_any_word(F.lit("petit beurre"), phrases))
    assert one(spark, text.matches_search(F.lit("Azúcar rubia"), F.lit("rubia de AZÚCAR")))
    assert not one(spark, text.matches_search(F.lit("Azúcar rubia"), F.lit("azucar")))
    assert one(spark, text.matches_search(F.lit("Azúcar rubia"), F.lit("azucar"), True))


@pytest.mark.parametrize("a, b, score", [("", "x", 0.6), ("a", "a", 1.0), ("nestle", "nestle gold", 0.9), ("a b", "b c", 1 / 3)])
def test_brands(spark, a, b, score):
    assert one(spark, scores.brand_score(F.lit(a), F.lit(b))) == pytest.approx(score)
