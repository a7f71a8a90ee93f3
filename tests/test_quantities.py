import math

import pytest

from pricelens.functions.quantity_text import read_content, read_unit
from pricelens.operators.quantities import standardise_quantities, whole_content


@pytest.mark.parametrize(
    "text, dimension, quantity",
    [
        ("1.000 gramos", "mass", 1000), ("1.200 kg", "mass", 1200), ("0,567 kgs", "mass", 567), ("2.268grs netos", "mass", 2268), ("12x1.000 cc", "volume", 12000),
        ("un kilo y medio", "mass", 1500), ("litro y medio", "volume", 1500), ("Pack 6 × 330 cc.", "volume", 1980), ("350 g x 4 un", "mass", 1400), ("3 un de 200 gr.", "mass", 600),
        ("pack 4 un cuarto de litro", "volume", 1000), ("4xun cuarto de litro", "volume", 1000), ("2 docenas", "unit", 24), ("media docena", "unit", 6), ("8 oz líq.", "volume", 237),
        ("16 fl. oz", "volume", 473), ("1 lb", "mass", 454), ("6 OZ", "mass", 170), ("tres cuartos de litro", "volume", 750), ("1 1/2 Lt.", "volume", 1500), ("½ kilo", "mass", 500),
        ("Cont. Neto 0.2K.", "mass", 200), ("33 cl", "volume", 330), ("500 cm3", "volume", 500), ("24Un.", "unit", 24), ("4\xa0x\xa0125\xa0gramos", "mass", 500), ("1.234,5 g", "mass", 1235),
    ],
)
def test_content(text, dimension, quantity):
    assert read_content(text) == (dimension, quantity)


@pytest.mark.parametrize("text", ["granel", "variable", "s/i", "N/A", "-", "según peso", "", "   ", "abc 12 def", "1 g", "1/0 kg", "x" * 5000])
def test_no_content(text):
    assert read_content(text) is None


def test_unit_by_dimension_of_field():
    assert read_unit("oz").dimension == "mass"
    assert read_unit("oz", "volume").dimension == "volume"
    assert read_unit("KGS").factor == 1000 and read_unit("K.").factor == 1000
    assert read_unit("zzz") is None and read_unit("") is None


def test_size_and_unit_decide():
    assert whole_content("500 g", "Kg", 0.25, "mass") == ("mass", 250)
    assert whole_content("1 un", "kilo", 0.2, "mass") == ("mass", 200)
    assert whole_content(None, None, 400.0, "mass") == ("mass", 400)
    assert whole_content("2 lbs", None, 907.0, None) == ("mass", 907)
    assert whole_content(None, "Kg", None, "mass") is None
    assert whole_content(None, "Kg", math.nan, "mass") is None
    assert whole_content("1 un", None, None, "mass") is None
    assert whole_content("1 un", None, None, "unit") == ("unit", 1)
    assert whole_content("300 g", "zzz", 5.0, None) == ("mass", 300)


def test_operator_on_odd_rows(spark):
    schema = "listing_id bigint, net_content string, unit string, size_std double, unit_family string, k string, t string"
    rows = [(1, None, None, None, None, "x", "y"), (2, "", "", float("nan"), "", None, None), (3, "1 kg", None, None, "nonsense", "a", "b"), (3, "1 kg", None, None, None, "a", "b"), (None, "2 kg", None, None, None, None, None), (5, "9" * 4000, None, None, None, None, None)]
    got = standardise_quantities(spark.createDataFrame(rows, schema)).collect()
    assert sorted([tuple(r) for r in got], key=str) == sorted([(3, "mass", 1000), (3, "mass", 1000), (None, "mass", 2000)], key=str)
    assert standardise_quantities(spark.createDataFrame([], schema)).count() == 0
