"""Units and sizes of packages by fixed spellings, as Column -> Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pricelens.functions.numbers import price_dot_thousands

# Spellings of the units and their factor to g, ml or pieces.
FAMILIES = {"mass": ["kg", "g", "gr"], "volume": ["l", "lt", "ml", "cc"], "unit": ["un", "unidad", "unidades"]}
FACTORS = {"kg": 1000.0, "l": 1000.0, "lt": 1000.0, "g": 1.0, "gr": 1.0, "ml": 1.0, "cc": 1.0, "un": 1.0, "unidad": 1.0, "unidades": 1.0}
# Further spellings that texts use.
LONG_NAMES = {"kilo": "kg", "kilos": "kg", "gramo": "g", "gramos": "g", "lts": "lt", "litro": "l", "litros": "l"}
# Upper ends of the size buckets, and the name of what lies beyond.
BUCKETS, BEYOND = [50, 100, 250, 500, 1000, 2000], "2000_plus"


def _plain(unit: Column) -> Column:
    return F.lower(F.trim(unit))


def unit_family(unit: Column) -> Column:
    """mass, volume or unit; null for any other spelling."""
    u = _plain(unit)
    found = F
    for family, spellings in FAMILIES.items():
        found = found.when(u.isin(spellings), F.lit(family))
    return found


def to_standard(value: Column, unit: Column) -> Column:
    """A value in g, ml or pieces; null for an unknown unit."""
    u = _plain(unit)
    found = F
    for factor in sorted(set(FACTORS.values())):
        found = found.when(u.isin([s for s, f in FACTORS.items() if f == factor]), value * factor)
    return found


def size_bucket(size: Column) -> Column:
    """The bucket of a size: up to 50, 100, 250, 500, 1000, 2000 or more; null unless positive."""
    found, low = F.when(size.isNull() | (size <= 0), None), 0
    for high in BUCKETS:
        found = found.when(size <= high, F.lit(f"{low}_{high}"))
        low = high + 1
    return found.otherwise(F.lit(BEYOND))


def similar_size(a: Column, b: Column, tolerance: float = 0.08) -> Column:
    """Sizes that differ by at most that share of the larger; an unknown size fits any, one that isn't positive none."""
    return F.when(a.isNull() | b.isNull(), True).when((a <= 0) | (b <= 0), False).otherwise(F.abs(a - b) / F.greatest(a, b) <= tolerance)


def _lookup(table: dict, key: Column) -> Column:
    """The value of a key in a fixed table; null for any other."""
    pairs = [F.lit(x) for pair in table.items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), key)


def _size(amount: Column, written: Column) -> Column:
    """struct(size, family) of an amount and the unit written behind it; nulls where either is missing."""
    unit = F.coalesce(_lookup(LONG_NAMES, written), written)
    family = _lookup({s: f for f, spellings in FAMILIES.items() for s in spellings}, unit)
    size = amount * _lookup(FACTORS, unit)
    return F.struct(size.alias("size"), F.when(size.isNotNull(), family).alias("family"))


def size_in_text(cleaned: Column) -> Column:
    """struct(size, family) of the last amount with a unit in a cleaned text that kept dots and commas (both decimal marks)."""
    spellings = "|".join(sorted([*LONG_NAMES, *FACTORS], key=len, reverse=True))
    found = F.regexp_extract_all(cleaned, F.lit(rf"(\d+(?:[.,]\d+)?)\s*({spellings})\b"), 0)
    last = F.try_element_at(found, F.lit(-1))
    amount = F.replace(F.regexp_extract(last, r"^(\d+(?:[.,]\d+)?)", 1), F.lit(","), F.lit(".")).try_cast("double")
    return _size(amount, F.regexp_extract(last, r"([a-z]+)$", 1))


def size_by_pattern(cleaned: Column, parity: bool = False) -> Column:
    """struct(size, family) of the first amount with a unit of mass or volume, else of pieces, else of "x 6".

    With ``parity`` a lone dot in the amount parts thousands, as for prices.
    """
    measured, counted, times = r"(\d+(?:[.,]\d+)?)\s*(kg|gr|g|lt|l|ml|cc)\b", r"\b(\d+)\s*(unidades|unidad|un)\b", r"\bx\s*(\d+)\b"

    def number(text: Column) -> Column:
        return price_dot_thousands(text, parity=True) if parity else F.nullif(F.replace(text, F.lit(","), F.lit(".")), F.lit("")).try_cast("double")

    pieces = F.regexp_extract(cleaned, times, 1)
    return (
        F.when(cleaned.rlike(measured), _size(number(F.regexp_extract(cleaned, measured, 1)), F.regexp_extract(cleaned, measured, 2)))
        .when(cleaned.rlike(counted), _size(number(F.regexp_extract(cleaned, counted, 1)), F.lit("un")))
        .otherwise(_size(number(pieces), F.lit("un")))
    )


def family_or_named(unit: Column, cleaned_name: Column, parity: bool = False) -> Column:
    """The family of a row's unit, else that of the amount in its name."""
    return F.coalesce(unit_family(unit), size_by_pattern(cleaned_name, parity)["family"])


def size_or_named(content: Column, unit: Column, cleaned_name: Column, parity: bool = False) -> Column:
    """The content in the row's unit where both are known, else the amount in its name."""
    return F.coalesce(to_standard(price_dot_thousands(content, parity), unit), size_by_pattern(cleaned_name, parity)["size"])


def content_or_named(content: Column, unit: Column, cleaned_name: Column) -> Column:
    """struct(size, family): content and unit of the row, or both out of its name where they tell no size."""
    size = to_standard(F.replace(content, F.lit(","), F.lit(".")).try_cast("double"), unit)
    return F.when(size.isNotNull(), F.struct(size.alias("size"), unit_family(unit).alias("family"))).otherwise(size_in_text(cleaned_name))


def price_per_unit(price: Column, size: Column) -> Column:
    return F.when((size > 0) & price.isNotNull(), price / size)


def effective_price(list_price: Column, price: Column) -> Column:
    """The list price rules where there is one."""
    return F.coalesce(list_price, price)


def month_quantity(daily: Column, days: int = 30) -> Column:
    return daily * days


def item_cost(unit_price: Column, quantity: Column, pack_price: Column) -> Column:
    """Unit price times quantity where both are known and the quantity is positive, else the price of a pack."""
    return F.when(unit_price.isNotNull() & (quantity > 0), unit_price * quantity).otherwise(pack_price)


def comparable_price(price: Column, size: Column, target: Column) -> Column:
    """The price of the target size at this package's price."""
    return F.when((size > 0) & (target > 0), price * target / size)
