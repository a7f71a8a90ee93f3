"""Numbers in texts; what can't be read is null, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _double(text: Column) -> Column:
    return F.nullif(text, F.lit("")).try_cast("double")


def number_cl(text: Column) -> Column:
    """1.234,5: dots part thousands, the comma parts decimals."""
    return _double(F.replace(F.replace(F.trim(text), F.lit("."), F.lit("")), F.lit(","), F.lit(".")))


def _without_currency(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), r"clp", ""), r"[$\s]", "")


def price_dot_decimal(text: Column) -> Column:
    """A price in which a lone dot parts decimals: 6.990 is 6.99."""
    t = _without_currency(text)
    commas, dots = F.length(t) - F.length(F.replace(t, F.lit(","), F.lit(""))), F.contains(t, F.lit("."))
    chilean = F.replace(F.replace(t, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    return _double(F.when((commas == 1) & dots, chilean).when(commas == 1, F.replace(t, F.lit(","), F.lit("."))).otherwise(F.replace(t, F.lit(","), F.lit(""))))


def price_dot_thousands(text: Column, parity: bool = False) -> Column:
    """A price in which a lone dot parts thousands: 6.990 is 6990.

    A number that was written out as a decimal (2490.0) keeps its value; with ``parity`` its dot parts thousands too.
    """
    t = _without_currency(text)
    if not parity:
        t = F.regexp_replace(t, r"^(\d+)\.0+$", "$1")
    commas, dots = F.length(t) - F.length(F.replace(t, F.lit(","), F.lit(""))), F.contains(t, F.lit("."))
    chilean = F.replace(F.replace(t, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    plain = F.replace(F.replace(t, F.lit(","), F.lit("")), F.lit("."), F.lit(""))
    return _double(F.when((commas == 1) & dots, chilean).when(commas == 1, F.replace(t, F.lit(","), F.lit("."))).otherwise(plain))


def first_amount(text: Column) -> Column:
    """The first figure of a text such as "$1.290 x kg"."""
    return price_dot_thousands(F.nullif(F.regexp_extract(text, r"([\d.,]+)", 1), F.lit("")))


def digits_only(text: Column) -> Column:
    """A whole number out of a text's digits."""
    return F.nullif(F.regexp_replace(text, r"\D", ""), F.lit("")).try_cast("bigint")


def to_number(text: Column) -> Column:
    return _double(F.trim(text))


def client_price(text: Column) -> Column:
    """As a browser reads it: dots dropped, the first comma a decimal mark, empty and null 0, the unreadable null."""
    t = F.trim(F.coalesce(text, F.lit("")))
    plain = F.regexp_replace(F.replace(t, F.lit("."), F.lit("")), r"^([^,]*),", "$1.")
    return F.when(t == "", F.lit(0.0)).otherwise(_double(plain))


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    """Part of the whole in percent, half to even; null unless the whole is positive."""
    return F.when(whole > 0, F.bround(part / whole * 100, digits))


def percent_text(value: Column) -> Column:
    """87.34 as 87,34%; null stays null."""
    return F.when(value.isNotNull(), F.replace(F.format_string("%.2f%%", value.cast("double")), F.lit("."), F.lit(",")))


def currency_text(value: Column) -> Column:
    """1234567 as $1.234.567; null stays null."""
    return F.when(value.isNotNull(), F.concat(F.lit("$"), F.replace(F.format_number(F.round(value.cast("double")), 0), F.lit(","), F.lit("."))))
