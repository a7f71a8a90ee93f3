"""Package contents in common units (g, ml, pieces) out of text, unit and size columns."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricelens.functions.quantity_text import UNIT, Content, half_up, in_range, read_content, read_unit

FAMILIES = ("mass", "volume", "unit")


@lru_cache(maxsize=100_000)
def _sized(size: float, unit: str | None, family: str | None) -> Content | None:
    """A size given as a number in a unit, or in g, ml or pieces of the family."""
    if not 0 < size < 1e12:
        return None
    value = Decimal(repr(size))
    if unit is not None and unit.strip():
        found = read_unit(unit, family)
        if found is None:
            return None
        dimension, total = found.dimension, value * found.factor
    elif family in FAMILIES:
        dimension, total = family, value
    else:
        return None
    return Content(dimension, half_up(total)) if in_range(dimension, total) else None


def whole_content(text: str | None, unit: str | None, size: float | None, family: str | None) -> Content | None:
    """The content that a row tells: size and unit first, then the text. A unit alone belongs to the price.

    A bare piece count in the text of something that is weighed or poured only says that it is one package.
    """
    family = family if family in FAMILIES else None
    if size is not None and size == size and (found := _sized(size, unit, family)):
        return found
    if text is None or not text.strip():
        return None
    found = read_content(text, family)
    if found and found.dimension == UNIT and family not in (None, UNIT):
        return None
    return found


def standardise_quantities(
    df: DataFrame, key: str = "listing_id", text: str = "net_content", unit: str = "unit", size: str = "size_std", family: str = "unit_family"
) -> DataFrame:
    """(key, unit_family, qty_std) of every row whose columns tell its content; one narrow pass, no shuffle.

    Null, empty or unreadable values in every column give no row; a row whose size can't be read falls back to its
    text. Repeated rows come out as often as they went in. Extra columns are ignored. Half a gram rounds up.
    """
    key_type = df.schema[key].dataType.simpleString()

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [
                whole_content(t, u, s, f)
                for t, u, s, f in zip(batch["t"], batch["u"], batch["s"], batch["f"], strict=True)
            ]
            keep = [i for i, x in enumerate(found) if x is not None]
            yield pd.DataFrame(
                {
                    key: batch["k"].to_numpy()[keep],
                    "unit_family": [found[i].dimension for i in keep],
                    "qty_std": [found[i].quantity for i in keep],
                }
            )

    told = df.where(F.col(text).isNotNull() | F.col(size).isNotNull()).select(
        F.col(key).alias("k"), F.col(text).alias("t"), F.col(unit).alias("u"), F.col(size).cast("double").alias("s"), F.col(family).alias("f")
    )
    return told.mapInPandas(measure, f"`{key}` {key_type}, unit_family string, qty_std bigint")
