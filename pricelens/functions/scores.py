"""Scores of matches, sums of weighted cues."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pricelens.functions.text import contains_any, contains_word, words

# Weights of the cues.
TEXT_WEIGHT, BRAND_WEIGHT = 0.75, 0.25


def brand_score(a: Column, b: Column) -> Column:
    """Likeness of two cleaned brands: 0.6 if one is empty, 1 if equal, 0.9 if one holds the other, else shared words."""
    x, y = words(a), words(b)
    shared = F.size(F.array_intersect(x, y)) / F.greatest(F.size(F.array_union(x, y)), F.lit(1))
    return F.when((a == "") | (b == ""), 0.6).when(a == b, 1.0).when(F.contains(a, b) | F.contains(b, a), 0.9).otherwise(shared)


def match_score(text_similarity: Column, brand: Column) -> Column:
    return TEXT_WEIGHT * text_similarity + BRAND_WEIGHT * brand


def size_closeness(size: Column, wanted: Column, most: float) -> Column:
    """Up to ``most`` points for a size near the wanted one."""
    return F.when((size > 0) & (wanted > 0), F.greatest(F.lit(0.0), most - most * F.abs(size - wanted) / F.greatest(wanted, F.lit(1.0)))).otherwise(0.0)


def cart_score(tokens: Column, all_text: Column, name: Column, category: Column, brand: Column, same_family: Column, size: Column, wanted: Column, excluded: Column) -> Column:
    """Points of an offer for a wanted item; -999 if it is of an excluded kind or no token occurs."""
    longer = F.filter(tokens, lambda t: F.length(t) > 1)

    def hits(text: Column) -> Column:
        return F.size(F.filter(longer, lambda t: contains_word(text, t))).cast("double")

    in_all = hits(all_text)
    score = 3 * in_all + 2 * hits(name) + 5 * in_all / F.greatest(F.size(longer), F.lit(1)) + hits(category) + 0.5 * hits(brand)
    score = score + F.when(same_family, 2.0).otherwise(0.0) + size_closeness(size, wanted, 4.0)
    return F.when(contains_any(all_text, excluded) | (in_all == 0), F.lit(-999.0)).otherwise(score)


def cue_score(cues: list[tuple[Column, float]], size: Column, target: Column) -> Column:
    """The sum of the weights of the cues that hold, and up to 3 points for the size."""
    score = size_closeness(size, target, 3.0)
    for holds, weight in cues:
        score = score + F.when(holds, F.lit(float(weight))).otherwise(0.0)
    return score


def presence_score(*columns: Column) -> Column:
    """How many of the columns hold something."""
    total = F.lit(0)
    for c in columns:
        total = total + F.when(F.length(F.trim(c.cast("string"))) > 0, 1).otherwise(0)
    return total
