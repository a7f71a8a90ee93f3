"""Quantities in words and figures: unit strings by dynamic programming over tries, contents by a small grammar.

``read_unit`` segments a unit string such as ``kgs``, ``cm3`` or ``oz líq.`` into prefix, root, plural and exponent.
Every segmentation has a score (the sum of the parts' log priors and of the prior of the dimension in that field), and
the best one counts. ``read_content`` reads a whole notation such as ``Pack 6 × 0,33 Lt.`` or ``un kilo y medio``.
"""

from __future__ import annotations

import math
import re
import unicodedata
from decimal import ROUND_HALF_UP, Decimal
from functools import lru_cache
from typing import NamedTuple

MASS, VOLUME, UNIT = "mass", "volume", "unit"

# Legal equivalents of customary units in g and ml.
POUND_G, OUNCE_G, FLUID_OUNCE_ML = Decimal("453.59237"), Decimal("28.349523125"), Decimal("29.5735295625")

# No package holds less or more than this many g or ml.
LEAST, MOST = Decimal(15), Decimal(30000)
#: Longer figures are no amounts; more pieces than this are no package.
MOST_DIGITS, MOST_PIECES = 15, Decimal(10**9)

# Prefix -> power of ten.
PREFIXES = {"": 0, "k": 3, "kilo": 3, "h": 2, "hecto": 2, "d": -1, "deci": -1, "c": -2, "centi": -2, "m": -3, "mili": -3}

# Root -> (dimension, g, ml or pieces of one, takes prefixes, log prior). "metre" only counts with an exponent.
ROOTS: dict[str, list[tuple[str, Decimal, bool, float]]] = {
    "g": [(MASS, Decimal(1), True, 0.0)],
    "gr": [(MASS, Decimal(1), True, -0.1)],
    "gramo": [(MASS, Decimal(1), True, 0.0)],
    "l": [(VOLUME, Decimal(1000), True, 0.0)],
    "lt": [(VOLUME, Decimal(1000), True, -0.1)],
    "ltr": [(VOLUME, Decimal(1000), True, -0.2)],
    "litro": [(VOLUME, Decimal(1000), True, 0.0)],
    "cc": [(VOLUME, Decimal(1), False, 0.0)],
    "m": [("metre", Decimal(100), True, -0.5)],
    "metro": [("metre", Decimal(100), True, 0.0)],
    "lb": [(MASS, POUND_G, False, 0.0)],
    "libra": [(MASS, POUND_G, False, 0.0)],
    "oz": [(MASS, OUNCE_G, False, -0.3), (VOLUME, FLUID_OUNCE_ML, False, -1.2)],
    "onza": [(MASS, OUNCE_G, False, -0.3), (VOLUME, FLUID_OUNCE_ML, False, -1.2)],
    "u": [(UNIT, Decimal(1), False, -0.2)],
    "un": [(UNIT, Decimal(1), False, 0.0)],
    "ud": [(UNIT, Decimal(1), False, 0.0)],
    "und": [(UNIT, Decimal(1), False, 0.0)],
    "unid": [(UNIT, Decimal(1), False, 0.0)],
    "unidad": [(UNIT, Decimal(1), False, 0.0)],
    "pieza": [(UNIT, Decimal(1), False, 0.0)],
    "pza": [(UNIT, Decimal(1), False, -0.1)],
    "docena": [(UNIT, Decimal(12), False, 0.0)],
    "doc": [(UNIT, Decimal(12), False, -0.2)],
}
#: A kilo of nothing is a kilogram: the root may be left out after "k" or "kilo".
ELIDED_ROOT = (MASS, Decimal(1), -0.6)
PLURALS = {"": 0.0, "s": -0.05, "es": -0.1}
EXPONENTS = {"": 1, "3": 3, "³": 3}
FLUID_MARKS = {"fl", "fluida", "fluidas", "liq", "liquida", "liquidas"}
DIMENSION_PRIOR = 2.0


class Unit(NamedTuple):
    dimension: str
    factor: Decimal


def _trie(words) -> dict:
    root: dict = {}
    for word in words:
        node = root
        for ch in word:
            node = node.setdefault(ch, {})
        node[None] = word
    return root


_TRIES = {"prefix": _trie(PREFIXES), "root": _trie(ROOTS), "plural": _trie(PLURALS), "exponent": _trie(EXPONENTS)}


def _matches(kind: str, text: str, at: int):
    """(end, word) of every word of that trie that starts at that place."""
    node = _TRIES[kind]
    if None in node:
        yield at, node[None]
    while at < len(text) and text[at] in node:
        node = node[text[at]]
        at += 1
        if None in node:
            yield at, node[None]


def fold(text: str) -> str:
    """Lower case without accents; exponents stay."""
    text = unicodedata.normalize("NFKD", text.replace("³", "3")).casefold()
    return "".join(c for c in text if not unicodedata.combining(c))


@lru_cache(maxsize=20_000)
def read_unit(text: str, dimension_hint: str | None = None) -> Unit | None:
    """The unit that a string names, or None. ``dimension_hint`` is the dimension its field should have."""
    words = re.findall(r"[a-z]+3?", fold(text).replace(".", " "))
    fluid = any(w in FLUID_MARKS for w in words)
    compact = "".join(w for w in words if w not in FLUID_MARKS)
    if not compact:
        return None
    # best[phase, place] -> list of (score, dimension, factor, power); phases follow the order of the parts
    start = [(0.0, None, Decimal(1))]
    after_prefix: dict[int, list] = {}
    for end, word in _matches("prefix", compact, 0):
        after_prefix.setdefault(end, []).extend((s - (0.1 if word else 0.0), word, f.scaleb(PREFIXES[word])) for s, _, f in start)
    after_root: dict[int, list] = {}
    for place, states in after_prefix.items():
        for score, prefix, scale in states:
            if prefix in ("k", "kilo"):
                dimension, one, prior = ELIDED_ROOT
                after_root.setdefault(place, []).append((score + prior, dimension, one * scale, scale))
            for end, word in _matches("root", compact, place):
                for dimension, one, prefixed, prior in ROOTS[word]:
                    if not prefix or prefixed:
                        after_root.setdefault(end, []).append((score + prior, dimension, one * scale, scale))
    best: tuple[float, Unit] | None = None
    for place, states in after_root.items():
        for plural_end, plural in _matches("plural", compact, place):
            for end, exponent in _matches("exponent", compact, plural_end):
                if end != len(compact):
                    continue
                for score, dimension, factor, _scale in states:
                    power = EXPONENTS[exponent]
                    if (dimension == "metre") != (power == 3):
                        continue
                    if dimension == "metre":
                        dimension, factor = VOLUME, factor**3
                    if fluid and dimension != VOLUME:
                        continue
                    score += PLURALS[plural] + (DIMENSION_PRIOR if dimension == dimension_hint else 0.0)
                    if best is None or score > best[0]:
                        best = (score, Unit(dimension, factor))
    return best[1] if best else None


# Number words and words that carry no quantity.
NUMBER_WORDS = {
    "un": 1, "una": 1, "uno": 1, "dos": 2, "tres": 3, "cuatro": 4, "cinco": 5, "seis": 6, "siete": 7, "ocho": 8, "nueve": 9, "diez": 10, "doce": 12,
}
NOISE = {"pack", "de", "del", "neto", "netos", "neta", "netas", "aprox", "aproximado", "contenido", "cont", "formato", "x", "y", "c", "cada", "por", "peso"}
NO_CONTENT = {"granel", "variable", "segun", "n/a", "s/i"}
VULGAR = {"½": "1/2", "¼": "1/4", "¾": "3/4", "⅓": "1/3"}

_TOKEN = re.compile(r"\d+/\d+|\d+(?:[.,]\d+)*|[a-z]+3?|[^\sa-z0-9]")


def _numbers(token: str) -> list[Decimal]:
    """What a figure may mean, the likelier reading first: 1.500 is fifteen hundred before it is one and a half."""
    if len(token) > MOST_DIGITS:
        return []
    if "/" in token:
        top, bottom = token.split("/")
        return [Decimal(top) / Decimal(bottom)] if int(bottom) else []
    marks = [c for c in token if c in ".,"]
    if not marks:
        return [Decimal(token)]
    if len(set(marks)) == 2:  # the last mark is the decimal one
        whole, part = re.split(r"[.,](?=\d+$)", token)
        return [Decimal(re.sub(r"[.,]", "", whole) + "." + part)]
    plain = Decimal(re.sub(r"[.,]", "", token))
    if len(marks) > 1:
        return [plain]
    whole, part = re.split(r"[.,]", token)
    decimal = Decimal(f"{whole}.{part}")
    if len(part) != 3 or whole.startswith("0"):
        return [decimal]
    return [plain, decimal] if marks[0] == "." else [decimal, plain]


class Content(NamedTuple):
    dimension: str
    quantity: int


def half_up(value: Decimal) -> int:
    return int(value.quantize(Decimal(1), ROUND_HALF_UP))


def in_range(dimension: str, total: Decimal) -> bool:
    return 0 < total <= MOST_PIECES if dimension == UNIT else LEAST <= total <= MOST


@lru_cache(maxsize=100_000)
def read_content(text: str, dimension_hint: str | None = None) -> Content | None:
    """The whole content of a package in g, ml or pieces, or None if the notation tells none."""
    for sign, plain in VULGAR.items():
        text = text.replace(sign, f" {plain} ")
    text = fold(text).replace("×", " x ").replace(" ", " ")
    text = re.sub(r"(?<=\d)\s*x\s*(?=[\da-z])|(?<=[a-z.])\s+x\s*(?=\d)", " x ", text)
    tokens = _TOKEN.findall(text)
    measures: list[tuple[str, Decimal, list[Decimal]]] = []
    counts: list[Decimal] = []
    i, after_number = 0, False

    def unit_at(k: int) -> tuple[Unit | None, int]:
        """The unit that starts at token k (over at most three words) and the token after it."""
        words: list[str] = []
        found: tuple[Unit | None, int] = (None, k)
        for j in range(k, min(k + 5, len(tokens))):
            if tokens[j] == ".":
                continue
            if not re.match(r"[a-z]", tokens[j]) or tokens[j] in ("x", "de", "y"):
                break
            words.append(tokens[j])
            if len(words) > 3:
                break
            unit = read_unit(" ".join(words), dimension_hint)
            if unit:
                found = (unit, j + 1)
        return found

    def past_dots(k: int) -> int:
        while k < len(tokens) and tokens[k] in (".", "de"):
            k += 1
        return k

    def take(values: list[Decimal], k: int) -> int:
        """Takes a number with the unit after it."""
        unit, end = unit_at(past_dots(k) if k < len(tokens) and tokens[k] == "de" else k)
        if unit is None:
            counts.append(values[0])
            return k
        while end < len(tokens) and tokens[end] == ".":
            end += 1
        if tokens[end : end + 2] == ["y", "medio"] or tokens[end : end + 2] == ["y", "media"]:
            values, end = [v + Decimal("0.5") for v in values], end + 2
        if unit.dimension == UNIT:
            counts.append(values[0] * unit.factor)
        else:
            measures.append((unit.dimension, unit.factor, values))
        return end

    unknown = False
    while i < len(tokens):
        token = tokens[i]
        if token[0].isdigit():
            values = _numbers(token)
            i += 1
            if not values:
                return None
            if "/" not in token and i < len(tokens) and "/" in tokens[i] and len(tokens[i]) > 1:
                values = [values[0] + _numbers(tokens[i])[0]] if _numbers(tokens[i]) else values
                i += 1
            i = take(values, i)
        elif token in ("medio", "media"):
            i = take([Decimal("0.5")], i + 1)
        elif token in ("cuarto", "cuartos"):
            i = take([Decimal("0.25")], past_dots(i + 1))
        elif token in NUMBER_WORDS and i + 1 < len(tokens):
            n = Decimal(NUMBER_WORDS[token])
            if tokens[i + 1] in ("cuarto", "cuartos"):
                i = take([n / 4], past_dots(i + 2))
            else:
                i = take([n], i + 1)
        elif token in NOISE or not re.match(r"[a-z]", token):
            i += 1
        else:
            unit, end = unit_at(i)
            if unit is not None and end > i:
                i = take([Decimal(1)], i)
            else:
                unknown = True
                i += 1
    if len(measures) > 1 or (unknown and not measures):
        return None
    times = Decimal(math.prod(counts)) if counts else Decimal(1)
    if measures:
        dimension, factor, values = measures[0]
        for value in values:
            if in_range(dimension, total := value * factor * times):
                return Content(dimension, half_up(total))
        return None
    return Content(UNIT, half_up(times)) if counts and in_range(UNIT, times) else None
