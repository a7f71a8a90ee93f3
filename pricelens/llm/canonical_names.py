"""Freely typed values mapped to the entries of a reference list.

An automaton over the canonical names and aliases finds every mention inside a value in one reading; of overlapping
mentions the longest wins. What it leaves over goes to token-set similarity: each token of the value is aligned with
the token of an entry's form that it most resembles (alike, abbreviated, or a few letters apart), and weighted shares of
aligned tokens on both sides decide. A value that resembles no form well enough, or two entries alike, names none.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator
from typing import NamedTuple

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricelens.session import spread

NOT_IN_LIST = -1
#: Least weighted share of a value's tokens, and of the form's, that must be aligned; least lead over the next entry.
LEAST_OF_VALUE, LEAST_OF_FORM, LEAST_LEAD = 0.72, 0.2, 0.02
#: The reference list is held by every worker; a longer list than this isn't what this operator is for.
MOST_ENTRIES = 1_000_000

# Words that carry no name.
STOP_WORDS = set("de del la el los las en con para y al a o por un una".split())
# Words of remarks beside a name.
REMARKS = set(
    "barato barata baratos urgente urgentes comprar compra falta faltan faltaba ojala oferta ofertas cualquier marca propia almuerzo semana cena desayuno hoy manana favor porfa "
    "gracias ojo grande chico chica rico rica fresco pack bolsa caja paquete unidad unidades un und kg kgs kilo kilos g gr grs gramos ml cc cl l lt lts litro litros medio cuarto "
    "media docena docenas x".split()
)


def normal(text: str) -> str:
    """Small letters without accents; a dot stays at the end of a shortened word; the rest becomes blanks."""
    text = unicodedata.normalize("NFKD", text).casefold()
    text = "".join(c for c in text if not unicodedata.combining(c))
    text = re.sub(r"(?<=[a-z])\.(?!\w)|(?<=[a-z]{3})\.(?=[a-z])", "\x01 ", text)
    return re.sub(r"[^a-z0-9\x01]+", " ", text).strip()


def letter_distance(a: str, b: str, most: int) -> int:
    """Insertions, deletions, replacements and swaps of neighbours between two words; most + 1 if more than that."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, last = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            cost = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, before[j - 2] + 1)
            row.append(cost)
        if min(row) > most:
            return most + 1
        before, last = last, row
    return last[-1]


def most_edits(n: int) -> int:
    """How many edits two words may differ by, the longer of which has n letters."""
    return 1 if n <= 4 else 2 if n <= 8 else 3


#: Keys are made of so many letters at the front of a word; more edits than that two words never differ by.
KEY_LETTERS = 7


def cut_keys(word: str, most: int) -> set[str]:
    """The front of a word with up to ``most`` letters left out; two words that few edits apart share one of these."""
    keys = last = {word[:KEY_LETTERS]}
    for _ in range(most):
        last = {k[:i] + k[i + 1 :] for k in last for i in range(len(k))}
        keys = keys | last
    return keys


def edits_to_longer(n: int) -> int:
    """How many edits a word of n letters and one that is longer by no more may differ by."""
    return max(d for m in range(n, n + 4) if (d := most_edits(m)) >= m - n)


def likeness(token: str, word: str) -> float:
    """How much a typed token resembles a word of the list, 0 to 1."""
    short = token.endswith("\x01")
    token = token.rstrip("\x01")
    if token == word:
        return 1.0
    if not token or not word:
        return 0.0
    if short and len(token) >= 2 and word.startswith(token):
        return 0.95
    if len(token) >= 4 and len(word) > len(token) and word.startswith(token):
        return 0.85
    if word + "s" == token or word + "es" == token or token + "s" == word:
        return 0.97
    n = max(len(token), len(word))
    if n < 3 or min(len(token), len(word)) < 2:
        return 0.0
    most = most_edits(n)
    d = letter_distance(token, word, most)
    if short and d > most and len(token) >= 4:  # a shortened word may be misspelt too
        d = letter_distance(token, word[: len(token)], 1) + 1
        most = 2
    return 0.0 if d > most else 1.0 - d / n - (0.05 if token[0] != word[0] else 0.0)


LEAST_LIKENESS = 0.6


class Form(NamedTuple):
    entry: int
    tokens: tuple[str, ...]
    canonical: bool


class Mapper:
    """The list's automaton, forms and token weights; one serves a worker for all its values."""

    def __init__(self, entries: list[tuple[int, str | None, str | None]]):
        self.forms: list[Form] = []
        self.automaton = ahocorasick.Automaton()
        owners: dict[str, set[int]] = {}
        for entry, name, aliases in entries:
            for k, form in enumerate([name or "", *(aliases or "").split(";")]):
                text = normal(form).replace("\x01", "")
                if not text:
                    continue
                owners.setdefault(f" {text} ", set()).add(entry)
                tokens = tuple(dict.fromkeys(w for w in text.split() if w not in STOP_WORDS))
                if tokens:
                    self.forms.append(Form(entry, tokens, k == 0))
        for text, who in owners.items():
            if len(who) == 1:  # a form of two entries names neither
                self.automaton.add_word(text, (next(iter(who)), len(text) - 1))
        self.has_words = len(self.automaton) > 0
        if self.has_words:
            self.automaton.make_automaton()
        used: dict[str, set[int]] = {}
        for form in self.forms:
            for token in form.tokens:
                used.setdefault(token, set()).add(form.entry)
        everyone = max(1, len({f.entry for f in self.forms}))
        self.weight = {t: 1.0 + math.log(everyone / len(who)) for t, who in used.items()}
        self.usual_weight = sum(self.weight.values()) / len(self.weight) if self.weight else 1.0
        self.of_token: dict[str, list[int]] = {}
        for i, form in enumerate(self.forms):
            for token in form.tokens:
                self.of_token.setdefault(token, []).append(i)
        self.words = sorted(self.weight)
        self.near: dict[str, list[str]] = {}
        for word in self.words:
            for key in cut_keys(word, edits_to_longer(len(word))):
                self.near.setdefault(key, []).append(word)
        # by a misspelt shortening: a slip in the first four letters and more
        self.fronts: dict[str, list[str]] = {}
        for word in self.words:
            for key in {k for n in range(4, KEY_LETTERS + 1) for k in cut_keys(word[:n], 1)}:
                self.fronts.setdefault(key, []).append(word)
        self.alike: dict[str, dict[str, float]] = {}
        self.known: dict[str, int] = {}

    def _alike(self, token: str) -> dict[str, float]:
        found = self.alike.get(token)
        if found is None:
            if len(self.alike) > 200_000:
                self.alike.clear()
            # only words that may be alike: that share a key, that the token is the front of, or that are its singular or plural
            plain, short = token.rstrip("\x01"), token.endswith("\x01")
            near = {w for key in cut_keys(plain, edits_to_longer(len(plain))) for w in self.near.get(key, ())}
            near |= {w for w in (plain[:-1], plain[:-2], plain + "s") if w in self.weight}
            if short:
                near |= {w for key in cut_keys(plain, 1) for w in self.fronts.get(key, ())}
            at = bisect_left(self.words, plain)
            while at < len(self.words) and self.words[at].startswith(plain):
                near.add(self.words[at])
                at += 1
            found = {w: s for w in near if (s := likeness(token, w)) >= LEAST_LIKENESS}
            self.alike[token] = found
        return found

    def mentions(self, text: str) -> list[tuple[int, int, int]]:
        """(entry, start, end) of the longest mentions that don't overlap."""
        if not self.has_words:
            return []
        found = [(end - size + 1, end, entry) for end, (entry, size) in self.automaton.iter(f" {text} ")]
        taken: list[tuple[int, int, int]] = []
        for a, b, entry in sorted(found, key=lambda x: (x[0] - x[1], x[0])):
            if all(b <= c or a >= d for _, c, d in taken):
                taken.append((entry, a, b))
        return taken

    def map(self, value: str) -> int:
        """The entry that a value names, or NOT_IN_LIST."""
        found = self.known.get(value)
        if found is None:
            if len(self.known) > 200_000:
                self.known.clear()
            found = self.known[value] = self._map(normal(value))
        return found

    def _map(self, text: str) -> int:
        plain = text.replace("\x01", "")
        mentioned = self.mentions(plain)
        if mentioned:
            longest = max(b - a for _, a, b in mentioned)
            named = {entry for entry, a, b in mentioned if b - a == longest}
            covered = sum(b - a for _, a, b in mentioned)
            strange = sum(len(t) + 1 for t in self._names(plain) if not self._alike(t))
            if len(named) == 1 and strange < covered:
                return named.pop()
        return self._by_tokens(self._names(text))

    @staticmethod
    def _names(text: str) -> list[str]:
        """The tokens that may be part of a name: neither stop words nor remarks nor amounts."""
        return list(dict.fromkeys(t for t in text.split() if t.rstrip("\x01") not in STOP_WORDS and t.rstrip("\x01") not in REMARKS and not re.fullmatch(r"x?\d+(?:kg|g|gr|cc|ml|l|lt|un|x)?\x01?", t)))

    def _by_tokens(self, tokens: list[str]) -> int:
        alike = {t: self._alike(t) for t in tokens}
        total = sum(max((self.weight[w] for w in found), default=self.usual_weight) for found in alike.values())
        best: dict[int, float] = {}
        for i in {i for found in alike.values() for w in found for i in self.of_token[w]}:
            form = self.forms[i]
            pairs = sorted(((alike[t].get(w, 0.0), t, w) for t in tokens for w in form.tokens), reverse=True)
            used: set[str] = set()
            got_value = got_form = likeness_sum = 0.0
            for s, t, w in pairs:
                if s < LEAST_LIKENESS:
                    break
                if "<" + t in used or ">" + w in used:
                    continue
                used |= {"<" + t, ">" + w}
                got_value += max(self.weight[x] for x in alike[t]) * s
                got_form += self.weight[w]
                likeness_sum += s * self.weight[w]
            of_value, of_form = got_value / total, got_form / sum(self.weight[w] for w in form.tokens)
            if of_value < LEAST_OF_VALUE or of_form < LEAST_OF_FORM:
                continue
            score = 0.7 * of_value + 0.3 * likeness_sum / sum(self.weight[w] for w in form.tokens)
            score += 0.03 * (form.canonical and any("<" + t in used and alike[t].get(form.tokens[0], 0) >= LEAST_LIKENESS for t in tokens[:1]))
            best[form.entry] = max(best.get(form.entry, 0.0), score)
        ranked = sorted(best.items(), key=lambda x: -x[1])
        if not ranked or (len(ranked) > 1 and ranked[0][1] - ranked[1][1] < LEAST_LEAD):
            return NOT_IN_LIST
        return ranked[0][0]


_mappers: dict[int, Mapper] = {}


def _mapper(entries: list[tuple[int, str | None, str | None]]) -> Mapper:
    """The mapper of a list, made once a worker process."""
    number = hash(tuple(entries))
    if number not in _mappers:
        _mappers.clear()
        _mappers[number] = Mapper(entries)
    return _mappers[number]


def map_to_list(df: DataFrame, table_name: str, key: str, value: str, reference: DataFrame, entry: str, name: str, alias: str) -> DataFrame:
    """(tabla, fila_id, entry) of every value that isn't null or blank; entry is -1 if the value names none.

    ``reference`` is a list of fixed size (checked against MOST_ENTRIES) and goes to every worker; the values are mapped
    where they lie, each distinct one once a worker: no shuffle, however skewed their frequencies. An empty list maps
    every value to -1; null names and aliases of the list are passed over; very long values are read whole; repeated
    rows each give their own; extra columns are ignored.
    """
    entries = [tuple(r) for r in reference.select(F.col(entry).cast("bigint"), F.col(name), F.col(alias)).where(F.col(entry).isNotNull()).limit(MOST_ENTRIES + 1).collect()]
    if len(entries) > MOST_ENTRIES:
        raise ValueError(f"the reference list has more than {MOST_ENTRIES} entries")
    entries.sort()
    shared = df.sparkSession.sparkContext.broadcast(entries)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mapper = _mapper(shared.value)
        for batch in batches:
            yield pd.DataFrame({"tabla": table_name, "fila_id": batch["k"], entry: [mapper.map(v) for v in batch["v"]]})

    typed = df.where(F.col(value).rlike(r"(?U)\S")).select(F.col(key).cast("bigint").alias("k"), F.col(value).alias("v"))
    return spread(typed).mapInPandas(work, f"tabla string, fila_id bigint, `{entry}` bigint")
