"""Listings of the same product, whatever their wording, by bipartite term-pair reinforcement.

1. Each listing becomes its content in common units, its brand and a set of terms (misspelt words count as the frequent
   word one letter away; "sin", "con" and "en" stick to the word behind them).
2. Terms that the listings of one item, brand and content don't agree on say nothing about a product (offers, packings,
   slips) and are left out; what is left of a listing is its wording.
3. Two wordings of a kind form a pair if they share enough of their terms or meet in a cell: a brand and content that
   listings of both have. Pairs and what they share weigh each other in turn: a pair scores by the weight of the terms
   and cells that it shares; a term or cell weighs the mean score of the pairs that share it, a term less where pairs
   that do match lack it on one side, so that a cell of several products and a word that comes and goes count little.
   This runs until the weights stay; every pair whose words are over the threshold with these weights is among the
   pairs. Within a kind of product a term counts by its rarity there, so that what all of the kind have tells nothing.
4. Pairs over the threshold link the rarer wording to its best commoner one; the trees are the kinds and varieties.
   Listings of one tree, brand and content are one product.

All steps are Spark tables; wordings, not listings, are compared. Sellers' article numbers are not looked at, so that
they can be held against the result.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from functools import lru_cache
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pricelens.functions.quantity_text import PREFIXES, ROOTS, read_content, read_unit
from pricelens.llm.canonical_names import letter_distance
from pricelens.llm.encoding_repair import search
from pricelens.operators.quantities import whole_content
from pricelens.session import Stage

#: A word is a slip of another if that one is a letter away and so many times commoner.
SLIP_RATIO = 8
#: Brands are rarer and more alike than words: a brand seen more than twice must be so many times rarer to be a slip.
BRAND_SLIP_RATIO = 60
#: A word of a name may be a misspelt brand if names have the brand so many times as often.
WORD_RATIO = 20
#: A term is noise if its agreement within cells lies less than this far between chance (0) and certainty (1).
LEAST_CONSTANT = 0.05
#: Noise whose spread over basket items differs from that of all listings by less than this (in nats) is an offer or packing.
EVEN_SPREAD = 0.33
#: What is known of so many words goes to all workers, of more by a join; more phrases of offers than this are an error.
MOST_SENT_WORDS, MOST_PHRASES = 500_000, 100_000
#: Least rarity of a term that its whole kind has.
LEAST_RARITY = 0.02
#: How many listings' worth the score of the words is when it meets the evidence of the cells.
PRIOR_LISTINGS = 3.0
THRESHOLD, LEAST_CHANGE, STEP = 0.6, 0.01, 1.0
#: A round over up to so many pairs and nodes is done in one task, over more in many.
MOST_IN_ONE_PART = 100_000
#: Trees of up to so many wordings go to the listings by broadcast, more by a join.
MOST_BROADCAST_WORDINGS = 100_000

# Words that carry no attribute, legal forms and titles of brands, words that stick to the next one.
FILLERS = set("de y a la lo el del al los las x un una por".split())
BRAND_TITLES = set("don dona hnos hermanos cia ca s a sa ltda spa".split())
STICKY = {"sin": "sin_", "con": "con_", "en": "en_", "zero": "sin_", "0": "sin_", "0pct": "sin_", "cero": "sin_"}
JOINED = ("en", "sin", "con")

_WORD = re.compile(r"[a-z]+|\d+(?:[.,]\d+)*(?:pct)?")
_UNITS = {p + r + s for r in ROOTS for p in PREFIXES for s in ("", "s", "es")} | {"k", "kilo", "kilos", "fl", "liq"}
_AMOUNT = set("pack medio media cuarto cuartos un dos tres cuatro cinco seis docena docenas".split())
_TELLING = _UNITS | _AMOUNT | {"numero", "x"}  # words that may belong to an amount; all others stand for themselves
_LOST = re.compile("(?<=[a-z])[?\ufffd](?=[a-z])|(?<=[a-z])[?\ufffd]\\B")
_WITHOUT, _WITH = re.compile(r"\bs/\s?"), re.compile(r"\bc/\s?")
_PERCENT, _NUMBER, _FIRST = re.compile(r"(\d)\s?%"), re.compile(r"n(?:(?<=\bn)[°º.]?\s?(?=\d)|°\s?)"), re.compile(r"(\d)\s?[ªa]\b")
_INITIALS, _TIMES, _AND_A_HALF = re.compile(r"\b([a-z])\.\s?([a-z])\."), re.compile(r"(\d)\s?x\s?(?=\d|medi|cuarto|un\b)"), re.compile(r"\b(?:un )?(?:kilo|litro) y medio\b")
_GLUED = re.compile(r"(\d)([a-z]+)\b")

_PLAIN = {chr(c): unicodedata.normalize("NFKD", chr(c))[0] for c in range(0xC0, 0x180) if unicodedata.decomposition(chr(c))}
_BEYOND_ASCII = re.compile(r"[^\x00-\x7f]")


def fold(text: str) -> str:
    """Small letters without accents."""
    text = text.casefold()
    if text.isascii():
        return text
    text = _BEYOND_ASCII.sub(lambda m: _PLAIN.get(m[0], m[0]), text)
    if text.isascii():
        return text
    text = unicodedata.normalize("NFKD", text)
    return "".join(c for c in text if not unicodedata.combining(c))


_ODD = re.compile(r"[^\x00-\x7fáéíóúüñÁÉÍÓÚÜÑ¡½€×°ª]")
_repaired: dict[str, str] = {}


def repaired(name: str) -> str:
    """A name with its wrongly decoded words restored, each distinct word once a worker."""
    if name.isascii() or not _ODD.search(name):
        return name
    words = name.split(" ")
    for i, w in enumerate(words):
        if not w.isascii() and _ODD.search(w):
            found = _repaired.get(w)
            if found is None:
                if len(_repaired) > 200_000:
                    _repaired.clear()
                found = _repaired[w] = search(w)[0]
            words[i] = found
    return " ".join(words)


def words_of(name: str) -> tuple[list[str], list[str]]:
    """The words of a name that don't tell an amount, and those that do."""
    text = fold(repaired(name))
    if "?" in text or "\ufffd" in text:
        text = _LOST.sub("", text)
    if "×" in text:
        text = text.replace("×", " x ")
    if "/" in text:
        text = _WITH.sub(" con ", _WITHOUT.sub(" sin ", text))
    if "%" in text:
        text = _PERCENT.sub(r"\1pct ", text)
    if "n" in text:
        text = _NUMBER.sub(" numero ", text)
    if "ª" in text or "a" in text:
        text = _FIRST.sub(r"\1 primera ", text)
    if "." in text:
        text = _INITIALS.sub(r"\1\2 ", text)
    if " y medio" in text:
        text = _AND_A_HALF.sub(" ", text)
    if "x" in text:
        text = _TIMES.sub(r"\1 x ", text)
    if "pct" in text:  # else figures and letters part anyway
        text = _GLUED.sub(lambda m: m[0] if m[2] == "pct" else f"{m[1]} {m[2]}", text)
    tokens = _WORD.findall(text)
    words, amount = [], []
    i, n = 0, len(tokens)
    while i < n:
        t = tokens[i]
        if t.isalpha() and t not in _TELLING:
            words.append(t)
            i += 1
            continue
        nxt = tokens[i + 1] if i + 1 < n else ""
        if t == "numero" and nxt[:1].isdigit():
            words.append("n" + nxt)
            i += 2
        elif t[0].isdigit() and not t.endswith("pct"):
            if t == "0" and nxt and nxt not in _UNITS and not nxt[0].isdigit():
                words.append(t)
            elif t == "1" and (nxt == "primera" or (words and words[-1] == "cal")):
                words.append("1primera") if nxt == "primera" else words.append("1")
                i += nxt == "primera"
            else:
                amount.append(t)
            i += 1
        elif t in _UNITS and (len(t) > 1 or t in "gklu") and (amount and i and (tokens[i - 1][0].isdigit() or tokens[i - 1] in _AMOUNT or tokens[i - 1] in _UNITS or tokens[i - 1] == "de")):
            amount.append(t)
            i += 1
        elif t in _AMOUNT and (nxt in _UNITS or nxt in _AMOUNT or nxt == "de" or nxt[:1].isdigit() or t == "pack") or (t in ("un", "x") and amount):
            amount.append(t)
            i += 1
        else:
            words.append(t)
            i += 1
    return words, amount


_CONTENT = re.compile(r"(?:pack )?(?:\d[\d.,/]*(?: \d+/\d+)? ?(?:x|un de|un) ?)?(?:\d[\d.,/]*(?: \d+/\d+)?|(?:(?:un |tres )?cuartos? de|medi[oa]|un|dos|tres|cuatro|cinco)) ?[a-z]+\.?(?: liq\.?|\.? ?oz\b)?(?: y medio)?(?: x ?\d+)?|\b(?:kilo|litro) y medio\b")


def content_in_name(name: str, family: str | None) -> str | None:
    """The content that a name tells, for listings whose columns don't."""
    text = re.sub(r"\s+", " ", fold(name).replace("×", "x"))
    best = None
    for m in sorted(_CONTENT.finditer(text), key=lambda m: -len(m[0])):
        words = re.findall(r"[a-z]+", m[0])
        if not any(read_unit(w) for w in words if w != "un"):
            if not re.search(r"\d ?un\b", m[0]):
                continue
        got = read_content(m[0].strip(), family)
        if got and (best is None or (best.dimension == "unit" != got.dimension)):
            best = got
    return f"{best.dimension}:{best.quantity}" if best else None


_STICK = rf"\b({'|'.join(JOINED)}) (\S+)"


_RUN_TOGETHER = re.compile(r"(?<=[a-z])(?=[A-Z])")


@lru_cache(maxsize=100_000)
def _brand_words(brand: str | None) -> str:
    return " ".join(w for w in re.findall(r"[a-z]+", fold(_RUN_TOGETHER.sub(" ", brand or ""))) if w not in BRAND_TITLES)


class Lexicon(NamedTuple):
    """What is known of the words that a listing has; words that it lacks are terms as they stand."""

    spelling: dict[str, str]  # a misspelt word -> the word meant
    brand_of: dict[str, str]  # a word of a name that is a brand -> that brand
    brand_spelling: dict[str, str]  # a misspelt brand -> the brand meant
    even: set[str]  # words of offers and packings
    phrases: set[tuple[str, str]]  # words side by side, one of them even, that belong together
    noise: set[str]  # terms that listings of one content and brand don't agree on


def terms_of(words: Iterable[str], known: Lexicon) -> tuple[list[str], str | None]:
    """The terms of a name's words in order, and the first brand among them.

    Words that tell no product are left out, and so are words that stand beside one of these as a rule.
    """
    canonical: list[str | None] = []
    brand = None
    for w in words:
        b = known.brand_of.get(w)
        if b is not None:
            brand = brand or b
            canonical.append(None)
        elif w not in FILLERS:
            canonical.append(known.spelling.get(w, w))
        elif w == "de":
            canonical.append(w)
    told: list[str | None] = []
    plain = [c for c in canonical if c is not None and c != "de"]
    i = -1
    for c in canonical:
        if c is not None and c != "de":
            i += 1
            after_sticky = i > 0 and plain[i - 1] in JOINED
            if (c in known.even and not after_sticky) or (i and (plain[i - 1], c) in known.phrases) or (i + 1 < len(plain) and (c, plain[i + 1]) in known.phrases):
                continue
        told.append(c)
    out: list[str] = []
    i, n = 0, len(told)
    while i < n:
        t = told[i]
        nxt = told[i + 1] if i + 1 < n else None
        if t is None or t == "de":
            pass
        elif t in STICKY:
            if nxt is not None and nxt != "de" and nxt not in BRAND_TITLES:
                out.append(STICKY[t] + nxt)
                i += 1
            elif t in ("zero", "cero"):
                out.append(t)
        elif t == "libre" and nxt == "de" and i + 2 < n and told[i + 2]:
            out.append("sin_" + told[i + 2])
            i += 2
        elif nxt == "free":
            out.append(t + "_free")
            i += 1
        elif t not in BRAND_TITLES and len(t) > 1:
            out.append(t)
        i += 1
    return [t for t in out if t not in known.noise], brand


def _base(term: Column) -> Column:
    """The word in a term that sticks to a preposition."""
    return F.regexp_replace(term, r"^(?:sin|con|en)_|_free$", "")


def _parse(df: DataFrame, stage: Stage) -> DataFrame:
    """Content, words and brand words of each listing."""
    schema = "listing_id bigint, item string, words string, brand_words string, content string"

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            words_out, brand_out, content_out = [], [], []
            for name, brand, text, unit, size, family in zip(*[b[c].tolist() for c in ("name", "brand", "net_content", "unit", "size_std", "unit_family")], strict=True):
                name = name or ""
                got = whole_content(text, unit, size, family)
                words_out.append(" ".join(words_of(name)[0]))
                brand_out.append(_brand_words(brand))
                content_out.append(f"{got.dimension}:{got.quantity}" if got else content_in_name(repaired(name), family))
            yield pd.DataFrame({"listing_id": b["listing_id"], "item": b["cba_name"], "words": words_out, "brand_words": brand_out, "content": content_out})

    source = df.select(F.col("listing_id").cast("bigint"), "name", "brand", "net_content", "unit", F.col("size_std").cast("double").alias("size_std"), "unit_family", "cba_name")
    return stage.cut(source.mapInPandas(read, schema))


# what the words are: tables over all listings


def _cell() -> Column:
    """A hash of item, brand and content, null where one of these is."""
    return F.when(F.col("item").isNotNull() & (F.col("brand_words") != "") & F.col("content").isNotNull(), F.xxhash64("item", F.substring_index("brand_words", " ", 1), "content"))


def _stuck_terms() -> Column:
    """The distinct terms of a name's words."""
    padded = F.concat(F.lit(" "), F.col("words"))
    sticky = F.contains(padded, F.lit(f" {JOINED[0]} "))
    for word in JOINED[1:]:
        sticky = sticky | F.contains(padded, F.lit(f" {word} "))
    return F.array_distinct(F.split(F.when(sticky, F.regexp_replace("words", _STICK, "$1_$2")).otherwise(F.col("words")), " "))


def _judged_terms(parsed: DataFrame, stage: Stage) -> tuple[DataFrame, DataFrame]:
    """(term, item, k) and (term, total, even, noise).

    A term is noise if the listings of one cell share it hardly more often than any two do by chance: a variety comes
    back with the next listing of the product, an offer, a packing or a slip doesn't. Noise that is spread evenly over all basket items is
    the wording of an offer or a packing.
    """
    told = parsed.where("words <> ''")
    # few items and words: sums within partitions first
    of_item = stage.cut(told.select(F.coalesce("item", F.lit("")).alias("item"), F.explode(_stuck_terms()).alias("term")).groupBy("term", "item").agg(F.count("*").alias("k")))
    in_cells = told.select(_cell().alias("cell"), F.explode(_stuck_terms()).alias("term")).where("cell is not null").groupBy("cell", "term").agg(F.count("*").alias("k"))
    sizes = parsed.select(_cell().alias("cell")).where("cell is not null").groupBy("cell").agg(F.count("*").alias("n")).where("n > 1")
    shared = in_cells.join(sizes, "cell").groupBy("term").agg(F.sum(F.col("k") * (F.col("k") - 1)).alias("same"), F.sum(F.col("k") * (F.col("n") - 1)).alias("chances"))
    prior = parsed.groupBy(F.coalesce("item", F.lit("")).alias("item")).agg(F.count("*").alias("m"))
    prior = prior.withColumn("listings", F.sum("m").over(Window.partitionBy(F.lit(1)))).select("item", (F.col("m") / F.col("listings")).alias("p"), "listings")
    totals = of_item.groupBy("term").agg(F.sum("k").alias("total"))
    share = F.col("k") / F.col("total")
    spread = of_item.join(totals, "term").join(prior, "item").groupBy("term", "total", "listings").agg((F.sum(share * F.log(share / F.col("p"))) - (F.count("*") - 1) / (2 * F.first("total"))).alias("spread"))
    by_chance = F.least(F.lit(1.0), F.col("total") / F.col("listings"))
    agreed = F.try_divide(F.col("same") - by_chance * F.col("chances"), (1 - by_chance) * F.col("chances"))
    judged = spread.join(shared, "term", "left").withColumn("noise", F.coalesce(agreed < LEAST_CONSTANT, F.lit(False)))
    function_words = F.col("term").isin([*STICKY, *FILLERS])
    return of_item, stage.cut(judged.select("term", "total", (F.col("noise") & (F.col("spread") < EVEN_SPREAD) & ~function_words).alias("even"), (F.col("noise") & ~function_words).alias("noise")))


def _slips(words: DataFrame, targets: DataFrame, least_length: int, often: Column) -> DataFrame:
    """(w, meant): words (w, n) a letter away from a target (w, n) that is ``often`` times as common, the commonest."""

    def keyed(counts: DataFrame) -> DataFrame:
        plain = counts.where((F.length("w") >= least_length) & F.col("w").rlike("^[a-z]+$"))
        cuts = F.transform(F.sequence(F.lit(1), F.length("w")), lambda i: F.concat(F.col("w").substr(F.lit(1), i - 1), F.col("w").substr(i + 1, F.length("w"))))
        return plain.select("w", "n", F.explode(F.array_distinct(F.concat(F.array("w"), cuts))).alias("key"))

    near = keyed(words).join(keyed(targets).toDF("meant", "times", "key"), "key").where((F.col("w") != F.col("meant")) & (F.col("times") >= often * F.col("n")))
    near = near.select("w", "meant", "times").distinct()

    def close(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b[[letter_distance(x, y, 1) <= 1 for x, y in zip(b["w"], b["meant"], strict=True)]]

    return near.mapInPandas(close, near.schema).groupBy("w").agg(F.max_by("meant", F.struct("times", "meant")).alias("meant"))


def _lexicon(parsed: DataFrame, judged: DataFrame, stage: Stage) -> tuple[DataFrame, set[tuple[str, str]]]:
    """(w, spelling, brand, brand_spelling, even, noise) of every word that isn't a plain term, and the phrases."""
    brands = stage.cut(parsed.where("brand_words <> ''").select(F.explode(F.split("brand_words", " ")).alias("w")).groupBy("w").agg(F.count("*").alias("n")))
    stems = judged.select(F.explode(F.array_distinct(F.array("term", _base(F.col("term"))))).alias("w"), "total").groupBy("w").agg(F.sum("total").alias("n"))
    words = stage.cut(stems)
    brand_slips = stage.cut(_slips(brands, brands, 5, F.when(F.col("n") <= 2, SLIP_RATIO).otherwise(BRAND_SLIP_RATIO)))
    # a brand is no slip of another, and no word that names have far more often
    own = brands.join(brand_slips, "w", "left_anti").where("length(w) > 3").join(words.withColumnRenamed("n", "in_names"), "w", "left")
    known = stage.cut(own.where(F.col("n") * WORD_RATIO >= F.coalesce("in_names", F.lit(0))).select("w", F.greatest("n", F.coalesce("in_names", F.lit(1))).alias("n")))
    others = words.join(known, "w", "left_anti")
    as_brand = _slips(others.where("length(w) >= 6"), known, 5, F.when(F.col("n") <= 2, SLIP_RATIO).otherwise(WORD_RATIO)).withColumnRenamed("meant", "brand")
    as_brand = known.select("w", F.col("w").alias("brand")).union(as_brand)
    spelling = _slips(others, others, 4, F.lit(SLIP_RATIO)).withColumnRenamed("meant", "spelling")
    flags = judged.where("noise").select(F.col("term").alias("w"), "even", "noise")
    found = as_brand.join(spelling, "w", "full").join(brand_slips.withColumnRenamed("meant", "brand_spelling"), "w", "full").join(flags, "w", "full").fillna(False, ["even", "noise"])
    info = stage.cut(found.select("w", "spelling", "brand", "brand_spelling", "even", "noise"))
    # words that stand beside an even one as a rule belong to its phrase there
    spoken = F.array_except(F.split("words", " "), F.array(*[F.lit(w) for w in sorted(FILLERS)]))
    beside = parsed.select(spoken.alias("ws")).where("size(ws) > 1").select(F.explode(F.arrays_zip(F.expr("slice(ws, 1, size(ws) - 1)").alias("u"), F.expr("slice(ws, 2, size(ws) - 1)").alias("v"))).alias("x"))
    beside = beside.groupBy(F.col("x.u").alias("u"), F.col("x.v").alias("v")).agg(F.count("*").alias("n"))
    even = judged.where("even").select("term", "total")
    one = even.select(F.col("term").alias("u"), F.col("total").alias("nu"))
    two = even.select(F.col("term").alias("v"), F.col("total").alias("nv"))
    mixed = beside.join(one, "u", "left").join(two, "v", "left").where(F.col("nu").isNull() != F.col("nv").isNull()).where(F.col("n") >= 0.3 * F.coalesce("nu", "nv"))
    phrases = {(r["u"], r["v"]) for r in mixed.limit(MOST_PHRASES + 1).collect()}
    if len(phrases) > MOST_PHRASES:
        raise ValueError(f"the listings have more than {MOST_PHRASES} phrases of offers")
    return info, phrases


INFO = ["w", "spelling", "brand", "brand_spelling", "even", "noise"]


def _as_lexicon(rows: Iterable[tuple], phrases: set[tuple[str, str]]) -> Lexicon:
    known = Lexicon({}, {}, {}, set(), phrases, set())
    for w, spelling, brand, brand_spelling, even, noise in rows:
        if spelling:
            known.spelling[w] = spelling
        if brand:
            known.brand_of[w] = brand
        if brand_spelling:
            known.brand_spelling[w] = brand_spelling
        if even:
            known.even.add(w)
        if noise:
            known.noise.add(w)
    return known


def _word(rows: Iterable[tuple[str, str]], known: Lexicon) -> Iterator[tuple[str, str | None]]:
    """Wording and brand of each (words, brand words)."""
    for text, brand_words in rows:
        terms, in_name = terms_of(text.split(), known)
        given = [known.brand_spelling.get(w, w) for w in brand_words.split()]
        brand = next((w for w in given if w in known.brand_of), None) or in_name or max(given, key=len, default=None)
        yield " ".join(sorted(set(terms))), brand


def _wordings(parsed: DataFrame, info: DataFrame, phrases: set[tuple[str, str]], stage: Stage, most_sent: int = MOST_SENT_WORDS) -> DataFrame:
    """Each listing's content, brand and wording (its attribute terms, sorted).

    What is known of words goes to all workers if it is up to ``most_sent`` words; else each distinct text is joined
    with what is known of its own words.
    """
    schema = "listing_id bigint, content string, name bigint, brand string, wording string"
    columns = parsed.select("listing_id", "content", "words", "brand_words", F.xxhash64("words").alias("name"))
    if info.count() <= most_sent:
        shared = parsed.sparkSession.sparkContext.broadcast(([tuple(r) for r in info.select(*INFO).collect()], phrases))

        def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            known = _as_lexicon(*shared.value)
            for b in batches:
                got = list(_word(zip(b["words"].tolist(), b["brand_words"].tolist(), strict=True), known))
                yield pd.DataFrame({"listing_id": b["listing_id"], "content": b["content"], "name": b["name"], "brand": [x[1] for x in got], "wording": [x[0] for x in got]})

        return stage.cut(columns.mapInPandas(work, schema))

    stuck = F.concat_ws(" ", "words", F.regexp_replace("words", _STICK, "$1_$2"), "brand_words")
    texts = columns.select("words", "brand_words").distinct().withColumn("t", F.xxhash64("words", "brand_words"))
    told = texts.select("t", F.explode(F.array_distinct(F.split(stuck, " "))).alias("w")).join(info, "w").groupBy("t").agg(F.collect_list(F.struct(*INFO)).alias("known"))

    def work_each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = []
            for text, brand_words, rows in zip(b["words"], b["brand_words"], b["known"], strict=True):
                lexicon = _as_lexicon([tuple(r.values()) if isinstance(r, dict) else tuple(r) for r in (rows if rows is not None else [])], phrases)
                got += _word([(text, brand_words)], lexicon)
            yield pd.DataFrame({"words": b["words"], "brand_words": b["brand_words"], "brand": [x[1] for x in got], "wording": [x[0] for x in got]})

    worded = texts.join(told, "t", "left").select("words", "brand_words", "known").mapInPandas(work_each, "words string, brand_words string, brand string, wording string")
    return stage.cut(columns.join(worded, ["words", "brand_words"]).select("listing_id", "content", "name", "brand", "wording"))


def _kinds(worded: DataFrame, of_item: DataFrame, judged: DataFrame, parsed: DataFrame, stage: Stage) -> DataFrame:
    """(wording, n, kind): the basket item that a wording's terms speak for, or ''."""
    wordings = stage.cut(worded.where("wording <> ''").groupBy("wording").agg(F.count("*").alias("n")))
    totals = judged.select("term", "total")
    each = wordings.select("wording", F.explode(F.split("wording", " ")).alias("t"))
    spoken = each.join(totals.withColumnRenamed("term", "t"), "t", "left").select("wording", F.when(F.col("total").isNull(), _base(F.col("t"))).otherwise(F.col("t")).alias("term"))
    prior = parsed.groupBy("item").agg(F.count("*").alias("m")).where("item is not null")
    prior = prior.withColumn("p", F.col("m") / F.sum("m").over(Window.partitionBy(F.lit(1)))).select("item", "p")
    words = spoken.groupBy("wording").agg(F.count("*").alias("words"))
    says = spoken.join(of_item.where("item <> ''"), "term").join(prior, "item").groupBy("wording", "item", "p").agg(F.sum(F.log((F.col("k") + 0.5 * F.col("p")) / (0.5 * F.col("p")))).alias("gain"))
    says = says.join(words, "wording").withColumn("says", F.col("gain") + F.col("words") * (F.log(F.lit(0.5)) + 0.5 * F.log("p")))
    best = says.groupBy("wording").agg(F.max_by("item", F.struct("says", "item")).alias("kind"))
    return stage.cut(wordings.join(best, "wording", "left").select("wording", "n", F.coalesce("kind", F.lit("")).alias("kind")))


# reinforcement


def _difference(a: str, b: str) -> Column:
    """What each of two wordings has that the other lacks, in an order that doesn't depend on theirs."""
    x, y = F.split(a, " "), F.split(b, " ")
    one, two = F.array_join(F.array_except(x, y), " "), F.array_join(F.array_except(y, x), " ")
    return F.concat_ws(" | ", F.least(one, two), F.greatest(one, two))


def _rewritten(sizes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs of wordings, in any kind, that differ as wordings of one cell do elsewhere."""
    seen = pairs.select("difference").distinct()
    sides = F.split("difference", r" \| ")
    one, two = F.split(sides[0], " "), F.split(sides[1], " ")
    ways = seen.select(one.alias("old"), two.alias("new")).union(seen.select(two.alias("old"), one.alias("new")))
    ways = ways.where((F.element_at("old", 1) != "") & (F.element_at("new", 1) != "")).withColumn("term", F.element_at("old", 1))
    worded = sizes.select("kind", "wording", F.split("wording", " ").alias("terms")).withColumn("term", F.explode("terms"))
    fits = F.size(F.array_except("old", "terms")) == 0
    other = F.array_join(F.array_sort(F.array_union(F.array_except("terms", "old"), F.col("new"))), " ")
    made = worded.join(ways, "term").where(fits & (F.size(F.array_intersect("new", "terms")) == 0)).select("kind", "wording", other.alias("other")).distinct()
    there = made.join(sizes.select("kind", F.col("wording").alias("other")), ["kind", "other"])
    return there.select("kind", F.least("wording", "other").alias("w1"), F.greatest("wording", "other").alias("w2")).distinct()


def _over_threshold(sizes: DataFrame, rarity: DataFrame, weights: DataFrame | None) -> DataFrame:
    """(kind, w1, w2) of every two wordings of a kind that score THRESHOLD or more with these weights (1 where unknown).

    A pair's score is at most its shared terms' mass over that of either side. With a kind's terms in one order, rarest
    first, the first term that a pair over the threshold shares has, with those behind it, THRESHOLD of the mass of
    either side; so it is enough to join on such terms, and frequent ones are among them only where there is no rarer.
    """
    split = sizes.select("kind", "wording", F.explode(F.array_distinct(F.split("wording", " "))).alias("term")).join(rarity, ["kind", "term"])
    weight = F.lit(1.0) if weights is None else F.coalesce("weight", F.lit(1.0))
    massed = (split if weights is None else split.join(weights, "term", "left")).withColumn("mass", weight * F.col("rarity"))
    whole = Window.partitionBy("kind", "wording")
    behind = F.sum("mass").over(whole.orderBy("rarity", "term").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    own = massed.select("kind", "wording", "term", "mass", F.sum("mass").over(whole).alias("all"), behind.alias("behind"))
    least = THRESHOLD - 1e-9
    asks = own.where(F.col("behind") >= least * F.col("all")).select("kind", "term", "wording", "all")
    close = (F.col("w1") < F.col("w2")) & (F.least("all1", "all2") >= least * F.greatest("all1", "all2"))
    met = asks.toDF("kind", "term", "w1", "all1").join(asks.toDF("kind", "term", "w2", "all2"), ["kind", "term"]).where(close).select("kind", "w1", "w2", "all1", "all2").distinct()
    masses = own.groupBy("kind", "wording").agg(F.map_from_entries(F.collect_list(F.struct("term", "mass"))).alias("masses"))
    held = met.join(masses.toDF("kind", "w1", "m1"), ["kind", "w1"]).join(masses.toDF("kind", "w2", "m2"), ["kind", "w2"])
    shared = F.aggregate(F.map_values(F.map_filter("m1", lambda t, _: F.map_contains_key("m2", t))), F.lit(0.0), lambda x, m: x + m)
    return held.withColumn("shared", shared).where(F.col("shared") >= least * (F.col("all1") + F.col("all2") - F.col("shared"))).select("kind", "w1", "w2")


class Graph(NamedTuple):
    """Pairs of wordings of one kind and what they share: terms, and the cells (brand and content) of their listings.

    Cells that hold the same wordings as often are one node, ``cells`` of them. A listing meets any other of its cell
    with equal chance, so that it counts once, however many there are.
    """

    pairs: DataFrame  # pair, kind, w1, w2, n1, n2, difference
    shares: DataFrame  # pair, node, shared, mass, met, cells: a term with its rarity; or cells, and how many listings of the one wording meet the other there
    stays: DataFrame  # kind, wording, node, twos, all: in these cells, listings that meet one of their own wording, and all
    nodes: DataFrame  # node, own: in such a cell, listings that meet one of their own wording
    small: bool  # so few pairs and nodes that a round is one task's work, without exchanges

    def held(self, df: DataFrame) -> DataFrame:
        """A table of the graph in one part, if it is small; else as it comes."""
        return _in_one_part(df) if self.small else df

    def sent(self, df: DataFrame) -> DataFrame:
        """A table to be joined with one of the graph's; in one part both, neither moves."""
        return df.coalesce(1).hint("shuffle_hash") if self.small else df


@contextmanager
def _rounds_of(graph: Graph) -> Iterator[None]:
    """While the rounds over a small graph run, plans know one part only and are made once."""
    wanted = {"spark.sql.shuffle.partitions": "1", "spark.sql.adaptive.enabled": "false"} if graph.small else {}
    conf = graph.pairs.sparkSession.conf
    before = {k: conf.get(k) for k in wanted}
    try:
        for k, v in wanted.items():
            conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            conf.set(k, v)


def _in_one_part(df: DataFrame) -> DataFrame:
    one = df.coalesce(1)
    one._stage_path = getattr(df, "_stage_path", None)
    return one


def _contexts(worded: DataFrame, kinds: DataFrame, stage: Stage) -> DataFrame:
    """(kind, node, cells, n, wording, a): the wordings of each kind of cell that has two differing names or more."""
    told = worded.where((F.col("wording") != "") & F.col("brand").isNotNull() & F.col("content").isNotNull())
    told = told.select("wording", F.xxhash64("brand", "content").alias("of"), "name").distinct()  # an offer captured twice says nothing new
    counted = told.groupBy("wording", "of").agg(F.count("*").alias("a")).join(kinds.select("wording", "kind"), "wording")
    counted = stage.cut(counted.select("kind", "wording", "a", F.xxhash64("kind", "of").alias("cell")))
    looks = counted.groupBy("kind", "cell").agg(F.sum("a").alias("n"), F.bit_xor(F.xxhash64("wording", "a")).alias("x"), F.bit_xor(F.xxhash64("a", "wording")).alias("y")).where("n > 1")
    nodes = looks.groupBy(F.xxhash64("kind", "x", "y").alias("node")).agg(F.count("*").alias("cells"), F.min("cell").alias("cell"), F.min("n").alias("n"))
    return stage.cut(counted.join(nodes, "cell").select(counted["kind"], "node", "cells", "n", "wording", "a"))


def _meetings(contexts: DataFrame, sizes: DataFrame, stage: Stage) -> tuple[DataFrame, DataFrame]:
    """Where which wordings meet, and (kind, w1, w2) of every two that meet in a cell or differ as such a pair does."""
    sides = [contexts.select("kind", "node", "cells", "n", F.col("wording").alias(f"w{i}"), F.col("a").alias(f"a{i}")) for i in (1, 2)]
    met = sides[0].join(sides[1].drop("cells", "n"), ["kind", "node"]).where("w1 < w2")
    met = stage.cut(met.select(F.xxhash64("kind", "w1", "w2").alias("pair"), "kind", "w1", "w2", "node", "cells", (F.col("a1") * F.col("a2") / (F.col("n") - 1)).alias("ab")))
    beside = met.select("kind", "w1", "w2").distinct()
    beside = stage.cut(beside)
    return met, stage.cut(beside.union(_rewritten(sizes, beside.withColumn("difference", _difference("w1", "w2")))).distinct())


def _paired(candidates: DataFrame, sizes: DataFrame, rarity: DataFrame, stage: Stage) -> tuple[DataFrame, DataFrame]:
    """The pairs of a graph out of candidates (kind, w1, w2), and what they share of terms."""
    a, b = sizes.select("kind", F.col("wording").alias("w1"), F.col("n").alias("n1")), sizes.select("kind", F.col("wording").alias("w2"), F.col("n").alias("n2"))
    pairs = candidates.join(a, ["kind", "w1"]).join(b, ["kind", "w2"])
    pairs = stage.cut(pairs.select(F.xxhash64("kind", "w1", "w2").alias("pair"), "kind", "w1", "w2", "n1", "n2", _difference("w1", "w2").alias("difference")))
    x, y = F.split("w1", " "), F.split("w2", " ")
    terms = pairs.select("pair", "kind", F.explode(F.array_union(x, y)).alias("term"), F.array_intersect(x, y).alias("common")).join(rarity, ["kind", "term"])
    return pairs, terms.select("pair", F.xxhash64("term").alias("node"), F.array_contains("common", F.col("term")).alias("shared"), F.col("rarity").alias("mass"), F.lit(0.0).alias("met"), F.lit(0.0).alias("cells"))


def _graph(contexts: DataFrame, met: DataFrame, candidates: DataFrame, sizes: DataFrame, rarity: DataFrame, stage: Stage) -> Graph:
    """The graph of the candidates (kind, w1, w2), which hold all pairs that meet."""
    pairs, terms = _paired(candidates, sizes, rarity, stage)
    cells = met.select("pair", "node", F.lit(True).alias("shared"), F.lit(0.0).alias("mass"), F.col("ab").alias("met"), F.col("cells").cast("double").alias("cells"))
    shares = stage.cut(terms.union(cells))
    stays = stage.cut(contexts.select("kind", "wording", "node", (F.col("cells") * F.col("a") * (F.col("a") - 1) / (F.col("n") - 1)).alias("twos"), (F.col("cells") * F.col("a")).cast("double").alias("all")))
    own = contexts.groupBy("node").agg(F.sum(F.col("a") * (F.col("a") - 1) / (F.col("n") - 1)).alias("own"))
    nodes = stage.cut(shares.select("node").distinct().join(own, "node", "full").fillna(0.0, ["own"]))
    small = max(pairs.count(), nodes.count()) <= MOST_IN_ONE_PART
    return Graph(*[_in_one_part(t) if small else t for t in (pairs, shares, stays, nodes)], small)


def _scores(graph: Graph, weights: DataFrame) -> DataFrame:
    """The pairs' scores, given the weights of terms and cells.

    By its words a pair scores the weight of the shared terms over that of all its terms. By its cells it scores where
    the number of listings of the rarer wording that meet the commoner one lies between what chance gives (0) and what
    there were if they were of that wording, too, and met it as often as its own listings do (1). This is worth as many
    listings as it takes to tell these two apart: cells that hold every wording tell nothing, however many they are. As
    far as it is worth something the pair's own cells count, then those of all pairs of the same difference, then words.
    """
    weight = weights.select("node", "weight")
    mass = F.col("weight") * F.col("mass")
    by_words = F.coalesce(F.try_divide(F.sum(F.when(F.col("shared"), mass).otherwise(0.0)), F.sum(mass)), F.lit(0.0))
    shares = graph.held(graph.shares.join(graph.sent(weight), "node")).groupBy("pair").agg(by_words.alias("words"), F.sum(F.col("cells") * F.col("weight") * F.col("met")).alias("met"))
    stays = graph.held(graph.stays.join(graph.sent(weight), "node")).groupBy("kind", "wording").agg(F.sum(F.col("weight") * F.col("twos")).alias("stay"), F.sum(F.col("weight") * F.col("all")).alias("all"))
    stays = stays.withColumn("part", F.col("all") / F.sum("all").over(Window.partitionBy("kind")))
    one, two = stays.toDF("kind", "w1", "stay1", "all1", "part1"), stays.toDF("kind", "w2", "stay2", "all2", "part2")
    known = graph.held(graph.pairs.join(graph.sent(shares), "pair"))
    known = graph.held(graph.held(known.join(graph.sent(one), ["kind", "w1"], "left")).join(graph.sent(two), ["kind", "w2"], "left"))
    first = F.col("n1") >= F.col("n2")
    alike = F.when(first, F.try_divide(F.col("all2") * F.col("stay1"), F.col("all1"))).otherwise(F.try_divide(F.col("all1") * F.col("stay2"), F.col("all2")))
    chance = F.when(first, F.col("all2") * F.col("part1")).otherwise(F.col("all1") * F.col("part2"))
    known = known.withColumn("alike", alike).withColumn("chance", chance).withColumn("lead", F.col("alike") - F.col("chance"))
    told = known.withColumn("worth", F.when(F.col("lead") > 0, F.col("lead") * F.col("lead") / F.col("alike")).otherwise(0.0))
    told = told.withColumn("gain", F.when(F.col("lead") > 0, (F.col("met") - F.col("chance")) * F.col("lead") / F.col("alike")).otherwise(0.0))
    told = told.select(*graph.pairs.columns, "words", "met", "alike", "chance", "worth", "gain")

    def share(gain: Column, worth: Column, prior: Column) -> Column:
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (gain + PRIOR_LISTINGS * prior) / (worth + PRIOR_LISTINGS)))

    told = graph.held(told)
    usual = told.groupBy("difference").agg(share(F.sum("gain"), F.sum("worth"), F.avg("words")).alias("usual"))
    return told.join(graph.sent(usual), "difference").withColumn("score", share(F.col("gain"), F.col("worth"), F.col("usual")))


def _weights(graph: Graph, scores: DataFrame, old: DataFrame) -> DataFrame:
    """(node, own, weight, change): a term weighs the mean score of the pairs that share it, less where pairs that match
    lack it on one side; a cell weighs the mean score of two of its listings. Each moves most of the way, so that none
    swings."""
    is_cell = F.col("cells") > 0
    good = F.when(is_cell, 2 * F.col("met") * F.col("score")).when(F.col("shared"), F.col("score")).otherwise(0.0)
    whole = F.when(is_cell, 2 * F.col("met")).when(F.col("shared"), 1.0).otherwise(F.col("score"))
    sums = graph.held(graph.shares.join(graph.sent(scores), "pair")).groupBy("node").agg(F.sum(good).alias("good"), F.sum(whole).alias("whole"))
    fresh = F.greatest(F.coalesce(F.try_divide(F.coalesce("good", F.lit(0.0)) + F.col("own"), F.coalesce("whole", F.lit(0.0)) + F.col("own")), F.lit(0.0)), F.lit(0.01))
    known = old.join(graph.sent(sums), "node", "left").withColumn("fresh", fresh)
    return known.select("node", "own", (F.col("weight") + STEP * (F.col("fresh") - F.col("weight"))).alias("weight"), F.abs(F.col("fresh") - F.col("weight")).alias("change"))


def _settled(graph: Graph, stage: Stage) -> tuple[DataFrame, int]:
    """The weights after these have settled, and the rounds it took."""
    with _rounds_of(graph):
        weights, rounds = graph.held(stage.cut(graph.nodes.withColumn("weight", F.lit(1.0)))), 0
        while True:
            rounds += 1
            scores, seen = graph.held(stage.cut(_scores(graph, weights).select("pair", "score"))), Observation()
            fresh = stage.cut(_weights(graph, scores, weights).observe(seen, F.max("change").alias("change")))
            stage.drop(weights, scores)
            weights, change = graph.held(fresh), seen.get["change"]
            if change is None or change < LEAST_CHANGE:
                return weights, rounds


def _rarity(sizes: DataFrame, stage: Stage) -> DataFrame:
    """(kind, term, rarity): what all of a kind have tells nothing."""
    whole = sizes.groupBy("kind").agg(F.sum("n").alias("all"))
    having = sizes.select("kind", "n", F.explode(F.split("wording", " ")).alias("term")).groupBy("kind", "term").agg(F.sum("n").alias("having"))
    return stage.cut(having.join(whole, "kind").select("kind", "term", F.greatest(F.log(F.col("all") / F.col("having")), F.lit(LEAST_RARITY)).alias("rarity")))


def _linked(worded: DataFrame, sizes: DataFrame, stage: Stage) -> DataFrame:
    """Scores of the pairs, among them every pair of a kind whose words are over the threshold with the settled weights."""
    rarity, contexts = _rarity(sizes, stage), _contexts(worded, sizes, stage)
    near = stage.cut(_over_threshold(sizes, rarity, None))
    met, candidates = _meetings(contexts, sizes, stage)
    candidates = candidates.union(near).distinct()
    graph = _graph(contexts, met, candidates, sizes, rarity, stage)
    weights, _ = _settled(graph, stage)
    by_term = rarity.select("term").distinct().select("term", F.xxhash64("term").alias("node")).join(weights.select("node", "weight"), "node").select("term", "weight")
    missed = stage.cut(_over_threshold(sizes, rarity, by_term).join(candidates, ["kind", "w1", "w2"], "left_anti"))
    if not missed.isEmpty():
        pairs, terms = _paired(missed, sizes, rarity, stage)  # they meet nowhere, else they were candidates
        terms = stage.cut(terms)
        graph = graph._replace(pairs=graph.held(graph.pairs.union(pairs)), shares=graph.held(graph.shares.union(terms)))
        fresh = terms.select("node").distinct().join(weights, "node", "left_anti").withColumn("weight", F.lit(1.0))
        weights = graph.held(weights.select("node", "weight").union(fresh))
    with _rounds_of(graph):
        return stage.cut(_scores(graph, weights))


def _trees(scored: DataFrame, stage: Stage) -> DataFrame:
    """(kind, wording, root): each wording with the commonest one of its tree; wordings that link to none are left out."""
    links = scored.where(F.col("score") >= THRESHOLD)
    first_rarer = (F.col("n1") < F.col("n2")) | ((F.col("n1") == F.col("n2")) & (F.col("w1") > F.col("w2")))
    up = links.select(
        "kind",
        F.when(first_rarer, F.col("w1")).otherwise(F.col("w2")).alias("wording"),
        F.when(first_rarer, F.col("w2")).otherwise(F.col("w1")).alias("up"),
        F.struct(F.round("score", 1), "worth", F.greatest("n1", "n2"), F.when(first_rarer, F.col("w2")).otherwise(F.col("w1"))).alias("best"),
    )
    parents = stage.cut(up.groupBy("kind", "wording").agg(F.max_by("up", "best").alias("root")))
    while True:  # each round halves the height
        above = parents.select("kind", F.col("wording").alias("root"), F.col("root").alias("higher"))
        jumped = stage.cut(parents.join(above, ["kind", "root"], "left").select("kind", "wording", F.coalesce("higher", "root").alias("root"), F.col("higher").isNotNull().alias("moved")))
        moved = jumped.where("moved").limit(1).count()
        stage.drop(parents)
        parents = jumped.drop("moved")
        parents._stage_path = jumped._stage_path
        if not moved:
            return parents


def label_products(df: DataFrame) -> DataFrame:
    """(listing_id, p1, p2) of every listing whose product can be told; equal (p1, p2) mean the same product.

    The label is a 128-bit hash of kind and variety, brand and content. Null, empty or unreadable names, contents or
    brands leave out the listing (they tell no product); nothing else is left out. Repeated listings get the same label;
    an empty table gives no rows; extra columns, the sellers' article numbers among them, are ignored; names of any
    length are read whole.
    """
    stage = Stage(df.sparkSession, "products")
    parsed = _parse(df, stage)
    of_item, judged = _judged_terms(parsed, stage)
    info, phrases = _lexicon(parsed, judged, stage)
    worded = _wordings(parsed, info, phrases, stage)
    sizes = _kinds(worded, of_item, judged, parsed, stage)
    trees = _trees(_linked(worded, sizes, stage), stage)
    stage.drop(parsed)
    roots = stage.cut(sizes.join(trees, ["kind", "wording"], "left").select("wording", "kind", F.coalesce("root", "wording").alias("tree")))
    keyed = worded.where((F.col("wording") != "") & F.col("brand").isNotNull() & F.col("content").isNotNull())
    keyed = keyed.join(F.broadcast(roots) if roots.count() <= MOST_BROADCAST_WORDINGS else roots, "wording")
    parts = ("kind", "tree", "brand", "content")
    return keyed.select("listing_id", F.xxhash64(*parts).alias("p1"), F.xxhash64(*reversed(parts), F.lit(1)).alias("p2"))


def product_pairs(df: DataFrame) -> DataFrame:
    """(listing_id_1, listing_id_2), smaller first: every pair of listings of the same product, each once.

    The listings of a product are its rows; the join on the label writes exactly the pairs asked for, and a product
    with very many listings is split by adaptive skew handling. A listing that occurs in several rows gives its
    pairs as often; it never pairs with itself.
    """
    stage = Stage(df.sparkSession, "product-pairs")
    labels = stage.cut(label_products(df))
    left, right = labels.toDF("listing_id_1", "p1", "p2"), labels.toDF("listing_id_2", "p1", "p2")
    return left.join(right, ["p1", "p2"]).where("listing_id_1 < listing_id_2").select("listing_id_1", "listing_id_2")
