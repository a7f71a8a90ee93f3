"""Text helpers as Column -> Column; all run on the JVM side."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _accent_table() -> tuple[str, str, dict[str, str]]:
    """Letters that fold to one ASCII character, their folds, and those that fold to several."""
    single_from, single_to, several = [], [], {}
    for code in [*range(0x00A0, 0x0250), *range(0x1E00, 0x1F00), *range(0x2070, 0x209D), *range(0x2150, 0x2190), *range(0xFB00, 0xFB07)]:
        ch = chr(code)
        plain = "".join(c for c in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(c))
        if plain == ch or not plain or not all(c.isascii() or c == "⁄" for c in plain):
            continue
        if len(plain) == 1:
            single_from.append(ch)
            single_to.append(plain)
        else:
            several[ch] = plain
    return "".join(single_from), "".join(single_to), several


_FROM, _TO, _SEVERAL = _accent_table()
_FEW = {c: s for c, s in _SEVERAL.items() if c in "½¼¾ﬁﬂŉĳ™"}

# Words that searches pass over.
SEARCH_STOP_WORDS = ["de", "del", "la", "las", "el", "los", "y"]


def fold_accents(text: Column) -> Column:
    """Letters without their accents, composed or decomposed; other characters stay."""
    folded = F.translate(F.regexp_replace(text, r"\p{M}", ""), _FROM, _TO)
    for ch, plain in _FEW.items():
        folded = F.replace(folded, F.lit(ch), F.lit(plain))
    return folded


def clean_text(text: Column, keep: str = "") -> Column:
    """Small letters without accents, digits, single blanks and the kept signs; null becomes ''."""
    kept = "".join("\\" + c for c in keep)
    plain = F.regexp_replace(fold_accents(F.lower(F.coalesce(text, F.lit("")))), rf"[^a-z0-9\s{kept}]", " ")
    return F.trim(F.regexp_replace(plain, r"\s+", " "))


def words(cleaned: Column) -> Column:
    """The words of a cleaned text."""
    return F.filter(F.split(cleaned, " "), lambda w: w != "")


def contains_any(cleaned: Column, phrases: Column) -> Column:
    """Some phrase occurs, also within a longer word."""
    return F.exists(phrases, lambda p: F.contains(cleaned, p))


def contains_all(cleaned: Column, phrases: Column) -> Column:
    """Every phrase occurs, also within a longer word."""
    return F.forall(phrases, lambda p: F.contains(cleaned, p))


def contains_word(cleaned: Column, word: Column) -> Column:
    """The word or phrase occurs between word bounds of a cleaned text."""
    return F.contains(F.concat(F.lit(" "), cleaned, F.lit(" ")), F.concat(F.lit(" "), word, F.lit(" ")))


def contains_any_word(cleaned: Column, phrases: Column) -> Column:
    return F.exists(phrases, lambda p: contains_word(cleaned, p))


def contains_all_words(cleaned: Column, phrases: Column) -> Column:
    return F.forall(phrases, lambda p: contains_word(cleaned, p))


def name_signature(name: Column, n: int = 3) -> Column:
    """The first n words of at least three letters."""
    return F.array_join(F.slice(F.filter(words(clean_text(name)), lambda w: F.length(w) >= 3), 1, n), " ")


def brand_prefix(brand: Column) -> Column:
    return F.substring(clean_text(brand), 1, 4)


def search_tokens(query: Column, fold: bool = False, stop_words: Sequence[str] = SEARCH_STOP_WORDS) -> Column:
    """Tokens of a search of at least two characters that aren't stop words; with accents kept or folded."""
    text = F.trim(F.lower(F.coalesce(query, F.lit(""))))
    text = fold_accents(text) if fold else text
    stops = F.array(*[F.lit(w) for w in stop_words])
    return F.filter(F.split(text, r"\s+"), lambda t: (F.length(t) > 1) & ~F.array_contains(stops, t))


def matches_search(text: Column, query: Column, fold: bool = False) -> Column:
    """Every token of the search occurs in the text; a search without tokens must occur as a whole."""
    tokens = search_tokens(query, fold)
    hay = F.lower(F.coalesce(text, F.lit("")))
    hay = fold_accents(hay) if fold else hay
    whole = F.trim(F.lower(F.coalesce(query, F.lit(""))))
    whole = fold_accents(whole) if fold else whole
    return F.when(F.size(tokens) > 0, contains_all(hay, tokens)).otherwise(F.contains(hay, whole))


def slug(text: Column, separator: str = "-") -> Column:
    """Folded words joined by a separator."""
    plain = F.regexp_replace(fold_accents(F.lower(F.coalesce(text, F.lit("")))), r"[^a-z0-9]+", separator)
    return F.regexp_replace(plain, rf"^\{separator}+|\{separator}+$", "")


def normal_url(url: Column) -> Column:
    """An address without query, fragment and closing slash."""
    return F.regexp_replace(F.regexp_replace(F.trim(url), r"[?#].*$", ""), r"/+$", "")


def last_path_part(url: Column) -> Column:
    return F.substring_index(normal_url(url), "/", -1)


def label_part(label: Column, which: int, separator: str = ">") -> Column:
    """The which-th part (from 0) of a label such as "group > name"; the last one if there are fewer."""
    parts = F.transform(F.split(label, separator), F.trim)
    return F.try_element_at(parts, F.least(F.lit(which + 1), F.size(parts)))


def stable_id(url: Column, *fallbacks: Column) -> Column:
    """The article number in an address, or a hash of what else identifies the article."""
    number = F.coalesce(
        *[F.nullif(F.regexp_extract(url, p, 1), F.lit("")) for p in (r"/p/(\d+)", r"[?&]sku=(\w+)", r"/(\d{5,})(?:[/?#]|$)", r"-(\d{5,})(?:[/?#]|$)")]
    )
    return F.coalesce(number, F.concat(F.lit("hash_"), F.substring(F.md5(F.concat_ws("|", F.coalesce(url, F.lit("")), *[F.coalesce(c, F.lit("")) for c in fallbacks])), 1, 16)))


def strip_residue(text: Column, residues: Sequence[str]) -> Column:
    """A text without the given headings, blanks squeezed."""
    for r in residues:
        text = F.regexp_replace(text, rf"(?i)\Q{r}\E", " ")
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def name_patterns(cleaned: Column, stop_words: Sequence[str] = SEARCH_STOP_WORDS, least: int = 4, most: int = 4) -> Column:
    """The words that stand for a list entry: the first few long ones of its cleaned name, else the whole name."""
    kept = F.filter(F.split(cleaned, " "), lambda w: (F.length(w) >= least) & ~w.isin(list(stop_words)))
    return F.when(F.size(kept) > 0, F.slice(kept, 1, most)).otherwise(F.array(cleaned))


def has_strong_token(cleaned: Column, tokens: Column, least: int = 3) -> Column:
    """One of the tokens of so many letters and more is a word of the text; true where there is no such token."""
    strong = F.filter(tokens, lambda t: F.length(t) >= least)
    return (F.size(strong) == 0) | F.exists(strong, lambda t: F.contains(F.concat(F.lit(" "), cleaned, F.lit(" ")), F.concat(F.lit(" "), t, F.lit(" "))))
