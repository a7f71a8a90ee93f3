"""Wrongly decoded text: found and restored by a best-first search over encode, decode and unescape steps.

A state is a text. A step takes the characters of the whole text, or of one suspicious word, back to the bytes that a
wrong decoding made them from and decodes them rightly (or undoes one escaping). The cost of a state is the
implausibility of its characters where they stand plus a price for each step; states are expanded cheapest first, and a
visited set of hashes keeps any text from being expanded twice. The cheapest text reached is the original.
"""

from __future__ import annotations

import heapq
import html
import re
import unicodedata
from collections.abc import Iterator
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STEP_PRICE = 0.7
#: Price of a step that differs from the one before: damage is mostly of one kind.
SWITCH_PRICE = 1.6
#: Price of a word with accents that the lexicon lacks, and of an accented letter in a word that it holds.
UNKNOWN_WORD, KNOWN_WORD_LETTER = 0.4, 0.1
#: So many of the corpus's commonest accented words make up the lexicon.
LEXICON_SIZE = 5_000
#: A character of this cost or more can't belong to the original text.
IMPOSSIBLE = 4.0
LOST = "�"

# Letters by how likely they are in the tables' languages.
HOME_LETTERS = set("áéíóúüñÁÉÍÓÚÜÑ")
KNOWN_LETTERS = set("ãâàçêèëïîôöõåäÃÂÀÇÊÈÏÎÔÖÕÅÄ")
STRANGE_LETTERS = set("ßþðýÿæøœšžìòùûÞÐÝŸÆØŒŠŽÌÒÙÛËƒ")
_LETTERS = HOME_LETTERS | KNOWN_LETTERS | STRANGE_LETTERS
# The decodings that texts go through by mistake.
WRONG = ["cp1252", "mac_roman", "cp850", "cp437", "cp1251"]


def _byte_table(encoding: str) -> dict[str, int]:
    """Character -> byte, with the bytes that the encoding leaves out taken as control characters."""
    table = {}
    for b in range(128, 256):
        try:
            table[bytes([b]).decode(encoding)] = b
        except UnicodeDecodeError:
            table[chr(b)] = b
    if encoding == "cp1252":
        for b in range(128, 160):
            table.setdefault(chr(b), b)
    return table


_TABLES = {encoding: _byte_table(encoding) for encoding in WRONG}
_MULTIBYTE = re.compile("[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xef][\x80-\xbf]{2}|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf4][\x80-\xbf]{3}")
_ESCAPES = re.compile(r"&(?:[A-Za-z]{2,8}|#\d{2,6}|#x[0-9a-fA-F]{2,5});|\\u[0-9a-fA-F]{4}|\\x[0-9a-fA-F]{2}|(?:%[89A-Fa-f][0-9A-Fa-f]){1,4}")


def _utf8_read_as(table: dict[str, int], word: str) -> str:
    """Undoes: UTF-8 bytes were read one by one in the table's encoding."""
    as_bytes = "".join(chr(table[c]) if c in table else "\x00" for c in word)
    out, at = [], 0
    for m in _MULTIBYTE.finditer(as_bytes):
        try:
            c = m[0].encode("latin-1").decode("utf-8")
        except UnicodeDecodeError:
            continue
        out += [word[at : m.start()], c]
        at = m.end()
    return "".join([*out, word[at:]]) if at else word


def _latin1_read_as(table: dict[str, int], word: str) -> str:
    """Undoes: Latin-1 bytes were read in the table's encoding."""
    out = []
    for c in word:
        if c.isascii():
            out.append(c)
        elif c in table:
            out.append(bytes([table[c]]).decode("cp1252", "replace") if table[c] < 160 else chr(table[c]))
        else:
            return word
    return "".join(out)


def _utf8_read_as_cp932(word: str) -> str:
    """Undoes: UTF-8 bytes were read as Japanese double bytes, which may swallow the letter behind."""
    try:
        return word.encode("cp932").decode("utf-8")
    except UnicodeError:
        pass
    out = []
    for run in re.split(r"([｡-ﾟ　-鿿￠-￦]+)", word):
        try:
            out.append(run.encode("cp932").decode("utf-8"))
        except UnicodeError:
            out.append(run)
    return "".join(out)


def _unescape(word: str) -> str:
    def one(m: re.Match) -> str:
        s = m[0]
        if s[0] == "&":
            return html.unescape(s)
        if s[0] == "%":
            plain = unquote(s, errors="replace")
            return s if LOST in plain else plain
        return chr(int(s[2:], 16))

    return _ESCAPES.sub(one, word)


STEPS = {
    **{f"utf-8 as {w}": lambda word, t=_TABLES[w]: _utf8_read_as(t, word) for w in WRONG},
    "utf-8 as cp932": _utf8_read_as_cp932,
    **{f"latin-1 as {w}": lambda word, t=_TABLES[w]: _latin1_read_as(t, word) for w in ("mac_roman", "cp850", "cp437")},
    "escaped": _unescape,
}


def _letter_case(text: str, i: int) -> float:
    """Price of a letter whose case doesn't fit its neighbours in the word."""
    c = text[i]
    before, after = text[i - 1] if i else "", text[i + 1] if i + 1 < len(text) else ""
    if c.isupper():
        if before.islower() or (before.isalpha() and after.islower()):
            return 3.0
    elif before.isupper() and (after.isupper() or (i > 1 and text[i - 2].isupper() and not after.isalpha())):
        return 3.0
    return 0.0


def char_cost(text: str, i: int) -> float:
    """Implausibility of the i-th character where it stands."""
    c = text[i]
    if c.isascii():
        return 0.0 if c >= " " or c in "\t\n\r" else 5.0
    before, after = text[i - 1] if i else " ", text[i + 1] if i + 1 < len(text) else " "
    if c in HOME_LETTERS:
        return _letter_case(text, i)
    alone = not before.isalpha() and not after.isalpha()
    if c in KNOWN_LETTERS:
        return 1.0 + _letter_case(text, i) + (0.6 if alone and after != "." else 0.0)
    if c in "½¼¾×€":
        return 0.4 if alone else 4.0
    if c in "°ªº":
        return 0.4 if (before.isdigit() or (c != "ª" and before in "Nn")) and not after.isalpha() else 4.0
    if c in "¡¿":
        return 0.3 if after.isalnum() and not before.isalpha() else 4.0
    if c == "±":
        return 0.4 if after.isdigit() and not before.isalpha() else 4.0
    if unicodedata.combining(c):
        return 0.1 if unicodedata.normalize("NFC", before + c) in HOME_LETTERS | KNOWN_LETTERS else 4.0
    if c in "–—‘’“”«»·…•®™":
        return 1.5 if alone else 4.0
    if c == " ":
        return 1.0
    if c in STRANGE_LETTERS:
        return 2.5 + _letter_case(text, i)
    return 5.0


_WORD_EDGES = "().,;:!¡¿?-/&%'\""


def word_key(word: str) -> str:
    """A word as the lexicon holds it."""
    return unicodedata.normalize("NFC", word.strip(_WORD_EDGES).casefold())


def text_cost(text: str, lexicon: frozenset[str] = frozenset()) -> float:
    """Implausibility of a text: that of its characters and of accented words that nobody else writes."""
    total = _capital_pairs(text)
    for m in re.finditer(r"[^ \t\n\r]+", text):
        word = m[0]
        if word.isascii() and word.isprintable():
            continue
        own = sum(char_cost(text, i) for i in range(*m.span()))
        if own < IMPOSSIBLE and any(c in _LETTERS for c in word):
            if word_key(word) in lexicon:
                own = min(own, KNOWN_WORD_LETTER + sum(_letter_case(text, i) for i in range(*m.span()) if text[i].isalpha() and not text[i].isascii()))
            else:
                own += UNKNOWN_WORD
        total += own
    return total


def _capital_pairs(text: str) -> float:
    """Price of words such as "TÚ" in a text in small letters: a capital read for a small letter."""
    small = sum(c.islower() for c in text)
    if small * 2 < len(text):
        return 0.0
    return sum(1.2 for w in re.findall(r"\w+", text) if len(w) == 2 and w.isupper() and not w.isascii())


def _suspicious_words(text: str) -> list[tuple[int, int]]:
    mixed = sum(c.islower() for c in text) * 2 >= len(text)
    spans = []
    for m in re.finditer(r"[^ \t\n\r]+", text):
        word = m[0]
        if word.isascii():
            if _ESCAPES.search(word):
                spans.append(m.span())
        elif any(char_cost(text, i) > 0.45 for i in range(*m.span())) or (mixed and len(word.strip(",.()")) == 2 and word.isupper()):
            spans.append(m.span())
    return spans


def _explore(text: str, lexicon: frozenset[str]) -> tuple[float, str, list[str]]:
    """The cheapest text that steps on all suspicious words at once lead to: its cost, the text and the steps' names.

    Cheapest first; a state whose steps alone cost as much as the best text so far can't lead to a better one, and no
    text is expanded twice, so that the search ends by itself.
    """
    start_cost = text_cost(text, lexicon) + (5.0 if _ESCAPES.search(text) else 0.0)
    best: tuple[float, str, list[str]] = (start_cost, text, [])
    tick = 0
    queue: list[tuple[float, int, str, list[str], float]] = [(start_cost, tick, text, [], 0.0)]
    visited = {hash(text)}
    while queue:
        _, _, state, path, spent = heapq.heappop(queue)
        spans = _suspicious_words(state)
        if not spans or spent + STEP_PRICE >= best[0]:
            continue
        for name, step in STEPS.items():
            pieces, at = [], 0
            for a, b in spans:
                pieces += [state[at:a], step(state[a:b])]
                at = b
            new = "".join([*pieces, state[at:]])
            if hash(new) in visited:
                continue
            visited.add(hash(new))
            paid = spent + (STEP_PRICE if not path or path[-1] == name else SWITCH_PRICE)
            total = text_cost(new, lexicon) + (5.0 if _ESCAPES.search(new) else 0.0) + paid
            tick += 1
            if total < best[0] - 1e-9:
                best = (total, new, [*path, name])
            heapq.heappush(queue, (total, tick, new, [*path, name], paid))
    return best


def _word_by_word(text: str, lexicon: frozenset[str]) -> tuple[float, str, list[str]]:
    """The same for each suspicious word by itself: damage may be of several kinds, but each is local."""
    pieces, at, path = [], 0, []
    for a, b in _suspicious_words(text):
        _, found, steps = _explore(text[a:b], lexicon)
        pieces += [text[at:a], found]
        path += [n for n in steps if n not in path]
        at = b
    out = "".join([*pieces, text[at:]])
    paid = STEP_PRICE + SWITCH_PRICE * (len(path) - 1) if path else 0.0
    return text_cost(out, lexicon) + (5.0 if _ESCAPES.search(out) else 0.0) + paid, out, path


def search(text: str, lexicon: frozenset[str] = frozenset()) -> tuple[str, list[str]]:
    """The cheapest text that steps lead to, and the steps' names: of all words at once, then of what is left, word by
    word; or word by word from the start."""
    cost, found, path = _explore(text, lexicon)
    if len(_suspicious_words(found)) > 0 and len(text.split()) > 1:
        rest_cost, rest, more = _word_by_word(found, lexicon)
        if more and rest_cost + STEP_PRICE * len(path) < cost - 1e-9:
            cost, found, path = rest_cost + STEP_PRICE * len(path), rest, [*path, *more]
        apart_cost, apart, steps = _word_by_word(text, lexicon)
        if apart_cost < cost - 1e-9:
            found, path = apart, steps
    return found, path


#: What only wrong decoding leaves: control codes, frames, and symbols behind the letters that lead two bytes.
_RESIDUE = re.compile("[\x80-\x9f\u2500-\u259f]|[\xc2\xc3\xe2][\xa0-\xbf\u20ac\u201a\u0192\u201e\u2020\u2021\u02c6\u2030\u2039\u2018-\u201d\u2022\u2013\u2014\u02dc\u2122\u203a]")
#: Marks that are right between letters.
_BETWEEN_LETTERS = set("\u2019\u2018\u00b7\u2010\u2011\u2013\u2014\u2026\u00ad\u200d\u200c\u00b0\u00ba\u00aa\u20ac\u00ae\u2122\u00a9\u00ab\u00bb\u201c\u201d\u00d7\u00bd\u00bc\u00be")


def _shows_damage(word: str) -> bool:
    """A word that can't be right as it stands: a symbol within it, or a capital or small letter out of place."""
    if _RESIDUE.search(word):
        return True
    for i, c in enumerate(word):
        if c.isascii():
            continue
        before, after = word[i - 1] if i else "", next((x for x in word[i + 1 :] if x != c), "")
        if not c.isalpha() and not unicodedata.combining(c) and before.isalpha() and after.isalpha() and (c not in _BETWEEN_LETTERS or c in "\u00be\u00bd\u00bc\u00b7\u20ac\u2014\u2026\u201d"):
            return True
        if c.isalpha() and _letter_case(word, i) > 0:
            return True
    return False


def _justified(word: str, found: str, path: list[str], lexicon: frozenset[str]) -> bool:
    """A change needs evidence: bytes that go round (several wrong characters are one right one), an escape, a word that
    others write, or a word that can't be right as it stands. A letter that is only rare is none."""
    if word_key(found) in lexicon or _shows_damage(word):
        return True
    return any(STEPS[name](word) != word for name in path if name.startswith("utf-8") or name == "escaped")


_CLEAN = re.compile("[\t\n\r -~áéíóúüñÁÉÍÓÚÜÑ]*")
_CASE_SLIP = re.compile("[a-záéíóúüñ][ÁÉÍÓÚÜÑ]|[A-Za-z][ÁÉÍÓÚÜÑ][a-záéíóúüñ]|[A-Z][áéíóúüñ](?:[A-Z]|(?<=[A-Z][A-Z].)\\b)|\\b[A-Z][ÁÉÍÓÚÜÑ]\\b|[ÁÉÍÓÚÜÑ][A-Z]?\\b")
#: A question mark in place of a character: in or before a word, after a number or letter of numbering, or alone.
_LOST_MARK = re.compile(r"\?(?=\w)|(?<=\w)\?(?=[^\s?!)]|\s+\S)|(?:^|(?<=[\s(]))\?(?=[\s)]|$)|(?<=\w)\?$")


def lost_mark(text: str) -> bool:
    """A question mark stands for a lost character. One that closes a question, opened as one or with "!", doesn't."""
    if "?" not in text:
        return False
    if "¿" in text:
        text = re.sub(r"¿([^?¿]*)\?", r"\1", text)
    return bool(_LOST_MARK.search(text))


def restore(text: str, lexicon: frozenset[str] = frozenset()) -> str | None:
    """None for an undamaged text, the original for one that can be restored, '' if a character is lost."""
    if _CLEAN.fullmatch(text) and not _CASE_SLIP.search(text) and not _ESCAPES.search(text):
        return "" if lost_mark(text) else None
    found, path = search(text, lexicon)
    if path:
        words, now = re.split(r"(\s+)", text), re.split(r"(\s+)", found)
        if len(words) == len(now):
            sure = [w == n or _justified(w, n, path, lexicon) for w, n in zip(words, now, strict=True)]
            # symbols that stand alone follow the words that show the damage; letters that are only rare don't
            shown = any(ok and w != n for ok, w, n in zip(sure, words, now, strict=True))
            kept = [n if ok or (shown and not any(c.isalpha() and not c.isascii() and c != "\u03a9" for c in w)) else w for ok, w, n in zip(sure, words, now, strict=True)]
            found, path = "".join(kept), path if kept != words else []
        elif not _justified(text, found, path, lexicon):
            found, path = text, []
    if LOST in found or lost_mark(found) or _RESIDUE.search(found):
        return ""
    if path and any(char_cost(found, i) >= IMPOSSIBLE for i, c in enumerate(found) if (not c.isascii() or c < " ") and c not in text):
        return ""
    return found if path else None


def accented_words(values: DataFrame, size: int = LEXICON_SIZE) -> frozenset[str]:
    """The commonest accented words of the column ``valor``, counted over all rows; ``size`` bounds what is sent."""
    words = values.select(F.explode(F.split("valor", r"[ \t\n\r]+")).alias("w")).where(F.col("w").rlike(r"[^\x00-\x7f]") & ~F.col("w").rlike(r"[^\x00-ÿ]|[\x80-¿]"))
    counts = words.groupBy(F.lower("w").alias("w")).count().where("count > 2")
    common = counts.orderBy(F.desc("count"), "w").limit(size).collect()
    return trusted_words({r["w"]: r["count"] for r in common})


def trusted_words(counts: dict[str, int]) -> frozenset[str]:
    """Those words that aren't themselves a damaged form of a commoner one."""
    keys: dict[str, int] = {}
    for word, n in counts.items():
        key = word.strip(_WORD_EDGES)
        if len(key) > 1 and all(c.isascii() or c in HOME_LETTERS or c in KNOWN_LETTERS for c in key):
            keys[word_key(key)] = keys.get(word_key(key), 0) + n
    kept = set()
    for key, n in keys.items():
        readings = {word_key(step(form)) for form in (key, key.upper(), key.title()) for step in STEPS.values()} - {key}
        if all(keys.get(r, 0) <= n for r in readings):
            kept.add(key)
    return frozenset(kept)


def find_damaged(df: DataFrame, table_name: str, key: str, fields: list[str]) -> DataFrame:
    """(tabla, fila_id, campo, restaurado) of every value of the fields that holds wrongly decoded characters.

    One narrow pass: values that are plain ASCII without a question mark or escape are passed over on the JVM side,
    the rest goes to the search in Arrow batches. Null and empty values and an empty table give no rows; repeated
    rows each give their own; very long values are searched whole; extra columns are ignored. The accented words of all rows are counted first; the LEXICON_SIZE commonest help to tell readings apart.
    """

    def value(field: str) -> Column:
        return F.struct(F.lit(field).alias("campo"), F.col(field).alias("valor"))

    values = (
        df.select(F.col(key).cast("bigint").alias("fila_id"), F.explode(F.array(*map(value, fields))).alias("x"))
        .select("fila_id", "x.campo", "x.valor")
        .where(F.col("valor").rlike(r"[^\t\n\r -~]|\?|\\[ux][0-9a-fA-F]{2}|&[#A-Za-z0-9]{2,8};|%[89A-Fa-f][0-9A-Fa-f]"))
    )

    lexicon = df.sparkSession.sparkContext.broadcast(accented_words(values))

    def repair(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, str | None] = {}
        for batch in batches:
            if len(known) > 100_000:
                known.clear()
            for v in batch["valor"]:
                if v not in known:
                    known[v] = restore(v, lexicon.value)
            batch["restaurado"] = [known[v] for v in batch["valor"]]
            batch = batch[batch["restaurado"].notna()]
            yield pd.DataFrame({"tabla": table_name, "fila_id": batch["fila_id"], "campo": batch["campo"], "restaurado": batch["restaurado"]})

    return values.mapInPandas(repair, "tabla string, fila_id bigint, campo string, restaurado string")
