"""Sentence units in all languages present: a linear-chain model over the characters, decoded by Viterbi.

Every character is tagged as boundary (last of a sentence) or inside. Only some characters can be a boundary at all:
closing punctuation with the marks behind it, line ends, blanks between Thai words, and, in run-on text of scripts that
write neither blanks nor periods, every character. All others are inside by constraint, so the chain only has to be
decoded over these places. Each place has features (the words around it, their shape, the kind of line break, the
quotation it lies in); their weights and those of the transitions come from an averaged structured perceptron.

Training needs no labels: in text with full capitals and punctuation plain cues settle most places. The model is fitted
on a bounded sample of such documents, once as they are and once with the sentences' capitals taken away, so that it
learns the words at boundaries and not only the cues; for unpunctuated scripts on text with the punctuation stripped.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricelens.session import spread

#: So many documents (by the smallest hash of their text) are fitted on, over so many rounds; documents of more than so
#: many characters are no part of the sample, but are read like any other.
SAMPLE_DOCUMENTS, SAMPLE_MOST_CHARS, ROUNDS = 1_500, 6_000, 4
#: A line of this many characters may have been broken within a sentence; shorter and longer ones end where they end.
WRAP_LEAST, WRAP_MOST = 58, 140

CLOSERS = "\\)\\]\"'”’»」』）】›〉》"
OPENERS = "¿¡«“‘\"'(\\[「『（【‹〈《—–"
EMOJI = "\U0001f300-\U0001faff☀-➿⬀-⯿️‍"
SIGN = rf"(?:[{EMOJI}]+|[:;]-?[)(DPp]|<3)"
CJK = "぀-ヿ㐀-䶿一-鿿豈-﫿"
THAI = "฀-๿"
#: Where a sentence may end: (1) marks with closers and signs, (2) a sign, (3) a line end, (4) a blank in Thai.
PLACE = re.compile(
    rf"(?P<term>(?:\.{{2,}}|…+|[.!?]+|[。！？．؟।॥۔]+)[.!?…。！？]*)(?P<close>[{CLOSERS}]*)(?P<sign>(?:[ \t]?{SIGN})*)(?=\s|$|[{CJK}{THAI}{OPENERS}]|(?<=[。！？।؟!?…”」』）])\S|(?<=[^\W\dA-Z_]{{2}}[.!?])[A-Z¿¡ÁÉÍÓÚÑ]|(?<=[\d%)»][.!?])[A-Z¿¡ÁÉÍÓÚÑ]|(?<=[^\W\dA-Z_]{{3}}[.!?])[^\W\dA-Z_]{{2}})"
    rf"|(?P<only>{SIGN})(?=\s|$)"
    rf"|(?P<line>(?=[ \t\r\f\v]*\n))"
    rf"|(?P<thai>(?<=[{THAI}])(?=[ \t]+[{THAI}]))"
)
#: What looks like an address ends here.
ADDRESS = re.compile(r"(?:www\.|@|://|/)\S*$")
LIST_MARK = re.compile(r"[ \t]*(?:[-*•–·▪◦]|\d{1,3}[.)]|[a-z]\))[ \t]+")

# Shortened words that never end a sentence.
NEVER_LAST = set(
    "dr dra drs sr sra sres srta don dña av avda aprox approx ej e.g i.e vs tel prof mr mrs ms st ing lic gral cf ca p.ej د रु डॉ श्री ee cdas".split()
)
# Shortened words that don't end a sentence before a number.
BEFORE_NUMBER = set("n no núm num nº pág pag págs p pp art fig cap vol ص".split())
ENDED = re.compile(rf"[.!?…:。！？।؟॥۔:]+[{CLOSERS}]*\s*(?:{SIGN})?\s*$|{SIGN}\s*$")
WORD = re.compile(r"[^\s" + OPENERS + CLOSERS + r".,;:!?…。！？．؟।॥۔،、，]+")
LAST_WORD = re.compile(r"([^\s\"'«“‘(\[「『（¿¡]+)$")
QUOTES = {"«": "»", "“": "”", "「": "」", "『": "』", "„": "“", "‹": "›"}


#: Weights before training: a model that has seen little follows the plain cues.
PRIOR = {"r1full": 3.0, "r0full": -3.0, "r1small": 1.0, "r0small": -1.5}


class Place(NamedTuple):
    end: int  # the sentence would end before this character
    next: int  # and the next one would start here
    rule: int  # what plain cues say: 1 boundary, 0 inside
    fixed: bool  # the cue admits no doubt
    features: tuple[str, ...]


def _kind(c: str) -> str:
    if not c:
        return "end"
    if c.isdigit():
        return "digit"
    if c.isupper():
        return "upper"
    if c.islower():
        return "lower"
    if re.match(f"[{CJK}]", c):
        return "cjk"
    if re.match(f"[{THAI}]", c):
        return "thai"
    if c.isalpha():
        return "caseless"
    if c in "¿¡":
        return "open!"
    if c in "«“\"'‘「『„":
        return "quote"
    if c in "([（【":
        return "bracket"
    if c in "—–":
        return "dash"
    if c in ",;:،、，；：":
        return "comma"
    if re.match(f"[{EMOJI}]", c):
        return "emoji"
    return "other"


STARTS = {"upper", "open!", "quote", "bracket", "dash", "digit", "cjk", "caseless", "emoji", "end"}


def quotations(text: str) -> list[tuple[int, int]]:
    """(start, end) of every quotation; one that isn't closed before an empty line is none."""
    found, open_marks, straight = [], [], -1
    for m in re.finditer(r"[«»“”„「」『』‹›\"]|\n[ \t\r]*\n", text):
        c, i = m[0], m.start()
        if c[0] == "\n":
            open_marks, straight = [], -1
        elif c == '"':
            if straight < 0:
                straight = i
            else:
                found.append((straight, i))
                straight = -1
        elif c in QUOTES and not (c == "“" and open_marks and open_marks[-1][1] == "“"):
            open_marks.append((i, QUOTES[c]))
        elif open_marks and c == open_marks[-1][1]:
            found.append((open_marks.pop()[0], i))
    return sorted(found)


def places(text: str) -> list[Place]:
    """Every place of the text that may be a boundary, in order."""
    lines = text.split("\n")
    unended = [bool(line.strip()) and not ENDED.search(line) for line in lines]
    soft = [WRAP_LEAST <= len(line.rstrip()) <= WRAP_MOST and not re.search(f"[{CJK}{THAI}]$", line.rstrip()) for line in lines]
    listed = [bool(LIST_MARK.match(line)) and not (i and soft[i - 1] and unended[i - 1]) for i, line in enumerate(lines)]
    starts, at = [], 0
    for line in lines:
        starts.append(at)
        at += len(line) + 1
    quotes = quotations(text)
    framed = []
    for a, b in quotes:
        before = text[:a].rstrip(" \t")[-1:] if a else ""
        introduced = bool(before) and before not in ".!?…。！？।؟\n)»”」』）" + "؛"
        rest = text[b + 1 : b + 40]
        after = rest.lstrip(" \t\n\r")[:1]
        continued = _kind(after) in ("lower", "comma") or (_kind(after) in ("cjk", "caseless", "thai") and (introduced or not rest[:1].isspace()))
        framed.append((a, b, introduced, continued))
    out: list[Place] = []
    line_no, q = 0, 0
    capitals = len(re.findall(r"(?:^|[.!?]\s+)[A-ZÁÉÍÓÚÑÀÂÃÇÊÔÕ]", text))
    smalls = len(re.findall(r"(?:^|[.!?]\s+)[a-záéíóúñàâãçêôõ]", text))
    small_doc = smalls > capitals
    last_end = 0
    for m in PLACE.finditer(text):
        end = m.end()
        if end <= last_end and m["line"] is None or end == 0:
            continue
        rest = re.compile(r"\s*").match(text, end)
        nxt = rest.end()
        gap = text[end:nxt]
        if not gap and m["term"] and text[end : end + 1].islower() and (not small_doc or ADDRESS.search(text, max(0, end - 60), end)):
            continue  # within a word or address
        if m["line"] is not None and (end == last_end or not text[last_end:end].strip()):
            continue
        last_end = end
        while line_no + 1 < len(starts) and starts[line_no + 1] <= m.start():
            line_no += 1
        line = lines[line_no].rstrip()
        breaks = gap.count("\n")
        after = text[nxt : nxt + 1]
        kind = _kind(after)
        word = WORD.match(text, nxt + (kind in ("open!", "quote", "bracket", "dash")))
        next_word = word[0].casefold() if word else ""
        term = m["term"] or ""
        sign = bool(m["sign"] or m["only"])
        closers = m["close"] or ""
        before = LAST_WORD.search(text, max(0, m.start() - 40), m.start())
        last = before[1].casefold() if before else ""
        if re.match(r"\w{3,}[.!?]\w", last) and "www" not in last and "@" not in last:  # no blank between two sentences
            last = re.split(r"[.!?]", last.rstrip("."))[-1]
        mark = "sign" if m["only"] else "line" if m["line"] is not None else "thai" if m["thai"] is not None else "…" if len(term) > 1 and set(term) <= set(".…") or "…" in term else term[0]
        # line breaks
        brk = "none" if not breaks else "blank" if breaks > 1 else "line"
        if brk == "line":
            following = line_no + 1
            marked = following < len(lines) and LIST_MARK.match(lines[following]) is not None
            if soft[line_no] and not listed[line_no] and not (marked and listed[following]):
                brk = "wrap"
            elif marked:
                brk = "list"
        # quotations
        while q < len(framed) and framed[q][1] < m.start():
            q += 1
        quote = ""
        for a, b, introduced, continued in framed[q : q + 3]:
            if a < m.start() <= b:
                at_close = b < end
                if at_close:
                    quote = "closing " + ("introduced " if introduced else "") + ("continued" if continued else "")
                else:
                    quote = "framed" if introduced or continued else "own"
                break
        # what plain cues say
        fixed = False
        if nxt >= len(text):
            rule, fixed = 1, True
        elif brk == "blank":
            rule, fixed = 1, True
        elif brk in ("line", "list"):
            rule, fixed = 1, True
        elif quote == "framed":
            rule, fixed = 0, True
        elif mark == "line":
            rule, fixed = 0, True
        elif mark == "thai":
            rule = 1
        elif quote.startswith("closing") and quote.endswith("continued"):
            rule = 0
        elif mark in "。！？।॥۔؟":
            rule = 1
        elif kind == "lower" and not gap and small_doc:
            rule = int(last.rstrip(".") not in NEVER_LAST)
        elif kind == "comma" or kind == "lower":
            rule = 0
        elif mark == "…":
            rule = int(kind in STARTS - {"cjk"} and bool(gap))
        elif mark == "." and not sign and not closers:
            bare = last.rstrip(".")
            amount = re.search(r"\d[ \xa0]?\Z", text[max(0, m.start() - len(last) - 3) : m.start() - len(last)]) is not None
            alone = (len(bare) == 1 and bare.isalpha() and not amount) or (re.fullmatch(r"(?:[^\W\d_]\.)+[^\W\d_]", bare) is not None and kind == "lower")
            line_start = m.start() - len(last) <= starts[line_no] + (len(line) - len(line.lstrip()))
            if (bare in NEVER_LAST and not amount) or (bare in BEFORE_NUMBER and kind == "digit") or alone:
                rule = 0
            elif bare.isdigit() and len(bare) <= 3 and line_start and listed[line_no]:
                rule, fixed = 0, True
            elif kind == "caseless" and "ऀ" <= after <= "ॿ":
                rule = 0
            else:
                rule = int(kind in STARTS and (bool(gap) or kind in ("upper", "open!", "quote")))
        else:
            rule = int(kind in STARTS and (bool(gap) or kind in ("upper", "open!", "quote")))
        shape = "digit" if last[-1:].isdigit() else "one" if len(last.strip(".")) == 1 else "dotted" if "." in last else "word"
        doc = "small" if small_doc else "full"
        features = () if fixed else (
            f"r{rule}{doc}", f"r{rule}{mark}", f"m{mark}{kind}{doc}", f"b{brk}{mark}", f"q{quote}{kind}", f"l{last[-12:]}", f"n{next_word[:12]}{doc}",
            f"l{last[-12:]} {kind}{doc}", f"l{last[-12:]} n{next_word[:10]}", f"s{shape}{mark}{kind}", f"c{closers[-1:]}{kind}n{next_word[:8]}", f"g{bool(gap)}{mark}{sign}",
        )
        out.append(Place(end, nxt, rule, fixed, features))
    if not out or out[-1].end < len(text.rstrip()):
        out.append(Place(len(text.rstrip()), len(text), 1, True, ()))
    return out


class ChainModel:
    """Weights of a linear chain over two tags, with Viterbi decoding and perceptron training."""

    def __init__(self, weights: dict[str, float] | None = None):
        self.weights = weights or {}

    def decode(self, chain: list[tuple[tuple[str, ...], int | None]]) -> list[int]:
        """The best tags of a chain of (features, tag if settled)."""
        if not chain:
            return []
        w = self.weights
        t = [[w.get("t00", 0.0), w.get("t01", 0.0)], [w.get("t10", 0.0), w.get("t11", 0.0)]]
        score, back = [0.0, -1e9], []
        for features, settled in chain:
            if settled is not None:
                gains = (0.0, -1e9) if settled == 0 else (-1e9, 0.0)
            else:
                emission = w.get("bias", 0.0)
                for f in features:
                    emission += w.get(f, 0.0)
                gains = (0.0, emission)
            row, new = [0, 0], [0.0, 0.0]
            for tag in (0, 1):
                from0, from1 = score[0] + t[0][tag], score[1] + t[1][tag]
                row[tag] = int(from1 > from0)
                new[tag] = max(from0, from1) + gains[tag]
            back.append(row)
            score = new
        tag = int(score[1] > score[0])
        tags = [tag]
        for row in reversed(back[1:]):
            tag = row[tag]
            tags.append(tag)
        return tags[::-1]

    def fit(self, chains: list[tuple[list[tuple[tuple[str, ...], int | None]], list[int]]], rounds: int = ROUNDS, seed: int = 7) -> ChainModel:
        """Averaged perceptron: wherever the decoded tags differ from the given ones, weights move towards the latter."""
        total: dict[str, float] = {}
        rng = random.Random(seed)
        order, step = list(range(len(chains))), 0
        w = self.weights
        for _ in range(rounds):
            rng.shuffle(order)
            for i in order:
                chain, gold = chains[i]
                step += 1
                tags = self.decode(chain)
                if tags == gold:
                    continue
                last_tag, last_gold = 0, 0
                for (features, settled), tag, want in zip(chain, tags, gold, strict=True):
                    changes = []
                    if tag != want and settled is None:
                        sign = 1.0 if want else -1.0
                        changes += [(f, sign) for f in features] + [("bias", sign)]
                    if (last_tag, tag) != (last_gold, want):
                        changes += [(f"t{last_gold}{want}", 0.3), (f"t{last_tag}{tag}", -0.3)]
                    for f, d in changes:
                        w[f] = w.get(f, 0.0) + d
                        total[f] = total.get(f, 0.0) + step * d
                    last_tag, last_gold = tag, want
        self.weights = {f: v - total.get(f, 0.0) / (step + 1) for f, v in w.items()}
        return self


#: A whole line of Chinese, Japanese or Thai letters, figures and words in other letters, without a mark that could end
#: a sentence in it.
_UNMARKED = re.compile(rf"[{CJK}{THAI}\w%.\-・ー々〇]+")
_WITHOUT_BLANKS = re.compile(f"[{CJK}{THAI}]")
_STANDS_ALONE = re.compile("[^ัิ-ฺ็-๎]")


def unmarked(text: str, a: int, b: int) -> bool:
    """The unit is a line by itself, in a script without blanks and periods, and shows no mark."""
    line = text[a:b]
    if not _WITHOUT_BLANKS.search(line) or not _UNMARKED.fullmatch(line):
        return False
    return not text[text.rfind("\n", 0, a) + 1 : a].strip() and not text[b : (text.find("\n", b) + 1 or len(text) + 1) - 1].strip()


def _run_on_chain(line: str) -> list[tuple[tuple[str, ...], int | None]]:
    """A place behind every character, with the characters around it."""
    padded = "  " + line + "  "
    chain = []
    for i in range(3, len(line) + 2):
        a, b = padded[i - 2 : i], padded[i : i + 2]
        chain.append(((f"x{a}", f"y{b}", f"z{a[1]}{b[0]}", f"u{a}{b[0]}", f"v{a[1]}{b}", f"w{a}{b}"), None))
    return chain


def cut(text: str, model: ChainModel, run_on: ChainModel | None = None) -> list[tuple[int, int]]:
    """(start, end) of every sentence of a text."""
    if not text.strip():
        return []
    here = places(text)
    tags = model.decode([(p.features, p.rule if p.fixed else None) for p in here])
    spans, start = [], len(text) - len(text.lstrip())
    for p, tag in zip(here, tags, strict=True):
        if tag and p.end > start:
            spans.append((start, p.end))
            start = p.next
    if start < len(text.rstrip()):
        spans.append((start, len(text.rstrip())))
    out = []
    for a, b in spans:
        while b > a and text[b - 1].isspace():
            b -= 1
        while a < b and text[a].isspace():
            a += 1
        if a == b:
            continue
        line = text[a:b]
        if run_on is not None and unmarked(text, a, b):
            at = a
            for i, tag in enumerate(run_on.decode(_run_on_chain(line)), 1):
                if tag and a + i - at >= 2 and b - a - i >= 2 and _STANDS_ALONE.match(line[i]):
                    out.append((at, a + i))
                    at = a + i
            out.append((at, b))
        else:
            out.append((a, b))
    return out


def train(texts: list[str]) -> tuple[ChainModel, ChainModel]:
    """The model of punctuated text and that of run-on text, from raw documents."""
    chains: list = []
    stripped: dict[bool, list[str]] = {False: [], True: []}
    rng = random.Random(11)
    for text in texts:
        here = places(text)
        gold = [p.rule for p in here]
        capitals = sum(text[p.next : p.next + 1].isupper() for p in here if p.rule)
        smalls = sum(text[p.next : p.next + 1].islower() for p in here if p.rule)
        cased = capitals + smalls > 0
        if cased and smalls > capitals:
            continue  # the cues need capitals
        chains.append(([(p.features, p.rule if p.fixed else None) for p in here], gold))
        if cased:
            starts = {p.next for p in here if p.rule} | {len(text) - len(text.lstrip())}
            lowered = "".join(c.lower() if i in starts and len(c.lower()) == 1 else c for i, c in enumerate(text))
            ends = {p.end for p in here if p.rule}
            small = places(lowered)
            chains.append(([(p.features, p.rule if p.fixed else None) for p in small], [p.rule if p.fixed else int(p.end in ends) for p in small]))
        start = 0
        for p in here:
            if p.rule:
                sentence = re.sub(rf"[^{CJK}{THAI}\w%]", "", text[start : p.end])
                start = p.next
                if len(sentence) > 1 and _WITHOUT_BLANKS.search(sentence):
                    stripped[bool(re.search(f"[{THAI}]", sentence))].append(sentence)
    model = ChainModel(dict(PRIOR)).fit(chains)
    joined = []
    for script in stripped.values():
        rng.shuffle(script)
        at = 0
        while at < len(script):  # one, two or three sentences of one script without what parted them
            parts = script[at : at + rng.choice((1, 1, 2, 3))]
            at += len(parts)
            ends = {sum(map(len, parts[:k])) for k in range(1, len(parts))}
            line = "".join(parts)
            joined.append((_run_on_chain(line), [int(k in ends) for k in range(1, len(line))]))
    return model, ChainModel().fit(joined, rounds=3)


def sample_texts(df: DataFrame, text: str, documents: int = SAMPLE_DOCUMENTS) -> list[str]:
    """A bounded sample that depends on the texts only: those with the smallest hashes."""
    rows = df.where((F.length(text) > 20) & (F.length(text) <= SAMPLE_MOST_CHARS)).select(F.col(text).alias("t"), F.xxhash64(text).alias("h")).orderBy("h", "t").limit(documents).collect()
    return [r["t"] for r in rows]


def split_sentences(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, sent_no, start_pos, end_pos) of every sentence, in code points, end exclusive, without blanks around it.

    The model is fitted on the driver and broadcast (its size is bounded by the sample); every document is then read
    whole where it lies, with no shuffle. Null, empty and blank texts and an empty table give no rows; repeated texts
    give rows of their own; extra columns are ignored.
    """
    key_type = df.schema[key].dataType.simpleString()
    model, run_on = train(sample_texts(df, text))
    shared = df.sparkSession.sparkContext.broadcast((model.weights, run_on.weights))

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, own_run_on = (ChainModel(w) for w in shared.value)
        for batch in batches:
            keys, numbers, starts, ends = [], [], [], []
            for k, t in zip(batch["k"], batch["t"], strict=True):
                for i, (a, b) in enumerate(cut(t, own, own_run_on), 1):
                    keys.append(k), numbers.append(i), starts.append(a), ends.append(b)
            yield pd.DataFrame({key: keys, "sent_no": numbers, "start_pos": starts, "end_pos": ends})

    source = df.where(F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t"))
    return spread(source).mapInPandas(split, f"`{key}` {key_type}, sent_no int, start_pos int, end_pos int")
