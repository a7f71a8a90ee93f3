"""Log texts of several programs into entries with time, level, component and message.

Each line has a shape signature, made of the whole line: runs of letters become ``a``, runs of digits ``9``, runs of
blanks one blank, three words and more one word; the rest stays. It tells the layouts that the line can have, so every distinct
signature is resolved to its layouts once, the table from signature to layouts goes to the workers, and a line's own text
is only read by the layouts that its signature names, the likeliest first (nearly always there is but one).
A signature without layout is a continuation and is attached to the entry above.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from datetime import UTC, datetime
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricelens.session import spread

#: So many signatures are resolved on the driver and broadcast; the workers resolve any rarer one in the same way.
MOST_BROADCAST = 20_000

ANSI = r"\x1b\[[0-9;?]*[A-Za-z]"
_ANSI = re.compile(ANSI)

# Level words and codes as programs write them.
LEVELS = {
    "DEBUG": "DEBUG", "DBG": "DEBUG", "TRACE": "DEBUG", "VERBOSE": "DEBUG", "D": "DEBUG", "T": "DEBUG", "V": "DEBUG",
    "INFO": "INFO", "INF": "INFO", "INFORMATION": "INFO", "NOTICE": "INFO", "I": "INFO", "N": "INFO",
    "WARNING": "WARNING", "WARN": "WARNING", "WRN": "WARNING", "W": "WARNING",
    "ERROR": "ERROR", "ERR": "ERROR", "SEVERE": "ERROR", "E": "ERROR",
    "CRITICAL": "CRITICAL", "CRIT": "CRITICAL", "FATAL": "CRITICAL", "ALERT": "CRITICAL", "EMERG": "CRITICAL", "PANIC": "CRITICAL", "C": "CRITICAL", "F": "CRITICAL",
}
# Severities 0 to 7 of the syslog protocol.
SYSLOG = ["CRITICAL", "CRITICAL", "CRITICAL", "ERROR", "WARNING", "INFO", "INFO", "DEBUG"]
# Month names, English and Spanish.
MONTHS = {
    "jan": 1, "feb": 2, "mar": 3, "apr": 4, "may": 5, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "oct": 10, "nov": 11, "dec": 12,
    "ene": 1, "abr": 4, "ago": 8, "set": 9, "dic": 12,
}


class Entry(NamedTuple):
    ts: str
    level: str
    component: str
    message: str


def _level(word: str) -> str | None:
    return LEVELS.get(word.strip().upper())


def _ts(y, mo, d, h, mi, s) -> str | None:
    try:
        return datetime(int(y), int(mo), int(d), int(h), int(mi), int(s)).strftime("%Y-%m-%d %H:%M:%S")
    except ValueError:
        return None


def _iso(text: str) -> str | None:
    m = re.match(r"(\d{4})[-/](\d\d?)[-/](\d\d?)[T ](\d\d?):(\d\d):(\d\d)", text)
    return _ts(*m.groups()) if m else None


def _epoch(text: str) -> str | None:
    try:
        value = int(text)
        while value > 32_503_680_000:  # milli-, micro- or nanoseconds
            value //= 1000
        return datetime.fromtimestamp(value, UTC).strftime("%Y-%m-%d %H:%M:%S")
    except (ValueError, OverflowError):
        return None


_KEYS = {
    "ts": ("ts", "time", "timestamp", "@timestamp", "datetime"),
    "level": ("level", "severity", "lvl", "levelname"),
    "component": ("logger", "component", "name", "module"),
    "message": ("msg", "message", "event"),
}


def _from_fields(fields: dict) -> Entry | None:
    got = {what: next((fields[k] for k in keys if k in fields), None) for what, keys in _KEYS.items()}
    if got["level"] is None or got["message"] is None:
        return None
    level = _level(str(got["level"]))
    if level is None:
        return None
    ts = got["ts"]
    when = "" if ts in (None, "") else (_epoch(str(ts)) if re.fullmatch(r"\d{9,19}", str(ts)) else _iso(str(ts)))
    if when is None:
        return None
    message = got["message"] if isinstance(got["message"], str) else json.dumps(got["message"], ensure_ascii=False)
    return Entry(when, level, "" if got["component"] is None else str(got["component"]), message)


def _json(line: str, _year: int | None) -> Entry | None:
    try:
        fields = json.loads(line)
    except (ValueError, RecursionError):
        return None
    return _from_fields(fields) if isinstance(fields, dict) else None


_PAIR = re.compile(r'([A-Za-z_@][\w.@-]*)=(?:"((?:[^"\\]|\\.)*)"|(\S*))(?:\s+|$)')
_ESCAPE = re.compile(r"\\(u[0-9a-fA-F]{4}|.)", re.S)
_ESCAPED = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}


def _unescape(text: str) -> str:
    return _ESCAPE.sub(lambda m: chr(int(m[1][1:], 16)) if len(m[1]) == 5 else _ESCAPED.get(m[1], m[1]), text)


def _logfmt(line: str, _year: int | None) -> Entry | None:
    fields, at = {}, 0
    line = line.rstrip()
    while at < len(line):
        m = _PAIR.match(line, at)
        if not m:
            return None
        fields.setdefault(m[1], _unescape(m[2]) if m[2] is not None else m[3])
        at = m.end()
    return _from_fields(fields)


def _by_regex(pattern: str, build: Callable[[dict, int | None], tuple[str | None, str | None]]) -> Callable[[str, int | None], Entry | None]:
    compiled = re.compile(pattern, re.S)

    def read(line: str, year: int | None) -> Entry | None:
        m = compiled.match(line)
        if not m:
            return None
        g = m.groupdict()
        ts, level = build(g, year)
        if ts is None or level is None:
            return None
        return Entry(ts, level, g["c"].strip(), g["m"])

    return read


_NAME = r"[^\s\[\]():|]+"
_MESSAGE = r"(?P<m>.*)"
_TIME = r"(?P<h>\d\d):(?P<mi>\d\d):(?P<s>\d\d)(?:[.,]\d+)?(?:Z|[+-]\d\d:?\d\d)?"


def _dmy(g, _y):
    return _ts(g["y"], g["mo"], g["d"], g["h"], g["mi"], g["s"]), _level(g["l"])


def _syslog(g, year):
    priority, month = int(g["l"]), MONTHS.get(g["mo"].lower())
    return (_ts(year, month, g["d"], g["h"], g["mi"], g["s"]) if month and year else ("" if month else None)), SYSLOG[priority % 8] if priority < 192 else None


def _klog(g, year):
    return (_ts(year, g["mo"], g["d"], g["h"], g["mi"], g["s"]) if year else ""), _level(g["l"])


class Layout(NamedTuple):
    name: str
    shape: re.Pattern
    read: Callable[[str, int | None], Entry | None]


_YMD = r"(?P<y>\d{4})[-/](?P<mo>\d\d)[-/](?P<d>\d\d)[ T]"
_DMY = r"(?P<d>\d\d)[-/](?P<mo>\d\d)[-/](?P<y>\d{4}) "

#: Each layout: the head of its signatures, and how a line of it is read.
LAYOUTS = [
    Layout("json", re.compile(r'\{ ?"'), _json),
    Layout("logfmt", re.compile(r'[a_]+="?(?:9-9-9[a ]9:9:9|9|a)'), _logfmt),
    Layout("time - name - level - text", re.compile(r"9[-/]9[-/]9[a ]9:9:9\S* - "), _by_regex(rf"{_YMD}{_TIME} - (?P<c>{_NAME}) - (?P<l>[A-Za-z]+) - {_MESSAGE}", _dmy)),
    Layout("time level [name] text", re.compile(r"9[-/]9[-/]9[a ]9:9:9\S* a \["), _by_regex(rf"{_YMD}{_TIME} +(?P<l>[A-Za-z]+) +\[(?P<c>[^\]\s]+)\]:? ?{_MESSAGE}", _dmy)),
    Layout("level time (thread) name: text", re.compile(r"a 9[-/]9[-/]9 9:9:9\S* \("), _by_regex(rf"(?P<l>[A-Za-z]+) +{_DMY}{_TIME} +\([^)]*\) +(?P<c>{_NAME}): ?{_MESSAGE}", _dmy)),
    Layout("<priority>time host name[process]: text", re.compile(r"<9>a ?9 9:9:9 "), _by_regex(rf"<(?P<l>\d{{1,3}})>(?P<mo>[A-Za-z]{{3}}) +(?P<d>\d\d?) {_TIME} \S+ (?P<c>{_NAME})(?:\[\d+\])?: ?{_MESSAGE}", _syslog)),
    Layout("Lmmdd time thread name:line] text", re.compile(r"a9 9:9:9"), _by_regex(rf"(?P<l>[A-Z])(?P<mo>\d\d)(?P<d>\d\d) {_TIME} +\d+ (?P<c>{_NAME}):\d+\] ?{_MESSAGE}", _klog)),
    Layout("[time] level name - text", re.compile(r"\[9[-/]9[-/]9 9:9:9\S*\] a "), _by_regex(rf"\[{_DMY}{_TIME}\] +(?P<l>[A-Za-z]+) +(?P<c>{_NAME}) - {_MESSAGE}", _dmy)),
    Layout("[level] (name) text", re.compile(r"\[a\] \("), _by_regex(rf"\[(?P<l>[A-Za-z]+)\] +\((?P<c>[^)\s]+)\) ?{_MESSAGE}", lambda g, _y: ("", _level(g["l"])))),
    Layout("count|level|name|text", re.compile(r"9\|a\|"), _by_regex(rf"(?P<n>\d{{9,19}})\|(?P<l>[A-Za-z]+)\|(?P<c>[^|\s]+)\|{_MESSAGE}", lambda g, _y: (_epoch(g["n"]), _level(g["l"])))),
]
_LETTERS, _DIGITS, _BLANKS, _WORDS = re.compile(r"[^\W\d_]+"), re.compile(r"\d+"), re.compile(r"\s+"), re.compile(r"(?<![^ ])a(?: a){2,}")


def signature(line: str) -> str:
    """A line's shape signature; colour codes don't count."""
    return _WORDS.sub("a", _BLANKS.sub(" ", _DIGITS.sub("9", _LETTERS.sub("a", _ANSI.sub("", line)))))


def signature_column(line):
    """The same as a column expression."""
    line = F.regexp_replace(line, ANSI, "")
    line = F.regexp_replace(line, r"\p{L}+", "a")
    line = F.regexp_replace(line, r"\p{Nd}+", "9")
    return F.regexp_replace(F.regexp_replace(line, r"(?U)\s+", " "), "(?<![^ ])a(?: a){2,}", "a")


def resolve(shape: str) -> tuple[int, ...]:
    """The numbers of the layouts that a signature may belong to; none for a continuation."""
    return tuple(i for i, layout in enumerate(LAYOUTS) if layout.shape.match(shape))


class Found(NamedTuple):
    line_no: int
    n_lines: int
    entry: Entry
    msg_md5: str
    message: str


def entries(text: str, year: int | None, rules: dict[str, tuple[int, ...]]) -> Iterator[Found]:
    """The entries of one log text. ``rules`` gets the signatures that it lacks."""
    lines = _ANSI.sub("", text).split("\n")
    opened: tuple[int, Entry] | None = None
    last = 0  # the open entry's last line that isn't blank
    for i, line in enumerate([*lines, None]):
        entry = None
        if line is not None:
            if not line.strip():
                continue
            shape = signature(line)
            rule = rules.get(shape)
            if rule is None:
                rule = rules[shape] = resolve(shape)
            for number in rule:
                entry = LAYOUTS[number].read(line.rstrip("\r"), year)
                if entry is not None:
                    break
            if entry is None:
                last = i
                continue
        if opened:
            first, head = opened
            message = "\n".join([head.message, *lines[first + 1 : last + 1]]).replace("\r", "").strip()
            yield Found(first + 1, last - first + 1, head, hashlib.md5(message.encode("utf-8", "replace")).hexdigest(), message)
        opened, last = (i, entry) if entry else None, i


def parse_logs(df: DataFrame, streams: dict[str, str], key: str = "run_id", started: str = "started_at", with_message: bool = False) -> DataFrame:
    """(key, flujo, line_no, n_lines, entry_ts, level, component, msg_md5[, message]) of every entry.

    ``streams`` maps a name to the column with its log text. First every line's signature is counted on the JVM side
    and the MOST_BROADCAST commonest are resolved and broadcast (a rarer one is resolved where it turns up, to the same
    rule). Then each text is read where it lies: no shuffle, and a long text never meets another. Null and empty texts
    and an empty table give no rows, repeated runs keep their own keys, a null start leaves out what needs its year
    (entry_ts is ''), extra columns are ignored.
    """
    spark = df.sparkSession
    key_type = df.schema[key].dataType.simpleString()
    texts = F.array(*[F.struct(F.lit(name).alias("flujo"), F.col(column).alias("log")) for name, column in streams.items()])
    logs = df.select(F.col(key).alias("k"), F.year(F.col(started)).alias("year"), F.explode(texts).alias("x")).select("k", "year", "x.flujo", "x.log").where(F.length("log") > 0)
    lines = logs.select(F.explode(F.split("log", "\n")).alias("line"))
    shapes = lines.select(signature_column(F.col("line")).alias("shape")).groupBy("shape").count()
    commonest = shapes.orderBy(F.desc("count"), "shape").limit(MOST_BROADCAST).collect()
    rules = spark.sparkContext.broadcast({r["shape"]: resolve(r["shape"]) for r in commonest})

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = dict(rules.value)
        for batch in batches:
            rows = []
            for k, year, flujo, log in zip(batch["k"], batch["year"], batch["flujo"], batch["log"], strict=True):
                for x in entries(log, None if year != year or year is None else int(year), known):
                    row = (k, flujo, x.line_no, x.n_lines, x.entry.ts, x.entry.level, x.entry.component, x.msg_md5)
                    rows.append((*row, x.message) if with_message else row)
                if len(known) > 5 * MOST_BROADCAST:
                    known = dict(rules.value)
            yield pd.DataFrame(rows, columns=columns)

    columns = [key, "flujo", "line_no", "n_lines", "entry_ts", "level", "component", "msg_md5", *["message"] * with_message]
    schema = f"`{key}` {key_type}, flujo string, line_no int, n_lines int, entry_ts string, level string, component string, msg_md5 string" + ", message string" * with_message
    return spread(logs).mapInPandas(parse, schema)
