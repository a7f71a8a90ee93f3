"""Nested JSON records into related flat tables by interval labels.

A depth-first walk numbers every node on the way in (pre-order) and on the way out (post-order). Node a holds node b
exactly if ``a.pre < b.pre and b.post < a.post``, so that one sweep over the nodes in pre-order with a stack of the open
intervals links every node to its nearest holder of any type, however deep it lies and whatever lies between.
"""

from __future__ import annotations

import json
import re
from json.decoder import scanstring
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricelens.session import spread


class Node(NamedTuple):
    kind: str
    key: str
    pre: int
    post: int
    price: int


#: Types of nodes: the field that makes an object a node of the type.
OBJECT_KEYS = {"productId": "product", "skuId": "item", "promotionId": "promotion"}
#: The field that lists categories, as ids, as objects with an id or as a path.
CATEGORY_FIELD = "categories"
#: relation -> type of its parent ('' for none)
PARENTS = {"product": "", "category": "product", "item": "product", "promotion": "item"}
ABSENT_PRICE = -1


def _text(value) -> str | None:
    """An id as text; None for what can't be one."""
    if isinstance(value, bool) or value is None:
        return None
    if isinstance(value, float):
        value = int(value) if value == value and abs(value) < 1e18 and value == int(value) else value
    if isinstance(value, (str, int, float)):
        return str(value).strip() or None
    return None


def read_price(value) -> int:
    """Pesos out of a number, a text with currency sign and thousands marks, or an object that holds the value."""
    if isinstance(value, dict):
        value = value.get("value")
    if isinstance(value, bool) or value is None:
        return ABSENT_PRICE
    if isinstance(value, (int, float)):
        return int(value + 0.5) if 0 <= value < 1e15 else ABSENT_PRICE
    if isinstance(value, str):
        text = re.sub(r"[^\d.,]", "", value)
        text = re.sub(r"[.,]\d{1,2}$", "", text) if re.search(r"[.,]\d{1,2}$", text) else text
        digits = re.sub(r"\D", "", text)
        return int(digits) if digits and len(digits) < 16 else ABSENT_PRICE
    return ABSENT_PRICE


def _no_constant(name: str):
    raise ValueError(name)


_SCALAR = re.compile(r"(-?(?:0|[1-9]\d*))(\.\d+)?([eE][+-]?\d+)?|true|false|null")
_BLANK = re.compile(r"[ \t\n\r]*")
_LITERALS = {"true": True, "false": False, "null": None}


def read_deep(text: str):
    """The value of a JSON text, read with a stack, so that no depth is too much. ValueError for anything else."""
    open_values: list = []
    keys: list[str] = []
    root: list = []
    at, wanted = 0, "value"

    def put(x) -> None:
        holder = open_values[-1] if open_values else root
        if isinstance(holder, dict):
            holder[keys.pop()] = x
        else:
            holder.append(x)

    while True:
        at = _BLANK.match(text, at).end()
        c = text[at : at + 1]
        if wanted == "more" and not open_values:
            if c:
                raise ValueError("more than one value")
            return root[0]
        if not c:
            raise ValueError("cut off")
        closing = open_values and c == ("}" if isinstance(open_values[-1], dict) else "]")
        if closing and wanted in ("more", "first key", "first value"):
            open_values.pop()
            at, wanted = at + 1, "more"
        elif wanted == "more":
            if c != ",":
                raise ValueError(c)
            at, wanted = at + 1, "key" if isinstance(open_values[-1], dict) else "value"
        elif wanted in ("key", "first key"):
            if c != '"':
                raise ValueError(c)
            key, at = scanstring(text, at + 1)
            at = _BLANK.match(text, at).end()
            if text[at : at + 1] != ":":
                raise ValueError("no value")
            keys.append(key)
            at, wanted = at + 1, "value"
        elif c in "{[":
            new: dict | list = {} if c == "{" else []
            put(new)
            open_values.append(new)
            at, wanted = at + 1, "first key" if c == "{" else "first value"
        elif c == '"':
            string, at = scanstring(text, at + 1)
            put(string)
            wanted = "more"
        else:
            m = _SCALAR.match(text, at)
            if not m:
                raise ValueError(c)
            put(_LITERALS[m[0]] if m[1] is None else float(m[0]) if m[2] or m[3] else int(m[0]))
            at, wanted = m.end(), "more"


def read_json(text: str | None):
    """The value of a text that is one whole JSON value; ValueError for anything else."""
    if not text:
        raise ValueError("empty")
    try:
        return json.loads(text.lstrip("\ufeff"), parse_constant=_no_constant)
    except RecursionError:
        return read_deep(text.lstrip("\ufeff"))


def _embedded(value):
    """JSON that was put into a string once more counts as what it holds."""
    while isinstance(value, str) and value.lstrip()[:1] in ("[", "{"):
        try:
            value = read_json(value)
        except ValueError:
            return value
    return value


def label_nodes(value) -> list[Node]:
    """Every typed node of a JSON value with its interval, in pre-order."""
    nodes: list[list] = []
    clock = 0
    # entries: ("visit", value) | ("category", value) | ("close", index of the node)
    todo: list[tuple[str, object]] = [("visit", value)]
    while todo:
        action, x = todo.pop()
        if action == "close":
            clock += 1
            nodes[x][3] = clock
            continue
        x = _embedded(x)
        if action == "category":
            if isinstance(x, list):
                todo.extend(("category", y) for y in reversed(x))
            elif isinstance(x, dict):
                todo.append(("category", x.get("id")))
            elif isinstance(x, str) and "/" in x:
                todo.extend(("category", y) for y in reversed(x.split("/")))
            elif key := _text(x):
                clock += 2
                nodes.append(["category", key, clock - 1, clock, ABSENT_PRICE])
            continue
        if isinstance(x, list):
            todo.extend(("visit", y) for y in reversed(x) if isinstance(y, (dict, list, str)))
        elif isinstance(x, dict):
            for field, kind in OBJECT_KEYS.items():
                if key := _text(x.get(field)):
                    clock += 1
                    todo.append(("close", len(nodes)))
                    nodes.append([kind, key, clock, 0, read_price(x.get("price")) if kind == "item" else ABSENT_PRICE])
            for field, y in reversed(x.items()):
                if field == CATEGORY_FIELD:
                    todo.append(("category", y))
                elif isinstance(y, (dict, list)) or isinstance(y, str) and y.lstrip()[:1] in ("[", "{"):
                    todo.append(("visit", y))
    return [Node(*n) for n in nodes]


def link_nodes(nodes: list[Node]) -> list[tuple[str, str, str, int]]:
    """(rel, parent_id, child_id, price) of each node that has the holder its relation needs, each row once.

    ``nodes`` come in pre-order. An open interval whose end lies before a node's start can hold neither that node nor
    a later one, so each is pushed and popped once.
    """
    open_intervals: list[Node] = []
    rows: dict[tuple[str, str, str, int], None] = {}
    for node in nodes:
        while open_intervals and open_intervals[-1].post < node.pre:
            open_intervals.pop()
        wanted = PARENTS[node.kind]
        if not wanted:
            rows[node.kind, "", node.key, ABSENT_PRICE] = None
        else:
            holder = next((o for o in reversed(open_intervals) if o.kind == wanted and o.post > node.post), None)
            if holder:
                rows[node.kind, holder.key, node.key, node.price] = None
        if node.kind != "category":
            open_intervals.append(node)
    return list(rows)


def _clean(text: str) -> str:
    return text.encode("utf-8", "replace").decode()


def node_table(df: DataFrame, key: str = "payload_id", payload: str = "payload") -> DataFrame:
    """(key, kind, node_id, pre, post, price): every labelled node, the base of one table per kind.

    Payloads that are null, empty, cut off or no JSON give no rows; extra columns are ignored.
    """
    key_type = df.schema[key].dataType.simpleString()

    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, text in zip(batch["k"], batch["p"], strict=True):
                try:
                    rows += [(k, n.kind, _clean(n.key), n.pre, n.post, n.price) for n in label_nodes(read_json(text))]
                except ValueError:
                    continue
            yield pd.DataFrame(rows, columns=[key, "kind", "node_id", "pre", "post", "price"])

    source = df.where(F.col(payload).isNotNull()).select(F.col(key).alias("k"), F.col(payload).alias("p"))
    return source.mapInPandas(label, f"`{key}` {key_type}, kind string, node_id string, pre int, post int, price bigint")


def flatten_nested(df: DataFrame, key: str = "payload_id", payload: str = "payload") -> DataFrame:
    """(key, rel, parent_id, child_id, price): the nodes linked to their nearest holder, each distinct row once a record.

    A record is walked and linked where it lies: no shuffle, however records and products are spread. Null, empty,
    cut-off and non-JSON payloads and an empty table give no rows; repeated payloads keep their own keys; optional
    fields of any type (numbers, texts, objects, lists, JSON inside a string) are read alike; extra columns are ignored.
    """
    key_type = df.schema[key].dataType.simpleString()

    def flatten(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, text in zip(batch["k"], batch["p"], strict=True):
                try:
                    links = link_nodes(label_nodes(read_json(text)))
                except ValueError:
                    continue
                rows += [(k, rel, _clean(parent), _clean(child), price) for rel, parent, child, price in links]
            yield pd.DataFrame(rows, columns=[key, "rel", "parent_id", "child_id", "price"])

    source = df.where(F.col(payload).isNotNull()).select(F.col(key).alias("k"), F.col(payload).alias("p"))
    return spread(source).mapInPandas(flatten, f"`{key}` {key_type}, rel string, parent_id string, child_id string, price bigint")


def link_by_containment(nodes: DataFrame, parent: str, child: str, key: str = "payload_id") -> DataFrame:
    """The same links as a join of two node tables on the record and interval containment (nearest holder wins)."""
    holders = nodes.where(F.col("kind") == parent).select(key, F.col("node_id").alias("parent_id"), F.col("pre").alias("p_pre"), F.col("post").alias("p_post"))
    held = nodes.where(F.col("kind") == child)
    pairs = held.join(holders, key).where((F.col("p_pre") < F.col("pre")) & (F.col("post") < F.col("p_post")))
    nearest = pairs.groupBy(key, "pre").agg(F.max_by(F.struct("parent_id", "node_id", "price"), "p_pre").alias("x"))
    return nearest.select(key, F.lit(child).alias("rel"), "x.parent_id", F.col("x.node_id").alias("child_id"), "x.price").distinct()
