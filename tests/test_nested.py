import json

import pytest

from pricelens.operators.nested import flatten_nested, label_nodes, link_by_containment, link_nodes, node_table, read_json, read_price

PAYLOAD = {
    "data": {"products": [
        {"productId": 1, "categories": ["10", {"id": "11", "name": "x"}, 12], "items": [{"skuId": "a", "price": "$ 1.290", "promotions": [{"promotionId": "P1", "tiers": [{"price": 5}]}]}]},
        {"productId": "2", "categories": "/20/21/", "items": json.dumps([{"skuId": 7, "price": {"value": 300}}]), "variant": [{"items": [{"skuId": "b", "price": None}]}]},
        {"productId": "1", "categories": None, "items": {"skuId": "a", "price": 1290.0}},
    ]}
}
ROWS = {
    ("product", "", "1", -1), ("product", "", "2", -1), ("category", "1", "10", -1), ("category", "1", "11", -1), ("category", "1", "12", -1), ("category", "2", "20", -1), ("category", "2", "21", -1),
    ("item", "1", "a", 1290), ("item", "2", "7", 300), ("item", "2", "b", -1), ("promotion", "a", "P1", -1),
}


def test_links():
    rows = link_nodes(label_nodes(PAYLOAD))
    assert set(rows) == ROWS and len(rows) == len(ROWS)


def test_intervals_nest():
    nodes = label_nodes(PAYLOAD)
    assert [n.pre for n in nodes] == sorted(n.pre for n in nodes)
    for a in nodes:
        for b in nodes:
            assert a is b or a.post < b.pre or b.post < a.pre or (a.pre < b.pre and b.post < a.post) or (b.pre < a.pre and a.post < b.post)


@pytest.mark.parametrize("value, pesos", [(5, 5), ("161890", 161890), ("$ 172.890", 172890), ("205990.0", 205990), (205990.0, 205990), ({"value": "1.000"}, 1000), (None, -1), ("", -1), (True, -1), ([1], -1), (-4, -1), (float("nan"), -1)])
def test_price(value, pesos):
    assert read_price(value) == pesos


@pytest.mark.parametrize("text", ["", None, "<html>", '{"a": [', '{"a": NaN}', '{"a":1} x', "[" * 100_000])
def test_not_whole(text):
    with pytest.raises(ValueError):
        read_json(text)


def test_operator_and_join_agree(spark):
    text = "﻿" + json.dumps(PAYLOAD)
    schema = "payload_id bigint, payload string, k string, p string"
    rows = [(1, text, "x", "y"), (1, None, None, None), (2, text[:-3], None, None), (3, "", None, None), (4, '{"productId": "\\ud800"}', None, None), (5, "null", None, None)]
    df = spark.createDataFrame(rows, schema)
    got = [tuple(r) for r in flatten_nested(df).collect()]
    assert {r[1:] for r in got if r[0] == 1} == ROWS and {r[0] for r in got} == {1, 4}
    nodes = node_table(df.where("payload_id = 1"))
    for parent, child in (("product", "item"), ("product", "category"), ("item", "promotion")):
        assert {tuple(r)[1:] for r in link_by_containment(nodes, parent, child).collect()} == {r for r in ROWS if r[0] == child}
    assert flatten_nested(spark.createDataFrame([], schema)).count() == 0


def test_any_depth_is_read():
    import json

    from pricelens.operators.nested import label_nodes, link_nodes, read_deep, read_json
    from pricelens.sources.payloads import products_in

    for text in ('{"a": [1, -2.5e3, "x\\u00e9", true, null, {}, []], "b": {"c": []}}', "[]", '"x"', " 7 "):
        assert read_deep(text) == json.loads(text)
    for text in ("", "[1,]", "{", '{"a"}', "[1] 2", '{"a":1,}', "nul", "[1 2]"):
        with pytest.raises(ValueError):
            read_deep(text)
    inner = '{"productId": "p1", "items": [{"skuId": "s1", "price": 990}]}'
    deep = '{"x": [' * 20_000 + inner + "]}" * 20_000
    rows = link_nodes(label_nodes(read_json(deep)))
    assert ("product", "", "p1", -1) in rows and ("item", "p1", "s1", 990) in rows
    assert products_in(read_json('[{"sku": "1", "name": "a", "x": ' + deep + '}, {"sku": "2", "name": "b", "price": 5}]'))[1][0] == "2"
