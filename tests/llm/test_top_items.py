import math
import random

import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st

from pricelens.llm.top_items import order_code, top_n

SCHEMA = "id bigint, a string, b string, score double, price double, g0 string, c0 bigint, need int"


def brute(rows, n):
    groups = {}
    for i, a, b, s, p, *_ in rows:
        if a is not None and b is not None and s is not None and not math.isnan(s):
            last = p is None or math.isnan(p)
            groups.setdefault((a, b), []).append((-s, last, 0 if last else p, i))
    return sorted((*g, k + 1, x[3]) for g, xs in groups.items() for k, x in enumerate(sorted(xs)[:n]))


def run(spark, rows, n=3):
    df = spark.createDataFrame(rows, SCHEMA)
    return sorted(tuple(r) for r in top_n(df, ["a", "b"], "score", [("price", False)], "id", n).collect())


@given(st.lists(st.floats(allow_nan=False) | st.just(-0.0), min_size=2, max_size=30))
@settings(max_examples=60, deadline=None)
def test_codes_keep_order(xs):
    codes = order_code(pd.Series(xs))
    assert all((xs[i] < xs[j]) == (codes[i] < codes[j]) and (xs[i] == xs[j]) == (codes[i] == codes[j]) for i in range(len(xs)) for j in range(len(xs)))


def test_against_brute_force(spark):
    rng = random.Random(1)
    rows = []
    for i in range(1500):
        a = rng.choice(["hot"] * 6 + ["x", "y", "z", None])
        score = rng.choice([None, math.nan, 1e300, -1e300, 0.0, -0.0, rng.random(), rng.randrange(4), rng.randrange(3) / 8])
        price = rng.choice([None, math.nan, rng.randrange(3), rng.random() * 1e9])
        rows.append((i, a, rng.choice(["p", "p", "p", "q", None]), score, None if price is None else float(price), "g", 7, 9)[:8])
    rows = [tuple(float(v) if j in (3, 4) and v is not None else v for j, v in enumerate(r)) for r in rows]
    for n in (1, 3, 40):
        assert run(spark, rows, n) == brute(rows, n)


def test_odd_tables(spark):
    assert run(spark, []) == []
    same = [(5, "a", "b", 1.0, None, None, None, None)] * 7
    assert run(spark, same) == [("a", "b", 1, 5), ("a", "b", 2, 5), ("a", "b", 3, 5)]
    assert run(spark, [(1, None, None, None, None, None, None, None)]) == []
    ties = [(i, "a", "b", 2.0, 3.0, "x", 0, 0) for i in range(300)]
    assert run(spark, ties) == [("a", "b", 1, 0), ("a", "b", 2, 1), ("a", "b", 3, 2)]
