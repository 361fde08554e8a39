"""Top k by the bit-sliced index against brute force."""

import numpy as np
from check import compare_sql, duck

from conftest import SF_DIR
from dotloom.llm import queries, topk


def brute(values, ids, q, k, own):
    scored = sorted((-int(v @ q), int(i)) for v, i in zip(values, ids) if i != own)
    return [(-s, i) for s, i in scored[:k]]


def test_index():
    rng = np.random.default_rng(4)
    for n in (1, 2, 5, 63, 64, 65, 700):
        for spread in (0, 1, 3, 40, 5000):
            values = rng.integers(-spread, spread + 1, (n, 6))
            ids = rng.permutation(n)
            index = topk.Index(values)
            for own in range(min(n, 5)):
                q = rng.integers(-spread, spread + 1, 6)
                assert index.top(q, 5, ids, own) == brute(values, ids, q, 5, own), (n, spread)


def test_digits():
    for value in range(-300, 300):
        assert sum(s << p for p, s in topk.digits(value)) == value


def test_nulls_ties_and_empty_table(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [0.5, 0.5]), (50, [1.0]), (50, [1.0]), (1, [0.5, 0.5]), (2, None), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [None, 1.0]),
            (6, []), (None, [1.0, 1.0]), (100, None), (7, [0.5, 0.5]), (7, [0.5, 0.5])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, rank string")
    v = df.select("vec_id", "rank", topk.integers(df.embedding).alias("v"))
    got = sorted(map(tuple, topk.top_k(v, v.where("vec_id % 50 = 0")).collect()))
    assert got == [
        (0, 1, 1, 32768), (0, 2, 7, 32768), (0, 3, 7, 32768), (0, 4, 50, 32768), (0, 5, 50, 32768),
        (50, 1, 0, 32768), (50, 2, 1, 32768), (50, 3, 7, 32768), (50, 4, 7, 32768), (50, 5, 6, 0),
    ]
    assert topk.top_k(v.limit(0), v).count() == topk.top_k(v, v.limit(0)).count() == 0


def test_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "ROWS", 100)
    monkeypatch.setattr(topk, "QUERIES", 3)
    test_query(spark)


def test_query(spark):
    line = compare_sql(spark, duck(SF_DIR), "op9_top_k", queries.op9_top_k, queries.ORACLES["op9_top_k"], SF_DIR)
    assert line.startswith("OK"), line
