"""The n-gram join against brute force over all pairs."""

import random

import numpy as np
import pytest
from check import compare_sql, duck

from conftest import SF_DIR
from dotloom.llm import ngramjoin, queries


def brute(rows, width, num, den):
    """doc_id -> (size, least reachable id), by comparing all pairs."""
    sets = {}
    for i, t in rows:
        w = [x.lower() for x in (t or "").split()]
        sets[i] = {tuple(w[j : j + width]) for j in range(max(1, len(w) - width + 1))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            k = len(sets[a] & sets[b])
            if a < b and k and den * k >= num * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


def corpus(seed):
    """Chains and clusters of near copies of many lengths, and small sets of few words."""
    rng, out = random.Random(seed), []
    for n in [1, 2, 3, 5, 8, 11, 12, 15, 20, 26, 33, 47, 60, 90, 150, 400]:
        for _ in range(2):
            words = [f"w{rng.randrange(4 + n)}" for _ in range(n)]
            for _ in range(7):
                out.append(" ".join(words))
                for _ in range(rng.randrange(3)):
                    words[rng.randrange(n)] = f"w{rng.randrange(4 + n)}"
                if rng.random() < 0.3:
                    words.insert(rng.randrange(n), "more")
                    n += 1
    out += ["", " \n", "A b C", "a B c", "a b c d"] * 2
    rng.shuffle(out)
    return list(enumerate(out, 100))


@pytest.mark.parametrize("width,num", [(3, 90), (5, 80), (1, 60)])
def test_components(spark, width, num):
    rows = corpus(width)
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, node string")
    got = ngramjoin.join_documents(docs, width, num, 100, keep_signatures=width == 3)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == brute(rows, width, num, 100)


def test_linked_sets_share_a_signature():
    rng = np.random.default_rng(1)
    for num in (80, 90):
        s = ngramjoin.scheme(num, 100)
        for n in [*range(5, 60), 100, 333, 1000]:
            for _ in range(6):
                a = np.unique(rng.integers(1, 1 << 63, n).astype(np.uint64))
                kept = a[: len(a) - int(rng.integers(0, max(1, n * (100 - num) // 100) + 1))]
                b = np.unique(np.concatenate([kept, rng.integers(1, 1 << 63, int(rng.integers(0, n // 20 + 1))).astype(np.uint64)]))
                k = len(np.intersect1d(a, b))
                if 100 * k >= num * (len(a) + len(b) - k) and len(a) != len(b):
                    assert np.intersect1d(s.signatures(a), s.signatures(b)).size, (num, n)


def test_nulls_repeats_and_empty_table(spark):
    rows = [(None, "a b c d"), (3, "a b c d"), (3, "a b c d"), (4, None), (None, None), (None, "only here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, ngramjoin.join_documents(docs, 3, 90, 100).collect()), key=str)
    assert got == sorted([(None, 2, 3), (3, 2, 3), (3, 2, 3), (4, 0, 4), (None, 0, None), (None, 1, None)], key=str)
    assert ngramjoin.join_documents(docs.limit(0)).count() == 0


def test_query(spark):
    line = compare_sql(spark, duck(SF_DIR), "op7_ngram_join", queries.op7_ngram_join, queries.ORACLES["op7_ngram_join"], SF_DIR)
    assert line.startswith("OK"), line
