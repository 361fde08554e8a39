"""Packing: exact round trip, best fit against a linear search."""

import random
from collections import defaultdict

import numpy as np
import public_tokenizers

from conftest import SF_DIR
from dotloom.llm import packing, queries, tokencount


def naive(lengths, most):
    rows, left = [], []
    for k in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        fits = [i for i in range(len(rows)) if left[i] >= lengths[k]]
        i = min(fits, key=lambda i: left[i], default=None)
        if i is None:
            rows.append([])
            left.append(most)
            i = len(rows) - 1
        rows[i].append(k)
        left[i] -= lengths[k]
    return rows, left


def test_best_fit():
    rng = random.Random(2)
    for most in (1, 2, 7, 8, 63, 64, 100):
        for _ in range(40):
            lengths = [rng.randint(1, most) for _ in range(rng.randrange(60))]
            rows = packing.best_fit_decreasing(lengths, most)
            assert sorted(k for r in rows for k in r) == list(range(len(lengths)))
            free = sorted(most - sum(lengths[k] for k in r) for r in rows)
            assert free == sorted(naive(lengths, most)[1])


def unpacked(rows, row_tokens):
    """doc_id -> list of (offset, ids), after checking every row."""
    out = defaultdict(list)
    for r in rows:
        ids, positions = np.frombuffer(r.ids, "<u2"), np.frombuffer(r.positions, "<u2")
        assert len(ids) == len(positions) == row_tokens and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens
        assert (ids[r.n_tokens :] == 50256).all()
        for a, b, doc, at in zip(r.cu_seqlens, r.cu_seqlens[1:], r.doc_ids, r.offsets):
            assert (positions[a:b] == np.arange(b - a)).all()
            out[doc].append((at, ids[a:b].tolist()))
    return out


def ids_of(text):
    return [*tokencount.ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")).encode_ordinary(text), 50256]


def test_round_trip(spark):
    texts = {1: "short text", 2: None, 3: "", 4: "word " * 5000, 5: "a <|endoftext|> b", 6: "日本語 " * 50, None: "no id"}
    docs = spark.createDataFrame([(i, t, "x") for i, t in texts.items()] + [(1, "short text", "y")], "doc_id long, text string, ids string")
    rows = packing.pack(docs, row_tokens=64).collect()
    assert len({r.pack_id for r in rows}) == len(rows)
    got = unpacked(rows, 64)
    assert got.keys() == {1, 4, 5, 6, None}
    assert sorted(got[1]) == [(0, ids_of("short text"))] * 2
    for i in (4, 5, 6, None):
        assert sum((ids for _, ids in sorted(got[i])), []) == ids_of(texts[i])
    assert packing.pack(docs.limit(0)).count() == 0


def test_query(spark):
    rows = queries.op4_packing(spark, SF_DIR).collect()
    got = unpacked(rows, packing.ROW_TOKENS)
    for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect():
        if r.text:
            assert sum((ids for _, ids in sorted(got[r.doc_id])), []) == ids_of(r.text)
    assert sum(r.n_tokens for r in rows) > 0.95 * packing.ROW_TOKENS * (len(rows) - 8)
