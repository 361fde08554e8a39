"""Language identification against brute force over segmentations, and held-out accuracy."""

import math

import numpy as np
import pytest

from conftest import SF_DIR
from dotloom.llm import langid, queries


def segmentations(word):
    """All ways to cut a word, as lists of pieces."""
    if not word:
        return [[]]
    return [[word[:k], *rest] for k in range(1, len(word) + 1) for rest in segmentations(word[k:])]


@pytest.fixture(scope="module")
def own():
    p = langid.pieces(langid.default_vocabulary())
    hashes = {int(h): int(i) for h, i in zip(p.hashes, p.ids)}
    rng = np.random.default_rng(3)
    table = rng.random((p.n, 2))
    return p, hashes, table / table.sum(axis=0)


WORDS = ["the", "und", "été", "straße", "a", "ж", "語", "x語y"]


def test_forward_sums_all_segmentations(own):
    p, hashes, table = own
    got = langid.log_probabilities(WORDS, langid.default_vocabulary(), table)
    for w, row in zip(WORDS, got):
        for lang in (0, 1):
            total = 0.0
            for parts in segmentations(langid.BEGIN + w):
                ids = [hashes.get(p._hash(x), -1) for x in parts]
                if all(i >= 0 or len(x) == 1 for i, x in zip(ids, parts)):
                    total += math.prod(table[i, lang] if i >= 0 else langid.LEAST for i in ids)
            assert math.isclose(row[lang], math.log(total), rel_tol=1e-9), w


def test_expected_counts_sum_all_segmentations(own):
    p, hashes, table = own
    n = np.arange(1.0, len(WORDS) + 1)
    got = langid.expected_counts(WORDS, n, langid.default_vocabulary(), table[:, 0])
    want = np.zeros(p.n)
    for w, k in zip(WORDS, n):
        ways = [[hashes.get(p._hash(x), -1) if len(x) > 0 else 0 for x in parts] for parts in segmentations(langid.BEGIN + w)]
        lengths = [[len(x) for x in parts] for parts in segmentations(langid.BEGIN + w)]
        weights = [math.prod(table[i, 0] if i >= 0 else langid.LEAST * (m == 1) for i, m in zip(ids, ms)) for ids, ms in zip(ways, lengths)]
        for ids, weight in zip(ways, weights):
            for i in ids:
                if i >= 0:
                    want[i] += k * weight / sum(weights)
    assert np.allclose(got, want)


def test_edges(spark):
    labelled = spark.createDataFrame([("en", "the house and the garden"), ("fr", "la maison et le jardin"), (None, "das Haus"), ("en", None)], "lang string, text string")
    rows = [(1, "The garden"), (2, "le jardin"), (3, None), (4, ""), (5, "12 -- ²"), (6, "the " * 40_000), (6, "the " * 40_000), (None, "語" * 5000)]
    docs = spark.createDataFrame([(i, t, 9.0) for i, t in rows], "doc_id long, text string, score double")
    got = [(r.doc_id, r.lang_pred, r.score) for r in langid.identify(docs, labelled).collect()]
    assert [x[:2] for x in got[:5]] == [(1, "en"), (2, "fr"), (3, "und"), (4, "und"), (5, "und")]
    assert got[5] == got[6] and got[5][1] == "en" and 0.99 < got[5][2] <= 1 and got[2][2] == 0
    assert got[7][1] == "en" and got[7][2] >= 0.5
    assert langid.identify(docs.limit(0), labelled).count() == 0
    assert {r.lang_pred for r in langid.identify(docs, labelled.limit(0)).collect()} == {"und"}


def test_held_out_accuracy(spark):
    got = queries.op3_language_id(spark, SF_DIR).join(spark.read.parquet(f"{SF_DIR}/documents.parquet"), "doc_id").collect()
    assert len(got) == spark.read.parquet(f"{SF_DIR}/documents.parquet").count()
    held = [r for r in got if r.held_out]
    assert len(held) > 40 and all(0 <= r.score <= 1 for r in got)
    assert sum(r.lang == r.lang_pred for r in held) >= 0.95 * len(held)
