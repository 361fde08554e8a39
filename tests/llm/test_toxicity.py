"""Toxic passages: the scan against brute force, a small fixture, held-out accuracy."""

import random

import numpy as np
from pyspark.sql import functions as F

from conftest import SF_DIR
from dotloom.llm import queries, toxicity


def brute_segments(scores):
    """Maximal segments by definition: the best one (first and shortest), then the same on both sides of it."""
    best = None
    for a in range(len(scores)):
        for b in range(a + 1, len(scores) + 1):
            s = sum(scores[a:b])
            if s > 0 and (best is None or s > best[2]):
                best = (a, b, s)
    if best is None:
        return []
    a, b, _ = best
    return [*brute_segments(scores[:a]), best, *((b + x, b + y, s) for x, y, s in brute_segments(scores[b:]))]


def test_segments_match_brute_force():
    rng = random.Random(5)
    for _ in range(300):
        scores = [rng.choice([-3, -2, -1, 1, 2, 5]) + rng.random() / 100 for _ in range(rng.randrange(14))]
        got, want = toxicity.maximal_segments(np.array(scores)), brute_segments(scores)
        assert [x[:2] for x in got] == [x[:2] for x in want]
        assert np.allclose([x[2] for x in got], [x[2] for x in want])


def test_finds_passages(spark):
    rng = random.Random(6)
    clean = [" ".join(rng.choice("the cat sat on a mat and saw some dogs".split()) for _ in range(80)) for _ in range(120)]
    words = "the cat sat on a mat".split()
    bad = [" ".join([*rng.choices(words, k=40), "rotten", "vermin", "rotten", *rng.choices(words, k=40)]) + f" {i}" for i in range(40)]
    labelled = spark.createDataFrame([(t, 0) for t in clean] + [(t, 1) for t in bad], "text string, y int")
    rows = [(1, clean[0]), (2, bad[0]), (3, None), (4, ""), (5, "calm " * 3000 + "rotten vermin rotten " + "calm " * 9), (6, "12 !!"), (None, "Rotten, VERMIN!")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, passages string")
    got = toxicity.detect(docs, labelled).collect()
    assert [r.score >= 0.7 for r in got if r.doc_id not in (5, 6)] == [False, True, False, False, True]
    assert got[5].score < got[4].score < got[1].score  # the same passage says less in a long text
    assert got[2].score == got[3].score == got[5].score and all(0 <= r.score <= 1 for r in got)
    assert [(p.start, p.end) for p in got[1].passages] == [(40, 43)]
    assert [(p.start, p.end) for p in got[4].passages] == [(3000, 3003)]
    assert not got[0].passages and not got[2].passages
    assert toxicity.detect(docs.limit(0), labelled).count() == 0
    assert all(not r.passages and r.score < 0.7 for r in toxicity.detect(docs, labelled.limit(0)).collect())


def test_all_passages_of_long_texts_count(spark):
    rng = random.Random(6)
    clean = [" ".join(rng.choice("the cat sat on a mat and saw some dogs".split()) for _ in range(80)) for _ in range(120)]
    words = "the cat sat on a mat".split()
    bad = [" ".join([*rng.choices(words, k=40), "rotten", "vermin", "rotten", *rng.choices(words, k=40)]) + f" {i}" for i in range(40)]
    labelled = spark.createDataFrame([(t, 0) for t in clean] + [(t, 1) for t in bad], "text string, y int")
    rows = [(1, clean[0]), (2, bad[0]), (5, "calm " * 3000 + "rotten vermin rotten " + "calm " * 9), (7, "Rotten, VERMIN!")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.train(docs, labelled)
    got = {r.doc_id: r for r in docs.select("doc_id", toxicity.scored(F.col("text"), model, spark).alias("r")).select("doc_id", "r.*").collect()}
    assert [(p.start, p.end) for p in got[5].passages] == [(3000, 3003)]
    assert got[1].score < 0.7 <= got[5].score < got[2].score
    # in 20,000 words one such passage may be chance, five are not, though none is significant by itself
    s = got[5].passages[0].score
    assert model.expectation(20_000, s) > toxicity.PASSAGE_EXPECTATION
    assert model.probability(20_000, []) < model.probability(20_000, [s]) < 0.7 <= model.probability(20_000, [s] * 5)


def test_lexicon_has_no_cap_but_a_least_effect(spark):
    many = spark.range(60_000).selectExpr("concat('w', id) AS feature", "40L AS n", "40L AS toxic", "0L AS clean")
    # significant by their number, but hardly more frequent in toxic documents
    dull = spark.range(5).selectExpr("concat('d', id) AS feature", "4200000L AS n", "2200000L AS toxic", "2000000L AS clean")
    scores, rate = toxicity.lexicon(many.union(dull))
    assert len(scores) == 60_000 and min(scores.values()) >= toxicity.LEAST_LOG_ODDS and rate > 0


def test_labels(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d"), (4, "e")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (None, 1), (4, None)], "doc_id long, toxic int")
    assert sorted(map(tuple, toxicity.labelled_texts(docs, labels).collect())) == [("a", 1), ("b", 1), ("c", 0)]


def test_held_out_accuracy(spark):
    sf_dir = SF_DIR.replace("sf0.001", "sf0.01")
    got = queries.op10_toxicity(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert all(r.predicted == (r.score >= 0.7) for r in got)
    assert not any(r.predicted for r in held if not r.toxic)
    assert sum(r.predicted for r in held if r.toxic) >= 0.6 * sum(r.toxic for r in held)
