"""Raking against plain iterative proportional fitting, and the sample's totals."""

import random
import re

import numpy as np
from pyspark.sql import functions as F

from conftest import SF_DIR
from dotloom.llm import mixing, queries


def test_rake_meets_targets(spark):
    rng = random.Random(9)
    cells = [(s, g, rng.randrange(1, 500)) for s in "abcd" for g in "xyz" if rng.random() < 0.9]
    targets = {"s": dict(zip("abcd", (0.4, 0.3, 0.2, 0.1))), "g": dict(zip("xyz", (0.5, 0.25, 0.25)))}
    df = spark.createDataFrame(cells, "s string, g string, observed long")
    tables = {d: spark.createDataFrame(list(t.items()), f"{d} string, share double") for d, t in targets.items()}
    got = {(r.s, r.g): r.fitted for r in mixing.rake(df, tables, keep=1e-6, tolerance=1e-9, rounds=40).collect()}
    w = {(s, g): float(n) for s, g, n in cells}
    total = sum(w.values())
    for _ in range(200):
        for k, d in enumerate("sg"):
            for v, share in targets[d].items():
                have = sum(x for c, x in w.items() if c[k] == v)
                w |= {c: x * share * total / have for c, x in w.items() if c[k] == v}
    assert all(np.isclose(got[c], w[c], rtol=1e-5) for c in w)


def test_sample(spark):
    rows = [(i, f"text {i}", "big" if i % 3 else "small", None if i % 5 < 2 else "en", "x", 100) for i in range(6000)]
    rows += [(None, None, None, None, None, 0), (7, "twice", "small", "en", "x", 1), (7, "twice", "small", "en", "x", 1)]
    docs = spark.createDataFrame([(*r, "own") for r in rows], "doc_id long, text string, source string, lang string, topic string, n_tokens long, ratio string")
    got = mixing.mixed_sample(docs, temper=0.0).collect()
    tokens = sum(r.n_tokens for r in got)
    assert abs(tokens / 600_000 - mixing.KEEP) < 0.03
    assert abs(sum(r.n_tokens for r in got if r.source == "small") / tokens - 0.5) < 0.03
    assert abs(sum(r.n_tokens for r in got if r.lang is None) / tokens - 0.5) < 0.03
    assert all(r.probability <= 1 for r in got) and sum(r.doc_id == 7 and r.text == "twice" for r in got) in (0, 2)
    assert mixing.mixed_sample(docs.limit(0)).count() == 0
    assert mixing.mixed_sample(docs.where("n_tokens = 0")).count() <= 1


def plain_probabilities(docs):
    """Probability of every (source, lang, topic) by plain bounded fitting with the production parameters."""
    cells = {}
    for r in docs:
        key = (r.source, r.lang, r.topic)
        cells[key] = cells.get(key, 0) + r.n_tokens
    total = sum(cells.values())
    shares = []
    for k in range(3):
        sums = {}
        for key, n in cells.items():
            sums[key[k]] = sums.get(key[k], 0) + n
        powers = {v: n**mixing.TEMPER for v, n in sums.items() if n}
        shares.append({v: x / sum(powers.values()) for v, x in powers.items()})
    w = {k: float(n) for k, n in cells.items()}
    for _ in range(mixing.ROUNDS):
        before = dict(w)
        for k in range(3):
            have = {}
            for key, x in w.items():
                have[key[k]] = have.get(key[k], 0.0) + x
            w = {
                key: min(x * shares[k].get(key[k], 0.0) * total / have[key[k]] if have[key[k]] else 0.0, cells[key] / mixing.KEEP)
                for key, x in w.items()
            }
        if max(abs(w[k] / max(before[k], 1e-12) - 1) for k in w) < mixing.TOLERANCE:
            break
    return {k: min(1.0, mixing.KEEP * (w[k] / n if n else 1.0)) for k, n in cells.items()}


def test_query(spark):
    """Every row of the query has the probability of plain fitting, and every other document drew more than its own."""
    got = {r.doc_id: r for r in queries.op8_mixing(spark, SF_DIR).collect()}
    docs = mixing.described(spark.read.parquet(f"{SF_DIR}/documents.parquet"))
    chance = F.pmod(F.xxhash64("doc_id", "text", F.lit("mix")), F.lit(1 << 53)) / float(1 << 53)
    rows = docs.withColumn("chance", chance).collect()
    want = plain_probabilities(rows)
    for r in rows:
        p = want[r.source, r.lang, r.topic]
        assert r.n_tokens == len(re.findall(mixing.PIECES, r.text or "", re.A))
        assert (r.doc_id in got) == (r.chance < p) or abs(r.chance - p) < 1e-9
        assert r.doc_id not in got or np.isclose(got[r.doc_id].probability, p, rtol=1e-9)


def test_gaps(spark):
    fitted = spark.createDataFrame([("a", 3.0), ("b", 1.0)], "s string, fitted double")
    targets = {"s": spark.createDataFrame([("a", 0.5)], "s string, share double")}
    assert sorted(map(tuple, mixing.gaps(fitted, targets).collect())) == [("s", "a", 0.5, 0.75), ("s", "b", None, 0.25)]


def test_names_that_operators_use(spark):
    """Columns with the names of helper columns come through every operator as they were."""
    from dotloom.llm import langid, linededup, ngramjoin, toxicity

    text = "one line of text that is long enough to be compared\nand another line that is long enough as well"
    rows = [(i, f"{text} {i}", "en", "s", "A", "B", "C", "D", "E", "F") for i in range(4)]
    names = ["_key", "_lang", "_ld_gone", "_told", "_scored", "_predicted"]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, " + ", ".join(f"{n} string" for n in names))
    own = lambda df: sorted({tuple(r[n] for n in names) for r in df.collect()})
    want = [("A", "B", "C", "D", "E", "F")]
    assert own(ngramjoin.first_of_each(docs)) == want
    assert own(mixing.mixed_sample(mixing.described(docs), keep=1.0, temper=1.0)) == want
    assert own(linededup.dedup(docs)) == want
    assert own(langid.identify(docs, docs.select("lang", "text"))) == want
    assert own(toxicity.detect(docs, docs.selectExpr("text", "cast(doc_id % 2 as int) y"))) == want
