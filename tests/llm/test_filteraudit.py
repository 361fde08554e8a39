"""The filter audit against counting every document in every order, and the query against its SQL."""

import re
from itertools import permutations

import numpy as np
from check import compare_sql, duck
from pyspark.sql import functions as F

from conftest import SF_DIR
from dotloom.llm import filteraudit, queries

LONG = " ".join(f"word{i}" for i in range(120))


def plain(docs, labels):
    firsts = {}
    for i, text, _ in docs:
        if i is not None:
            firsts[text or ""] = min(i, firsts.get(text or "", i))
    masks = []
    for i, text, lang in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = [
            len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
            bool(re.search(r"[#$%&*|]", text)), i is not None and i > firsts[text],
        ]
        own = [lab for lab in labels if lab[0] == i and i is not None]
        masks.append((lang or "", fails, any(q == 1 for _, q, _ in own), any(t == 1 for _, _, t in own)))
    out, shares = {}, {}
    for part in {m[0] for m in masks}:
        for order in permutations(range(5)):
            left = [m for m in masks if m[0] == part]
            gone = []
            for step, f in enumerate(order, 1):
                removed, redundant = [m for m in left if m[1][f]], [m for m in gone if m[1][f]]
                left = [m for m in left if not m[1][f]]
                gone += removed
                alone = sum(m[0] == part and m[1][f] and sum(m[1]) == 1 for m in masks)
                out[part, "".join("ABCDE"[k] for k in order), step] = [
                    len(left), len(removed), len(redundant), alone, sum(m[2] for m in removed), sum(m[3] for m in removed)
                ]
                shares[part, f] = shares.get((part, f), 0) + len(removed)
    return sorted((*k, *v, shares[k[0], "ABCDE".index(k[1][k[2] - 1])]) for k, v in out.items())


def audited(spark, docs, labels):
    table = spark.createDataFrame([(*d, "x", "y", 1) for d in docs], "doc_id long, text string, lang string, part string, h string, mask int")
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    names = "part filter_order step kept removed redundant unique_fails good_lost toxic_lost shapley".split()
    return sorted(tuple(r) for r in filteraudit.audit(filteraudit.mask_counts(filteraudit.flagged(table), known)).select(*names).collect())


def test_against_counting(spark):
    docs = [
        (1, LONG, "en"), (2, LONG, "en"), (3, LONG, "de"), (3, LONG, "de"), (4, None, None), (5, "", ""), (6, "", "de"), (None, LONG, "de"),
        (7, LONG.upper(), "en"), (8, "word " * 200, "en"), (9, LONG + " 5%", "en"), (9, LONG + " 5%", "en"), (10, "É" * 50 + "ABC", "de"),
        (11, " \t\n\x0b\x0c\r", "fr"), (12, "a b", "fr"), (13, LONG + "x" * 300_000, "fr"), (14, LONG + "x" * 300_000, "fr"), (0, "late", "fr"), (15, "late", None),
    ]
    labels = [(1, 1, 0), (2, 1, None), (2, 0, 1), (3, None, None), (7, 1, 1), (None, 1, 1), (99, 1, 1), (9, 0, 1), (14, 1, 1)]
    assert audited(spark, docs, labels) == plain(docs, labels)


def test_empty_tables(spark):
    assert audited(spark, [], []) == []
    assert audited(spark, [(1, LONG, "en")], []) == plain([(1, LONG, "en")], [])


def test_sketch_clears_unique_texts_only(spark):
    h = F.xxhash64((F.col("id") % 3000).cast("string"))
    for counters in (1 << 10, 1 << 16, 1 << 18):
        df = spark.range(0, 4000, 1, 7).select(F.when(F.col("id") % 2 == 0, F.xxhash64(F.lit("hot"))).otherwise(h).alias("h"))
        values = np.array([r.h for r in df.collect()], np.int64)
        merged = filteraudit.sketch(df, counters)
        places = filteraudit.places(values, counters)
        count = np.zeros(counters, int)
        for column in places.T:
            for p in set(column.tolist()):
                count[p] += 1
        assert [int(merged[p // 4] >> 2 * (p % 4) & 3) for p in range(counters)] == np.minimum(count, 2).tolist()
        maybe = filteraudit.maybe_repeated(merged, values)
        _, where, n = np.unique(values, return_inverse=True, return_counts=True)
        assert maybe[n[where] > 1].all()
        assert counters < 1 << 18 or not maybe[n[where] == 1].any()


def test_query(spark):
    line = compare_sql(spark, duck(SF_DIR), "op12_filter_audit", queries.op12_filter_audit, queries.ORACLES["op12_filter_audit"], SF_DIR)
    assert line.startswith("OK"), line
