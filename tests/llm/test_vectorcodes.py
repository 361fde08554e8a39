"""Product codes against plain integer arithmetic, and the query against its SQL."""

import hashlib

import numpy as np
from check import compare_sql, duck

from conftest import SF_DIR
from dotloom.llm import queries, vectorcodes


def plain(vectors, parts, entries, rounds, scale=1024):
    """Codes, errors and codebooks in Python's integers; vectors are (id, label, values) in the order of their ids."""
    wide = max((len(v) for _, _, v in vectors), default=0)
    wide += -wide % parts
    whole = [[int(np.floor(x * scale)) for x in v] + [0] * (wide - len(v)) for _, _, v in vectors]
    cut = [[v[p * wide // parts : (p + 1) * wide // parts] for p in range(parts)] for v in whole]
    books = [[v[p] for v in cut[:entries]] for p in range(parts)]

    def assign():
        return [[min((sum((a - b) ** 2 for a, b in zip(v[p], e)), i) for i, e in enumerate(books[p])) for p in range(parts)] for v in cut]

    for _ in range(rounds):
        found = assign()
        for p in range(parts):
            for i in range(len(books[p])):
                own = [v[p] for v, f in zip(cut, found) if f[p][1] == i]
                if own:
                    books[p][i] = [sum(c) // len(own) for c in zip(*own)]
    found = assign()
    error = [sum(d for d, _ in f) for f in found]
    by_label = {}
    for (_, label, _), e in zip(vectors, error):
        by_label[label] = by_label.get(label, 0) + e
    rows = [
        (i, "".join(f"{k:02x}" for _, k in f), e, by_label[label]) for (i, label, _), f, e in zip(vectors, found, error)
    ]
    text = ",".join(str(x) for p in books for e in p for x in e)
    return rows, hashlib.sha256(text.encode()).hexdigest()


def test_products_are_exact():
    rng = np.random.default_rng(1)
    for top in (2, 1 << 11, 1 << 24, 1 << 27):
        for width in (1, 3, 16, 70):
            a, b = rng.integers(-top, top, (9, width)), rng.integers(-top, top, (7, width))
            want = np.array([[sum(int(p) * int(q) for p, q in zip(x, y)) for y in b] for x in a])
            assert (vectorcodes.products(a, b) == want).all()
            bits = vectorcodes.limb_bits(width)
            assert width << 2 * bits < 1 << 53
            assert (sum(x.astype(np.int64) << bits * i for i, x in enumerate(vectorcodes.limbs(a, bits))) == a).all()


def test_nearest_takes_the_first_of_equals():
    book = np.array([[5, 5], [1, 1], [1, 1], [-1, 1]])
    index, gap = vectorcodes.nearest(np.array([[1, 1], [0, 1], [9, 9]]), book)
    assert index.tolist() == [1, 1, 0] and gap.tolist() == [0, 1, 32]


def test_against_plain_rounds(spark):
    rng = np.random.default_rng(2)
    vectors = [(i, int(i % 3) if i % 7 else None, (rng.normal(size=6) * 10.0 ** rng.integers(-1, 4)).tolist()) for i in range(60)]
    vectors += [(60, None, vectors[3][2]), (61, 5, [0.5] * 3), (62, 5, []), (62, 5, []), (63, 6, [1e5] * 5)]
    nan, inf = float("nan"), float("inf")
    bad = [(-1, 1, None), (-2, 1, [nan] * 6), (-3, 1, [inf] * 6), (-4, 1, [None] * 6), (-5, 1, [1e300] * 6)]
    rows = [(i, label, v, "x", "y") for i, label, v in bad + vectors]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>, code string, label_error string").repartition(5)
    codes, books = vectorcodes.compress(df, parts=4, entries=8, rounds=3)
    want, digest = plain(vectors, 4, 8, 3)
    assert sorted(tuple(r) for r in codes.select("vec_id", "code", "error", "label_error").collect()) == sorted(want)
    assert vectorcodes.digest(books) == digest


def test_empty_and_few(spark):
    schema = "vec_id long, label string, embedding array<float>"
    codes, books = vectorcodes.compress(spark.createDataFrame([], schema))
    assert codes.count() == 0 and books.size == 0
    codes, books = vectorcodes.compress(spark.createDataFrame([(1, "a", [0.5] * 4), (None, None, [0.25] * 4)], schema))
    assert sorted((r.code, r.error, r.label_error) for r in codes.collect()) == [("00000000", 0, 0), ("01010101", 0, 0)]
    assert books[:, :, 0].tolist() == [[512, 256]] * 4
    codes, _ = vectorcodes.compress(spark.createDataFrame([(1, "a", [])], schema))
    assert [(r.code, r.error) for r in codes.collect()] == [("00000000", 0)]


def test_rare_and_hot_labels(spark, monkeypatch):
    monkeypatch.setattr(vectorcodes, "HOT", 3)
    coded = spark.createDataFrame([(i, "hot" if i % 2 else None if i % 4 else f"l{i % 5}", i) for i in range(100)], "vec_id long, label string, error long")
    got = {r.vec_id: r.label_error for r in vectorcodes.label_totals(coded).collect()}
    rows = {r.vec_id: r.label for r in coded.collect()}
    assert got == {i: sum(j for j in rows if rows[j] == rows[i]) for i in rows}


def test_query(spark):
    line = compare_sql(spark, duck(SF_DIR), "op11_vector_codes", queries.op11_vector_codes, queries.ORACLES["op11_vector_codes"], SF_DIR)
    assert line.startswith("OK"), line
