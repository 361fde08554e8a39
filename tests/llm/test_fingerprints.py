"""Fingerprints: anchors by definition, edited texts, likeness."""

from hashlib import sha256

from pyspark.sql import functions as F

from conftest import SF_DIR
from dotloom.llm import fingerprints as fp
from dotloom.llm import queries


def expected(rows):
    """doc_id -> edited text, for distinct ids."""
    order = sorted(rows, key=lambda r: -r[0])
    out = {}
    for k, (i, t) in enumerate(order):
        t, follower = t or "", order[(k + 1) % len(order)][1] or ""
        third = len(t) // 3
        out[i] = t[: len(t) - third] + follower[:third]
    return out


def test_anchors_are_closed_syncmers(spark):
    text = " ".join(f"w{(i * i) % 37}x" for i in range(60)) + " " + "z" * 40
    units = text.split()[:-1] + ["z" * 12] * 3 + ["z" * 4]
    pairs = spark.createDataFrame([(i, *p) for i, p in enumerate(zip(units, units[1:]))], "i int, a string, b string")
    h = [r.h for r in pairs.orderBy("i").select(F.xxhash64(F.xxhash64("a"), F.xxhash64("b")).alias("h")).collect()]
    want = [i for i in range(len(units) - fp.K + 1) if min(h[i : i + fp.K - 1]) in (h[i], h[i + fp.K - 2])]
    df = spark.createDataFrame([(text,), ("other words " + text,)], "text string")
    one, two = (r.a for r in df.select(fp.anchors(F.col("text")).alias("a")).collect())
    assert [x.place for x in one] == want
    # the choice doesn't depend on what stands around a window
    assert [(x.place + 2, x.value) for x in one] == [tuple(x) for x in two if x.place >= 2]


def test_edges(spark):
    long = "many words of a long text " * 8000
    rows = [(1, None), (2, ""), (3, "a"), (4, "two words"), (5, long), (6, long), (7, "éèà 日本語 x"), (8, " \n ")]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, sketch string")
    got = {r.doc_id: r for r in fp.fingerprints(df).collect()}
    for i, t in expected(rows).items():
        assert got[i].edited_sha256 == sha256(t.encode()).hexdigest(), i
        assert got[i].n_chars == len(dict(rows)[i] or "")
    assert got[5].fingerprint == got[6].fingerprint and got[6].near_next == 1
    assert got[1].fingerprint == got[2].fingerprint == got[8].fingerprint == "" and got[2].near_next == 1
    assert fp.fingerprints(df.limit(0)).count() == 0


def test_repeated_rows_and_ids(spark):
    rows = [(1, "one text here"), (1, "one text here"), (1, "another text"), (None, "no id at all"), (9, "nine")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = fp.fingerprints(df).collect()
    assert len(got) == 5
    first, second = [r for r in got if r.doc_id == 1 and r.n_chars == 13]
    assert first == second
    nine = next(r for r in got if r.doc_id == 9)
    assert nine.edited_sha256 in {sha256(f"nin{x}".encode()).hexdigest() for x in "oa"}
    last = next(r for r in got if r.doc_id is None)
    assert last.edited_sha256 == sha256(b"no id atnine").hexdigest()


def test_long_texts_share_a_short_passage(spark):
    passage = " ".join(f"shared{i}" for i in range(80))
    one, two = (" ".join([*(f"{a}{i}" for i in range(10_000)), passage, *(f"{a}{i}" for i in range(10_000, 20_000))]) for a in "ab")
    df = spark.createDataFrame([(1, one), (2, two)], "doc_id long, text string")
    values = [{x.value for x in r.a} for r in df.select(fp.anchors(F.col("text")).alias("a")).collect()]
    common, either = len(values[0] & values[1]), len(values[0] | values[1])
    got = fp.fingerprints(df).collect()
    assert common >= 20 and all(abs(r.near_next - common / either) < 1e-12 for r in got)
    assert sorted(len(r.fingerprint) for r in got) == sorted(8 * len(v) for v in values)


def test_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    got = {r.doc_id: r for r in queries.op6_fingerprints(spark, SF_DIR).collect()}
    edited = expected(list(docs.items()))
    assert got.keys() == docs.keys()
    assert all(r.edited_sha256 == sha256(edited[i].encode()).hexdigest() for i, r in got.items())
    by_text = {}
    for i, t in docs.items():
        assert by_text.setdefault(t, got[i].fingerprint) == got[i].fingerprint
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got.values())
    longer = [r for r in got.values() if r.n_chars > 300]
    assert sum(0.25 < r.near_edited < 0.75 for r in longer) > 0.95 * len(longer)
    assert sum(r.near_next < 0.1 for r in longer) > 0.95 * len(longer)
