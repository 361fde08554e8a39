"""Spans of test items against comparing all windows, and the query against its SQL."""

import random
import re

from check import compare_sql, duck

from conftest import SF_DIR
from dotloom.llm import decontaminate as D, queries


def split(text):
    lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def plain(text, items, window):
    """Number of words, hit places, names of items found."""
    own, hit, names = split(text), set(), set()
    for name, item in items:
        ws = split(item)
        n = min(len(ws), window)
        for i in range(len(ws) - n + 1) if n else ():
            for at in range(len(own) - n + 1):
                if own[at : at + n] == ws[i : i + n]:
                    hit.update(range(at, at + n))
                    names.add(name)
    return len(own), hit, names


def scanned(text, items, window):
    a = D.build([(n, list(D.words(t.encode())), True) for n, t in items], window)
    n, spans, names = D.scan(a, D.words(text.encode()), window)
    assert all(x[1] < y[0] for x, y in zip(spans, spans[1:]))
    return n, {i for s in spans for i in range(*s)}, names


def test_scan_against_windows():
    rng = random.Random(5)
    for _ in range(300):
        letters = "abcd"[: rng.randint(1, 4)]
        text = lambda n: " ".join(rng.choice(letters) for _ in range(n))
        window = rng.randint(1, 5)
        items = [(str(i % 4), text(rng.randint(0, 9))) for i in range(rng.randint(0, 6))]
        doc = text(rng.randint(0, 40)) + rng.choice(["", " x "]) + text(rng.randint(0, 9))
        assert scanned(doc, items, window) == plain(doc, items, window)


def test_words(monkeypatch):
    text = "Ab-c D'É x  ß_1\n日本 \x7f z" + "y" * 50 + " Q"
    for chunk in (1, 2, 3, 7, 1 << 20):
        monkeypatch.setattr(D, "CHUNK", chunk)
        assert [w.decode() for w in D.words(text.encode())] == split(text)
    assert list(D.words(b"")) == list(D.words(b" - ")) == []


PASSAGE = "The quick brown fox, jumps over the lazy dog; and then it sleeps all day"
DOCS = [
    (1, "Start. " + PASSAGE.upper() + "! End of it."), (2, None), (3, ""), (4, "quick brown fox jumps"), (5, "so: short item, yes"), (5, "so: short item, yes"),
    (6, "nothing here"), (None, PASSAGE), (7, ("clean words " * 30_000) + PASSAGE + " tail"), (8, "short" + "\n" * 9 + "ITEM"), (9, PASSAGE),
]
ITEMS = [(10, PASSAGE), (9, "Prefix of " + PASSAGE), (2, "short item"), (2, "short item"), (3, None), (4, "..."), (5, ""), (6, "so short"), (7, "absent words only"), (None, "nothing here")]


def found(spark, docs, items):
    docs = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, spans int, h string")
    items = spark.createDataFrame([(*i, "y") for i in items], "item_id long, text string, item string")
    rows = D.find(docs, items).collect()
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    return sorted(((r.doc_id, r.n_words, sorted(i for s in r.spans for i in range(*s)), r["items"]) for r in rows), key=key)


def expected(docs, items):
    names = [(str(n), t) for n, t in items if n is not None]
    rows = [(i, n, sorted(hit), sorted(own)) for i, t in docs for n, hit, own in [plain(t, names, 10)]]
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))


def test_find(spark):
    want = expected(DOCS, ITEMS)
    assert found(spark, DOCS, ITEMS) == want
    assert [r[3] for r in want if r[0] in (1, 5, 8)] == [["10", "9"], ["2", "6"], ["2", "6"], ["2"]]


def test_blocks_passes_and_pieces(spark, monkeypatch):
    monkeypatch.setattr(D, "BLOCK_WORDS", 8)
    monkeypatch.setattr(D, "AT_ONCE", 2)
    monkeypatch.setattr(D, "PIECE_WORDS", 12)
    assert found(spark, DOCS, ITEMS) == expected(DOCS, ITEMS)


def test_empty_tables(spark):
    assert found(spark, [], ITEMS) == []
    assert found(spark, [(1, PASSAGE)], []) == [(1, 15, [], [])]


def test_clean(spark):
    rows = [(1, "Before: " + "calm words " * 20 + PASSAGE + "... after", 1, 2), (2, PASSAGE, 3, 4), (3, None, 5, 6), (4, "Fine.", 7, 8), (4, "Fine.", 7, 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, hit int, row int")
    items = spark.createDataFrame([(1, PASSAGE)], "item_id long, text string")
    got = sorted(tuple(r) for r in D.clean(docs, items).collect())
    assert got == [(1, "Before: " + "calm words " * 20 + "... after", 1, 2), (3, None, 5, 6), (4, "Fine.", 7, 8), (4, "Fine.", 7, 8)]
    assert sorted(tuple(r) for r in D.clean(docs, items, longest=15, coverage=1.0).collect()) == rows
    assert D.without_spans(b"a b, c", [[0, 1], [2, 3]], 0) == b" b, "


def test_query(spark):
    line = compare_sql(spark, duck(SF_DIR), "op13_decontamination", queries.op13_decontamination, queries.ORACLES["op13_decontamination"], SF_DIR)
    assert line.startswith("OK"), line
