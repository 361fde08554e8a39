"""Line dedup against brute force over all pairs of lines."""

import random

from check import compare_sql, duck

from conftest import SF_DIR
from dotloom.llm import linededup, queries


def within_one(a, b):
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) >= len(b)) :] == b[i + (len(b) >= len(a)) :]


def brute(rows, least):
    places = sorted((i, k, line) for i, t in rows for k, line in enumerate((t or "").split("\n")))
    gone = set()
    for p, (i, k, line) in enumerate(places):
        if len(line) >= least and any(len(x) >= least and within_one(line, x) for *_, x in places[:p]):
            gone.add((i, k))
    return {i: "\n".join(x for k, x in enumerate((t or "").split("\n")) if (i, k) not in gone) for i, t in rows}


def test_near_lines(spark):
    rng = random.Random(8)
    lines = []
    for n in (4, 5, 6, 7, 8, 17, 33, 120):
        for _ in range(6):
            line = "".join(rng.choice("abé ") for _ in range(n))
            lines.append(line)
            for _ in range(6):
                k = rng.randrange(len(line))
                lines.append(rng.choice([line[:k] + line[k + 1 :], line[:k] + rng.choice("abx") + line[k:], line[:k] + "q" + line[k + 1 :], line[:k] + "q" + line[k + 2 :]]))
                line = rng.choice([line, lines[-1]])
    rng.shuffle(lines)
    rows, at = [], 0
    while at < len(lines):
        k = rng.randrange(1, 6)
        rows.append((len(rows) * 7 % 1009, "\n".join(lines[at : at + k])))
        at += k
    rows += [(5000, None), (5001, ""), (5002, "\n\n")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, at string")
    got = linededup.dedup(docs, 4).collect()
    assert {r.doc_id: r.text for r in got} == brute(rows, 4)
    assert all(r.at == "x" and r.n_removed <= r.n_lines for r in got)


def test_nulls_repeats_long_lines_and_empty_table(spark):
    long = "word " * 30_000
    rows = [(1, f"one\n{long}"), (1, f"one\n{long}"), (2, f"{long}x\nshort"), (None, long), (None, "last of all the lines"), (3, "last of all the lines!")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, linededup.dedup(docs).collect()), key=str)
    want = [(1, f"one\n{long}", 2, 0)] * 2 + [(2, "short", 2, 1), (3, "last of all the lines!", 1, 0), (None, "", 1, 1), (None, "", 1, 1)]
    assert got == sorted(want, key=str)
    assert linededup.dedup(docs.limit(0)).count() == 0


def test_query(spark):
    line = compare_sql(spark, duck(SF_DIR), "op5_line_dedup", queries.op5_line_dedup, queries.ORACLES["op5_line_dedup"], SF_DIR)
    assert line.startswith("OK"), line
