"""Literal cases of the transcoding rules."""

import re

import pytest
from pyspark.sql import functions as F

from dotloom.functions import cells as C, mathcode as M, transcode as X
from dotloom.operators import transcoding as T

STRICT = {
    "Merhaba dunya.": "⠠⠍⠑⠗⠓⠁⠃⠁ ⠙⠥⠝⠽⠁⠲",
    "cagri çığ öşü ı": "⠉⠁⠛⠗⠊ ⠡⠔⠣ ⠪⠩⠳ ⠔",
    "TÜRKÇE 2025": "⠠⠠⠞⠳⠗⠅⠡⠑ ⠼⠃⠚⠃⠑",
    "Bir satir.\nIkinci satir.": "⠠⠃⠊⠗ ⠎⠁⠞⠊⠗⠲\n⠠⠔⠅⠊⠝⠉⠊ ⠎⠁⠞⠊⠗⠲",
    "x→−2": "⠭⠳⠕⠤⠼⠃",
    # dropped letters split words and keep a number running
    "ABéCD 2é3 ^2é3": "⠠⠠⠁⠃⠠⠠⠉⠙ ⠼⠃⠉ ⠘⠃⠼⠉",
    "^Ab ^AB aB": "⠘⠁⠃ ⠘⠠⠠⠁⠃ ⠁⠠⠃",
    # all-capital Greek words keep their letters, other Greek letters are mapped
    "ΑΒ Αβ": "⠠⠠αβ ⠠⠁⠃",
}
LENIENT = {
    "x→−2": "⠭⠳⠕⠤⠼⠃",
    "y = x−2": "⠽ ⠨⠅ ⠭⠤⠼⠃",
    "(ABC) x^2A x_Bc": "⠠⠠⠐⠣⠁⠃⠉⠐⠜ ⠭⠘⠃⠁ ⠭⠰⠃⠉",
    "Été\t½": "⠠É⠞é\t⠹⠁⠌⠃⠼",
}
LINEAR = {
    "2 + 3 * 4": "⠼⠃ ⠬ ⠼⠉ ⠈⠡ ⠼⠙",
    "(2 + 3) * 4": "⠷ ⠼⠃ ⠬ ⠼⠉ ⠾ ⠈⠡ ⠼⠙",
    "y = x−2": "⠽ ⠨⠅ ⠭ ⠤ ⠼⠃",
    "4x": "⠼⠙ ⠈⠡ ⠭",
    "2(x+1)": "⠼⠃ ⠈⠡ ⠷ ⠭ ⠬ ⠼⠁ ⠾",
    "sin(x) + cos(y+1)": "⠎⠊⠝⠷ ⠭ ⠾ ⠬ ⠉⠕⠎ ⠷ ⠽ ⠬ ⠼⠁ ⠾",
    "x_1 + e^(x+1)": "⠭ ⠰ ⠼⠁ ⠬ ⠑ ⠘ ⠷ ⠭ ⠬ ⠼⠁ ⠾",
    "exp(pi * i) + 1 = 0": "⠑⠭⠏ ⠷ ⠨⠏ ⠈⠡ ⠊ ⠾ ⠬ ⠼⠁ ⠨⠅ ⠼⠚",
    "-x": "⠼⠚ ⠤ ⠭",
    "((x))": "⠷ ⠷ ⠭ ⠾ ⠾",
    "1/2": None, "sqrt(x)": None, "(x^2)": None, "((a+b))": None, "f'(x)": None, "a+": None, "()": None, "(x": None, "": None,
}


def test_strict(apply):
    assert apply(X.to_braille_strict, STRICT) == list(STRICT.values())


def test_strict_routes_agree(apply):
    """The pass-by-pass route equals the token-by-token definition."""
    texts = [t for t in STRICT if "ΑΒ" not in t] + ["Mixed CASE ^2 _x 12é34 (a)[b]{c} 50% a@b #1 É", "^é2 ^^AB a\r\tb\x0bc ²½"]
    assert apply(X.to_braille_strict, texts) == apply(X._strict_by_token, texts)


def test_lenient(apply):
    assert apply(X.to_braille_lenient, LENIENT) == list(LENIENT.values())


def test_lenient_has_one_result_in_both_forms(apply):
    """Texts in Latin-1 are converted with listed classes and stand-ins; results are those of the form for any text."""
    pieces = ["AB", "A", "b", "É", "ß", "ªº", "1", "23", "(", '"', "½", "×", " ", "\n", "\xa0", "\x85", "\x0b", "=", "ÀÞ", "."]
    texts = ["".join(pieces[(i * k + j * j) % len(pieces)] for j in range(7)) for i in range(20) for k in range(1, 20)]
    assert apply(X.to_braille_lenient, texts) == apply(X._lenient_any, texts) == apply(X._lenient_latin_1, texts)
    odd = ["A\x01B 1\x02", "\x03AB", "AB^2C", "ŞA AB ğ"]
    assert apply(X.to_braille_lenient, odd) == apply(X._lenient_any, odd)


def test_lenient_reads_latin_1_with_listed_classes(spark):
    """A range in a class is asked for at every character; the form for Latin-1 has none beside the digits."""
    import re as _re

    plan = spark.range(1).select(X._lenient_latin_1(F.col("id").cast("string")))._jdf.queryExecution().analyzed().toString()
    assert not _re.findall(r"[A-Za-zÀ-ÿ]-[A-Za-zÀ-ÿ]|\\p\{", plan) and "\x02$0" in plan and C.NUMBER + "$0" not in plan


def test_null_is_empty(spark):
    df = spark.createDataFrame([(None,)], "x string")
    assert df.select(X.to_braille_strict(F.col("x")), X.to_braille_lenient(F.col("x"))).first() == ("", "")


def test_linear_math(apply):
    assert apply(M.linear_math_to_cells, LINEAR) == list(LINEAR.values())


def test_linear_math_gives_reasons(apply):
    for r in apply(M.linear_math, [k for k, v in LINEAR.items() if v is None]):
        assert r.cells is None and r.reason


def test_math_tokens(apply):
    (got,) = apply(M.tokens, ["2(x+1)/tan(y): f'·∅ é"])
    assert [(t.type, t.value) for t in got] == [
        ("NUMBER", "2"), ("OPERATOR", "("), ("VARIABLE", "x"), ("OPERATOR", "+"), ("NUMBER", "1"), ("OPERATOR", ")"),
        ("OPERATOR", "/"), ("FUNCTION", "tan"), ("OPERATOR", "("), ("VARIABLE", "y"), ("OPERATOR", ")"), ("OPERATOR", "/"),
        ("VARIABLE", "f"), ("OPERATOR", "''"), ("OPERATOR", "*"), ("VARIABLE", "∅"), ("VARIABLE", "é"),
    ]


def test_convert_keeps_lines(apply):
    assert apply(T.convert_text, ["y = x−2", "a\r\n\n\n\nb = 2", "  "]) == ["⠽ ⠨⠅ ⠭ ⠤ ⠼⠃", "⠁\n\n⠃ ⠨⠅ ⠼⠃", ""]


def test_brf(apply):
    assert apply(X.cells_to_brf, ["⠁⠃⠼⠑", "⠀x"]) == ["ab#e", " x"]
    assert len(set(C.NABCC)) == 64
    long, many = "⠁" * 45, "\n".join(["⠁"] * 26)
    assert apply(T.brf_pages, [long, many, ""]) == [["a" * 40 + "\n" + "a" * 5], ["\n".join("a" * 25), "a"], [""]]


def test_brf_of_stored_pages(apply):
    m = f"\n{T.PAGE_MARKER}\n"
    assert apply(T.document_brf, ["⠁⠃" + m + "⠑⠝", "  "]) == ["ab\n\f\nen", ""]


def test_brf_limits_hold_for_every_document(spark):
    from conftest import SF_DIR

    d = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", X.to_braille_strict(F.col("text")).alias("braille"))
    for r in T.wrap_and_paginate(d).collect():
        lines = r.page.split("\n")
        assert len(lines) <= 25 and all(len(l) <= 40 for l in lines)


def test_unknown_mode():
    with pytest.raises(ValueError):
        X.to_braille(F.lit("x"), "other")


def test_segments(spark):
    df = spark.createDataFrame([(1, "Hi, x 2")], "id0 int, text string")
    rows = T.segment_tokens(df, "text").collect()
    assert [(r.id, r.text, r.kind) for r in rows] == [
        ("seg_1", "Hi", "word"), ("seg_2", ",", "punctuation"), ("seg_3", " ", "space"), ("seg_4", "x", "word"),
        ("seg_5", " ", "space"), ("seg_6", "2", "word"),
    ]
    assert not re.search("[a-z]", "".join(r.braille for r in rows))


def test_an_empty_text_counts_as_an_unmapped_empty_string(spark):
    rows = [(1, ""), (2, ""), (3, None), (4, "a\u4e01b\u4e00\u4e01"), (None, "\u4e01")]
    out = T.unmapped_characters(spark.createDataFrame(rows, "doc_id int, text string"))
    assert {r.ch: (r.occurrences, r.documents) for r in out.collect()} == {"": (2, 2), "\u4e01": (3, 1), "\u4e00": (1, 1)}
