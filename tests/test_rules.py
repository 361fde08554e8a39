"""Rules that are spelled twice mean the same, and what need not be read isn't."""

import itertools

from pyspark.sql import functions as F

from dotloom.functions import language as L
from dotloom.functions import predicates as P
from dotloom.functions import regex as R
from dotloom.functions import wordrepair as W

VALUES = [
    "", "ƒ", "a ≠ b", "LIM", "Slim", "f(x)", "F(X)", "g(y)", "xSc", "XsC", "x→c", "x → c", "#", "·", "a+b", "a-b", "a/b", "^", "√", "∑", "∫", "plain", "x", "f(", "= 2",
    "Done.", 'Done."', "Done!')]", "Done…", "Done. )", "?]", ".a", "sin(", "sin (x)", "asin(x)", "a + b", "1*2", "3 / x", "a = ş", "(x)", "h(x)", "h(x)y", "/", "çğışıöüÇĞIŞİÖÜ",
    "aşağıda", "AŞAĞIDA", "xaşağıda", "işlem İşlem", "aözellik özellik", "Küme, ÖRNEK ve örnek", "xörnek", "belirli KISMI kısmi", "tanımlanmış", "ileveile ile; ve", "şuşu şu", "kökler",
]


def test_faster_rules(spark):
    t = F.col("t")
    pairs = [
        (R.matches(t, P.THEOREM_SIGN) | R.matches(t, P.THEOREM_NAME), R.matches(t, P.THEOREM_MATH)),
        (P.is_formula_like(t), R.matches(t, P.FORMULA_SYMBOL) | R.matches(t, P.FORMULA_CALL) | R.matches(t, P.FORMULA_OPERATION)),
        (P._sentence_end(t), R.matches(t, P.SENTENCE_END)),
        (P._layout_call(t), R.matches(t, P.LAYOUT_MATH_CALL)),
        (F.regexp_count(t, F.lit(L.LETTERS_FAST)), F.regexp_count(t, F.lit(L.TURKISH_LETTERS))),
        (R.count(t, L.HINTS_FAST), R.count(t, L.TURKISH_HINTS)),
        *((L._members(t, w), F.regexp_count(t, F.lit(r"(?<!\p{L})(?:" + "|".join(w) + r")(?!\p{L})"))) for w in (L.TURKISH_STOP_WORDS, L.ENGLISH_STOP_WORDS)),
    ]
    values = VALUES + [" ".join(p) for p in itertools.permutations(VALUES, 2)]
    df = spark.createDataFrame([(v,) for v in values], "t string")
    got = df.select("t", *(F.struct(a.alias("a"), b.alias("b")).alias(f"p{k}") for k, (a, b) in enumerate(pairs))).collect()
    assert [(r.t, k) for r in got for k in range(len(pairs)) if r[f"p{k}"].a != r[f"p{k}"].b] == []


def test_lines_that_need_no_repair(spark):
    words = [*W.DICTIONARY, *(w.upper() for w in W.DICTIONARY), *(w.capitalize() for w in W.DICTIONARY), "İlk İLERİ", "ƒ", "a:b", "k¨ok", "\r"]
    lines = [w for w in words] + [f"({w})" for w in words] + [f"one {w}, two" for w in words] + ["plain prose of no use", ""]
    df = spark.createDataFrame([(v,) for v in lines], "t string")
    got = df.select("t", W.may_need_repair(F.col("t")).alias("may"), W.repair_text(F.col("t")).alias("r")).collect()
    assert [x.t for x in got if x.r != x.t and not x.may] == []
    assert not any(x.may for x in got[-2:])


def test_words_of_unrepaired_lines_are_read_once(spark):
    from dotloom.operators import align as A

    df = spark.createDataFrame([(1, "plain  words\n\nk\"ok here \nlast")], "doc_id int, text string")
    got = [tuple(r) for r in A.display_rows(df).select("line_no", "pos", "raw", "repaired", "word_index").orderBy("word_index").collect()]
    assert got == [(0, 0, "plain", "plain", 0), (0, 1, "words", "words", 1), (2, 0, 'k"ok', "kök", 2), (2, 1, "here", "here", 3), (3, 0, "last", "last", 4)]
