"""Literal cases of text repair, language and structure."""

from pyspark.sql import functions as F

from dotloom.functions import language as L, predicates as P, quality as Q, text as B, wordrepair as WR
from dotloom.operators import repair as RP, structure as S

WORDS = {
    '"Usler': "Üsler", 'K"okler': "Kökler", 'b"oyle': "böyle", 'k"umeleri': "kümeleri", "i¸slemleri": "işlemleri",
    "tanımlanmı¸s": "tanımlanmış", "¸carpma": "çarpma", "do˘gal": "doğal", "a¸sa˘gıda": "aşağıda", "hi¸c": "hiç",
    '"ozellikleri': "özellikleri", "ozellikleri": "özellikleri", '"ogrenci': "öğrenci", 't"urkce': "türkçe",
    "L:m:t": "Limit", "l:m:t:": "limiti", "H:perbol:k": "Hiperbolik", "Tr:gonometr::": "Trigonometri:", "a:b": "a:b",
    'x"yz': 'x"yz', "Tu¨rkc¸e": "Türkçe", "o¨g˘retmen": "öğretmen", "c¸o¨zu¨m": "çözüm", "as¸ag˘ıdaki": "aşağıdaki",
    "ƒ(x) = x + 1": "f(x) = x + 1",
    "Ters H:perbol:k Tr:gonometr:: arcsin(x) + arccos(x) = pi / 2": "Ters Hiperbolik Trigonometri: arcsin(x) + arccos(x) = pi / 2",
    "Bel:rl: İntegral (Gauss İntegral:): :nt(exp(-x^2), x, -:nf, :nf) = sqrt(p:)":
        "Belirli İntegral (Gauss İntegral:): int(exp(-x^2), x, -inf, inf) = sqrt(pi)",
    'Kısm: İntegrasyon\n\nK"okler ve "Usler': "Kısmi İntegrasyon\n\nKökler ve Üsler",
}


def test_word_repair(apply):
    assert apply(WR.repair_text, WORDS) == list(WORDS.values())


def test_collapse(apply):
    assert apply(B.collapse_paragraphs, ["a b\n  c\n\n\n\nd\ne  f "]) == ["a b c\n\nd e f"]


def test_encoding(apply):
    assert apply(B.fix_encoding, ["ƒ(q) (-q, q) s¸ ˘g ü 2×3 “x” équ"]) == ['f(∞) (-∞, ∞) ş ğ ü 2*3 "x" équ']
    assert apply(lambda c: B.fix_encoding(c, q_as_infinity=False), ["q"]) == ["q"]


def test_math_input(apply):
    cases = {
        "∫_0^1 x^2 dx": "int(x^2, x, 0, 1)", "∫_{0}^{pi} sin(x) dx": "int(sin(x), x, 0, pi)", "∫ x² dx": "int(x^2, x)",
        "d/dx (sin(x))": "diff(sin(x), x)", "d^2/dx^2 (x^3)": "diff(x^3, x, 2)", "∂ f / ∂x": "diff(f, x)", "x−1": "x-1",
    }
    assert apply(B.normalize_math_input, cases) == list(cases.values())


def test_math_lines(apply):
    assert apply(RP.join_math_lines, ["1. Sum Rule:\nlim\nx→c\n(f(x) + g(x)) = L + M", "5. Quotient Rule:\nlim\nx Sc\nƒ(x) / g(x) = L / M, M ≠ 0", ""]) == [
        "1. Sum Rule: lim x→c (f(x) + g(x)) = L + M", "5. Quotient Rule: lim x→c f(x)/g(x) = L/M, M ≠ 0", "",
    ]


def test_limit_rows(apply):
    assert apply(B.limit_display_rows, ["1. Sum Rule: lim x→c (f(x) + g(x)) = L + M", "lim x->c f(x)/g(x) = L/M, M ≠ 0", "lim x→−2 f(x) = L", "5. Product Rule"]) == [
        ["1. Sum Rule: lim (f(x) + g(x)) = L + M", "             x→c"], ["lim f(x)/g(x) = L/M, M ≠ 0", "x→c"], ["lim f(x) = L", "x→−2"], ["5. Product Rule"],
    ]


def test_structured_math(apply):
    assert apply(B.normalize_structured_math, ["lim (f(x)) x→c", "limxSc f", "√ x + 1", "√n A"])[:3] == ["lim x→c (f(x))", "lim x→c f", "√(x + 1)"]


def test_merge_wrapped(spark):
    df = spark.createDataFrame([(["we go inter-", "national words here", "1. list"],), (["gidebilece", "gız yolda"],)], "l array<string>")
    rows = df.select(RP.merge_wrapped_lines(F.col("l")).alias("m")).collect()
    assert rows[0].m.lines == ["we go international words here", "1. list"]
    assert rows[1].m.lines == ["gidebileceğız yolda"] and rows[1].m.fixes == ["merged broken word"]


def test_page_breaks(spark):
    pages = [(1, 0, "the inter-"), (1, 1, "tion-"), (1, 2, "al words\nnext"), (2, 0, "no break"), (2, 1, "here")]
    df = spark.createDataFrame(pages, "doc_id int, page_no int, text string")
    got = {(r.doc_id, r.page_no): r.text for r in RP.repair_page_breaks(df).collect()}
    assert got == {(1, 0): "the intertion", (1, 1): "-", (1, 2): "al words\nnext", (2, 0): "no break", (2, 1): "here"}


def test_language(apply):
    found = apply(
        lambda c: L.detect_language(L.language_scores(c))["language"],
        ["Kökler ve kümeler aşağıda tanımlanmış işlemleri gösterir.", "This section explains the graph and the equation in plain language.", "x^2 + y^2 = 1", ""],
    )
    assert found == ["tr", "en", "unknown", "unknown"]


def test_quality(apply):
    bad = "lim lim lim x S c 1. Sum Rule: 2. Difference Rule:"
    good = "1. Sum Rule: lim x→c (f(x) + g(x)) = L + M"
    assert apply(Q.is_severely_corrupted, [bad, good, ""]) == [True, False, False]
    scores = apply(Q.math_quality_score, [bad, good, ""])
    assert scores[1] > scores[0] and scores[2] == -100


def test_routing(apply):
    assert apply(P.is_math_line, ["y = x−2", "this is a long prose line = yes", "1/2", "", "sin x"]) == [True, False, True, False, True]
    assert apply(P.keyword_block_type, ["Worked Example 3", "Proofs.", "plain"]) == ["example", "solution", None]


def test_structure_modes(spark):
    cases = {
        1: ("1. Kökler\n2. Üsler\n3. İntegral", "pdf", "line_preserved"),
        2: ("This is a long prose line that wraps onto\nthe next line and keeps going for a while.", "manual", "plain_prose"),
        3: ("This is a long prose line that wraps onto\nthe next line and keeps going for a while.\n\nAnother long prose line that also wraps on\nand ends here after some more words.", "manual", "paragraph_preserved"),
    }
    df = spark.createDataFrame([(k, t, s) for k, (t, s, _) in cases.items()], "doc_id int, text string, source_type string")
    got = {r.doc_id: r.mode for r in S.rebuild_text(df).collect()}
    assert got == {k: m for k, (_, _, m) in cases.items()}


def test_pages(apply):
    lines = "\n".join(["x" * 50] * 5)
    assert apply(lambda c: S.pages_by_lines(c, 110), [lines, ""]) == [["\n".join(["x" * 50] * 2)] * 2 + ["x" * 50], []]
    text = "word " * 60
    pages = apply(lambda c: S.pages_by_blocks(c, 100), [text, "a\n\nb"])
    assert " ".join(pages[0]) == text.strip() and all(len(p) <= 100 for p in pages[0]) and pages[1] == ["a\n\nb"]


def test_plain_blocks(spark):
    page = "= 3x + 1\n= 4x\nThis sentence explains the result in more than seven words.\n\nEXAMPLE 1 Find it\n(a) lim x"
    rows = S.segment_plain(spark.createDataFrame([(1, page)], "doc_id int, text string")).collect()
    assert [r.block_no for r in rows] == [0, 0, 1, 2, 2]
