"""Literal pages: what blocks, reading order and lines they give, and what plans cost."""

import pytest
from pyspark.sql import functions as F

from conftest import SF_DIR
from dotloom.operators import layout as E, structure as S
from dotloom.operators.transcoding import PAGE_MARKER
from dotloom.plans import catalog
from dotloom.plans import structure as PS

# pages of (text, x0, y0, x1, y1), their width, and the types of their blocks in order
PAGES = {
    "equation stops before prose": (620, ["equation_group", "paragraph", "paragraph"], [
        ("x^2 - 1 = (x-1)(x+1)", 120, 740, 310, 754), ("= (x-1)(x+1)", 140, 722, 280, 736), ("by factoring", 160, 704, 240, 718),
        ("Now divide by x - 1.", 80, 670, 250, 684)]),
    "example ends at the margin": (620, ["example", "paragraph"], [
        ("Worked Example 3 Find the tangent line.", 80, 740, 360, 754), ("Use f'(x) = 2x to compute the slope.", 104, 722, 330, 736),
        ("f'(2) = 4", 126, 704, 210, 718), ("This paragraph returns to the general discussion.", 80, 686, 370, 700)]),
    "example goes on": (620, ["example"], [
        ("Example 3 Evaluate the limit.", 80, 760, 280, 774), ("We factor the numerator first.", 96, 742, 300, 756),
        ("x^2 - 1 = (x-1)(x+1)", 120, 718, 300, 732), ("Then cancel the common factor.", 104, 696, 320, 710)]),
    "theorem goes on": (620, ["theorem"], [
        ("Theorem 2.6 Limit Laws", 80, 760, 280, 774), ("Suppose that lim x→c f(x) = L and lim x→c g(x) = M.", 96, 742, 420, 756),
        ("lim x→c f(x) = L", 120, 716, 260, 730), ("lim x→c g(x) = M", 120, 698, 260, 712), ("1. Sum Rule", 108, 670, 210, 684),
        ("2. Difference Rule", 108, 652, 250, 666)]),
    "lone note": (620, ["paragraph", "sidebar_note", "paragraph"], [
        ("Main explanation begins here and develops the idea.", 80, 740, 390, 754), ("Use radians here", 455, 710, 555, 724),
        ("The main discussion continues below.", 80, 680, 320, 694)]),
    "captions": (600, ["graph_placeholder", "table_placeholder"], [
        ("Figure 2.1: Velocity vs time.", 80, 300, 360, 314), ("Table 1: Values.", 80, 260, 220, 274)]),
    "caption goes on": (620, ["paragraph", "graph_placeholder", "paragraph"], [
        ("We summarize the graph behavior below.", 80, 360, 380, 374), ("Figure 2.1: Derivative sign chart.", 110, 320, 330, 334),
        ("The curve rises, then levels off near x = 0.", 126, 302, 360, 316), ("The discussion then returns to the proof.", 80, 250, 380, 264)]),
    "interleaved": (620, ["paragraph", "sidebar_note", "paragraph"], [
        ("Main discussion starts here.", 70, 742, 360, 756), ("This paragraph continues on the same topic.", 70, 724, 390, 738),
        ("Remark: this shortcut only works for polynomials.", 430, 690, 560, 704), ("Use direct substitution first.", 430, 672, 548, 686),
        ("A new paragraph resumes below the remark.", 70, 630, 390, 644)]),
}


def pages(spark, lines):
    rows = [("d", 1, i, t, float(a), float(b), float(c), float(d)) for i, (t, a, b, c, d) in enumerate(lines)]
    return E.pages(spark.createDataFrame(rows, "doc_id string, page_no int, line_no int, text string, x0 double, y0 double, x1 double, y1 double"))


@pytest.mark.parametrize("name", PAGES)
def test_block_types(spark, name):
    width, types, lines = PAGES[name]
    got = E.block_reading_order(pages(spark, lines), width).orderBy("ord").collect()
    if name == "interleaved":  # a remark beside the text is a block of its own kind where it is announced
        assert [r.region for r in got] == ["main", "sidebar_right", "main"]
    else:
        assert [r.type for r in got] == types
    assert sorted(t for r in got for t in r.lines) == sorted(t for t, *_ in lines)


def test_reading_order_and_regions(spark):
    lines = [("B", 300, 730, 360, 744), ("A", 60, 730, 120, 744), ("C", 60, 690, 120, 704), (" ", 0, 0, 1, 1)]
    assert [r.text for r in E.reading_order(pages(spark, lines)).orderBy("ord").collect()] == ["A", "B", "C"]
    beside = [("Main paragraph line one.", 60, 740, 360, 754), ("Main paragraph line two.", 60, 720, 360, 734), ("Note: side remark.", 420, 735, 520, 749),
              ("Continues.", 420, 717, 500, 731)]
    got = {r.text: r.region for r in E.assign_regions(pages(spark, beside), 600).collect()}
    assert got == {"Main paragraph line one.": "main", "Main paragraph line two.": "main", "Note: side remark.": "sidebar_right", "Continues.": "sidebar_right"}
    band = E.main_column_band(pages(spark, beside), 600).first()
    assert (band.band_x0, band.band_x1, band.band_width, band.band_center) == (60.0, 360.0, 300.0, 210.0)
    assert E.main_column_band(pages(spark, lines[:2])).count() == 0


def items(spark, rows):
    made = [("d", 1, s, float(x), float(y), float(w), float(h)) for s, x, y, w, h in rows]
    return E.pages(spark.createDataFrame(made, "doc_id string, page_no int, str string, x double, y double, width double, height double"))


def test_lines_from_items(spark):
    bullets = [("1.", 70, 760, 10, 12), ("Birinci", 90, 760, 35, 12), ("madde", 132, 760, 40, 12), ("2.", 70, 735, 10, 12), ("Ikinci", 90, 735, 34, 12), ("madde", 130, 735, 40, 12)]
    assert [r.text for r in E.items_to_lines(items(spark, bullets)).orderBy("line_no").collect()] == ["1. Birinci madde", "2. Ikinci madde"]
    symbols = [("x", 70, 8), ("∈", 84, 8), ("A", 97, 8), ("⇔", 110, 10), ("x", 125, 8), ("∉", 138, 8), ("A^c", 151, 24)]
    got = E.items_to_lines(items(spark, [(s, x, 410, w, 12) for s, x, w in symbols]))
    assert [r.text for r in got.collect()] == ["x ∈ A ⇔ x ∉ A^c"]


def test_stacked_formula(spark):
    rows = [("5.", 70, 760, 18), ("Quotient", 100, 760, 82), ("Rule:", 192, 760, 50), ("f(x)", 520, 778, 42), ("L", 690, 778, 12), ("lim", 430, 760, 28),
            ("=", 590, 760, 16), (",", 728, 760, 6), ("M", 760, 760, 16), ("≠", 790, 760, 14), ("0", 820, 760, 10), ("xSc", 425, 742, 34), ("g(x)", 520, 742, 44),
            ("M", 690, 742, 16)]
    (line,) = E.merge_math_lines(items(spark, [(*r, 12) for r in rows])).collect()
    assert (line.text, line.kind, line.n_lines) == ("5. Quotient Rule: lim x→c f(x)/g(x) = L/M, M ≠ 0", "math", 3)


PLAIN = {
    "CHAPTER 2 LIMITS\n\nThe limit of f(x) as x approaches c is L.": ["chapter_header", "paragraph"],
    "x^2 + 2x + 1 = (x+1)^2\n= x^2 + 2x + 1\n= (x+1)(x+1)": ["equation_group"],
    "x^2 + 2x + 1 = (x+1)^2\n= x^2 + 2x + 1\nTherefore the identity holds for all real x.": ["equation_group", "paragraph"],
    "In words, the Sum Rule says the limit of a sum is the sum of the limits.\nlim x→c (f(x) + g(x)) = L + M": ["paragraph"],
    "Example 2.1: Find the derivative.\nCompute f'(x) = 3x^2.": ["example"],
    "Worked Example 3 Find the tangent line.\nUse f'(x) = 2x to compute the slope.": ["example"],
    "Theorem 2.6 Limit Laws If L and M are real numbers.\nlim x→c f(x) = L\nlim x→c g(x) = M\n1. Sum Rule": ["theorem"],
    "": [],
}


def test_plain_pages(spark):
    df = spark.createDataFrame([(i, [t]) for i, t in enumerate(PLAIN)], "doc_id int, pages array<string>")
    got = {i: [] for i in range(len(PLAIN))}
    for r in S.typed_blocks(df).orderBy("doc_id", "ord").collect():
        got[r.doc_id].append(r)
    for i, types in enumerate(PLAIN.values()):
        assert [r.type for r in got[i]] == types
        assert [r.id for r in got[i]] == [f"block-1-{k:04d}" for k in range(len(types))]
    (group,) = got[1]
    assert [(c.id, c.ord, c.type, c.content) for c in group.children] == [
        (f"block-1-0000-step-{k + 1:02d}", k, "equation_step", t) for k, t in enumerate(group.content.split("\n"))
    ]


STRUCTURE = [
    ("pdf", "1. Kökler\n2. Üsler\n3. İntegral", "line_preserved", None),
    ("pdf", "This is a long paragraph that was wrapped by the PDF layout\nbut it should be reconstructed as one paragraph for reading.", "plain_prose",
     "This is a long paragraph that was wrapped by the PDF layout but it should be reconstructed as one paragraph for reading."),
    ("pdf", "Integration Rules\n\nThis paragraph explains the basic logic of integration and should remain a paragraph.\n"
     "It continues on a second wrapped line for the same paragraph.\n\n1. Power rule\n2. Substitution", "mixed_structured",
     "Integration Rules\n\nThis paragraph explains the basic logic of integration and should remain a paragraph. "
     "It continues on a second wrapped line for the same paragraph.\n\n1. Power rule\n2. Substitution"),
    ("manual", "Başlık\n\n1. Adım\n2. Adım", None, "Başlık\n\n1. Adım\n2. Adım"),
    ("pdf", "Bir fonksiyonun davranisini incelerken\nonce tanim kumesine bakilir ve\nardindan artan azalan araliklar\ndikkatlice belirlenir.", "plain_prose",
     "Bir fonksiyonun davranisini incelerken once tanim kumesine bakilir ve ardindan artan azalan araliklar dikkatlice belirlenir."),
]


def test_structure(spark):
    df = spark.createDataFrame([(i, s, t) for i, (s, t, _, _) in enumerate(STRUCTURE)], "doc_id int, source_type string, text string")
    for r in S.rebuild_text(df).collect():
        _, _, mode, text = STRUCTURE[r.doc_id]
        assert mode is None or r.mode == mode
        assert text is None or r.clean_text == text


def test_pages_with_layouts(spark):
    line = lambda t, x0, y0, x1, y1: {"text": t, "x0": float(x0), "y0": float(y0), "x1": float(x1), "y1": float(y1)}
    width, types, lines = PAGES["example ends at the margin"]
    layout = {"width": float(width), "lines": [line(*l) for l in lines]}
    texts = ["\n".join(t for t, *_ in lines), " ", "Plain text of the second page that is long enough to be read as prose.", "x = 1"]
    schema = "doc_id int, source_type string, pages array<string>, layouts array<struct<width:double,lines:array<struct<text:string,x0:double,y0:double,x1:double,y1:double>>>>"
    df = spark.createDataFrame([(1, "pdf", texts, [layout]), (2, "pdf", texts[2:], None), (3, "pdf", [], None), (4, "pdf", [None, ""], None)], schema)
    got = {(r.doc_id, r.page_no): r for r in S.process_pages(df, layouts="layouts").collect()}
    assert sorted(got) == [(1, 1), (1, 2), (1, 3), (2, 1), (2, 2)]  # pages without text go, the others are numbered anew
    placed = got[1, 1]
    assert [b.type for b in placed.blocks] == types and all(b.bbox is not None for b in placed.blocks)
    assert (placed.blocks[0].bbox.x0, placed.blocks[0].bbox.y1) == (80.0, 754.0)
    assert [b.bbox for b in got[1, 2].blocks] == [None] and got[1, 2].page == texts[2]
    assert {r.document_mode for (d, _), r in got.items() if d == 1} == {"mixed_structured"}


def test_plans(spark):
    """Documents are processed in their rows; a page of lines meets once; words and trees are never exchanged."""
    limits = {
        "processed_documents": (1, 0), "stored_or_new_pages": (4, 1), "review_pages": (1, 0), "rebuilt_texts": (1, 0), "attached_braille": (1, 0),
        "transcoded_blocks": (1, 0), "display_segments": (1, 0), "normalized_review_blocks": (1, 0), "aligned_words": (1, 0), "display_words": (1, 0),
        "layout_blocks": (1, 1), "line_regions": (1, 1), "block_reading_order": (1, 1), "merged_math_lines": (1, 1), "processed_pages": (1, 1),
    }
    for name, (scans, exchanges) in limits.items():
        plan = catalog.queries[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
        plan = plan.split("== Initial Plan ==")[0]
        found = (plan.count("FileScan parquet"), plan.count("Exchange hashpartitioning"))
        assert found[0] <= scans and found[1] <= exchanges, (name, found)
        assert "Window" not in plan and "Python" not in plan and "Arrow" not in plan, name


def test_word_pairs_without_a_step_for_each_word(spark):
    from dotloom.operators import align as A

    rows = [(1, [("a b", "⠁ ⠃ ⠉"), ("c", "")]), (2, [("", "⠁\t⠃"), ("\x0b d  e ", None)]), (3, [("", "")]), (4, [])]
    df = spark.createDataFrame(rows, "doc_id int, rows array<struct<original:string,braille:string>>")
    got = A.align_words(df)
    assert "posexplode(arrays_zip(" in got._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(tuple(r) for r in got.collect()) == [
        (1, 0, 0, "a", "⠁", 0), (1, 0, 1, "b", "⠃", 1), (1, 0, 2, "", "⠉", 2), (1, 1, 0, "c", "", 3),
        (2, 0, 0, "", "⠁", 0), (2, 0, 1, "", "⠃", 1), (2, 1, 0, "d", "", 2), (2, 1, 1, "e", "", 3), (3, 0, 0, "", "", 0),
    ]


def test_review_of_marked_pages(spark):
    mark = f"\n{PAGE_MARKER}\n"
    rows = [
        (1, "manual", f"one{mark}two", f"⠁{mark}⠃"), (2, "manual", f"one{mark}two", "⠁\n\n⠃\n\n⠉"), (3, "manual", f"one{mark}two", f"⠁{mark}⠃{mark}⠉"),
        (4, "manual", "one", f"⠁{mark}⠃"), (5, "manual", None, "⠁"), (6, "pdf", f"a long exam-{mark}ple goes on", None),
    ]
    df = spark.createDataFrame(rows, "doc_id int, source_type string, text string, braille string")
    from dotloom.operators import align as A

    got = {}
    for r in A.review_documents(df).orderBy("doc_id", "page_no").collect():
        got.setdefault(r.doc_id, []).append((r.original, r.braille))
    assert got[1] == [("one", "⠁"), ("two", "⠃")] and got[4] == [("one", "⠁")] and 5 not in got
    assert got[2] == [("one", "⠁\n\n⠃"), ("two", "⠉")] == got[3] and [o for o, _ in got[6]] == ["a long example", "goes on"]


def test_rules_from_sql(spark):
    from dotloom.functions import sqlfunctions as Q

    df = spark.createDataFrame([(i, t) for i, t in enumerate(["it's 2×3", "THEOREM 1 Limit Laws", None, "Bel:rl: L:m:t", "\\s' \"q\"", "y = x^2"])], "i int, text string")
    assert len(Q.register_sql_functions(spark, "t_")) == len(Q.RULES)
    for name, (rule, arguments) in Q.RULES.items():
        if arguments == ("text",):
            got = spark.sql(f"SELECT i, t_{name}(text) AS x FROM {{d}} ORDER BY i", d=df).collect()
            assert got == df.select("i", rule(F.col("text")).alias("x")).orderBy("i").collect(), name
    plan = catalog.queries["line_rules_in_sql"](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "PythonUDF" not in plan


def test_every_typed_block_has_its_page(spark):
    b = PS._typed(spark, SF_DIR)
    assert b.where("page_no > 1").count() > 0
    assert b.where(~F.col("id").startswith(F.concat(F.lit("block-"), F.col("page_no").cast("string"), F.lit("-")))).count() == 0
