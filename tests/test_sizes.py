"""Steps that larger tables asked for: work is dealt over tasks, values are computed once, files stay whole."""

from pyspark.sql import functions as F

from conftest import SF_DIR
from dotloom.functions import graphs as G, language as L, quality as Q, regex as R
from dotloom.plans import catalog, quality as PQ, views as V


def test_small_rows_of_much_work_are_dealt_over_tasks(spark):
    e = V.equations(spark, SF_DIR)
    assert e.select(F.spark_partition_id().alias("p")).distinct().count() > 8
    assert e.count() == V.table(spark, SF_DIR, "part").count()


def test_sentences_and_points_are_read_once(spark, apply):
    assert str(G.clean_sentence(F.col("x"))).count("you can see") == 1
    assert apply(G.clean_sentence, [" a  line shown , as seen here .", "ends.", None, "foreshown"]) == ["a line,  here.", "ends.", "", "foreshown."]
    points = apply(lambda c: G.parse_point(c, y=0.0), ["(1, -2.5)", '[1, "2", "a  b"]', '{"x": "−1", "approx": true}', "{broken", "", None, "x"])
    assert [p and tuple(p) for p in points] == [(1.0, -2.5, False, None), (1.0, 2.0, False, "a b"), (-1.0, 0.0, True, None), None, None, None, None]


def test_documents_of_one_row_group_are_dealt_over_tasks(spark):
    for view in (V.marked_docs, V.paragraph_docs, V.layout_lines):
        assert view(spark, SF_DIR).select(F.spark_partition_id().alias("p")).distinct().count() > 8, view


def test_language_scores_are_counted_once(spark, apply):
    told = str(L.detect_language(L.language_scores(F.col("x"))))
    assert told.count("belirli") == 2 and told.count("lower(") == 1  # a stop word and a hint
    assert [tuple(r) for r in apply(lambda c: L.language_scores(c), ["the line and bu", None, "İşlem"])] == [(4, 2, 8), (0, 0, 0), (1, 8, 0)]


def test_text_files_hold_every_document_in_cells(spark):
    got = [r.original_text for r in catalog.queries["text_files_read"](spark, SF_DIR).select("original_text").collect()]
    kept = V.table(spark, SF_DIR, "documents").where(F.regexp_like("text", F.lit(r"[A-Za-z]"))).count()
    assert sum(any("\u2800" <= c <= "\u28ff" for c in t) for t in got) >= kept > 100


def test_candidates_are_dealt_and_boundaries_look_at_one_side(spark, apply):
    assert PQ.candidates(spark, SF_DIR).select(F.spark_partition_id().alias("p")).distinct().count() > 8
    assert R.java(r"\blim\b") == r"(?<!\w)lim(?!\w)" and R.java(r"\b[A-Za-z]\d") == r"(?<!\w)[A-Za-z]\d"
    for kept in (r"\bx?y", r"\bx*", r"\d\b", r"(?:a|bc)\b", r"\b\s", r"\bx{0,2}", r"[ab]?\b"):
        assert R._ASCII_BOUNDARY in R.java(kept), kept
    texts = ["a lim", "alim", "limb", "lim", "\u00e9lim lim\u00e9", "_lim", "1lim lim1", "LIM-lim"]
    whole = apply(lambda c: F.regexp_count(c, F.lit(Q.LIMIT_WORD.replace(r"\b", R._ASCII_BOUNDARY))), texts)
    assert apply(lambda c: R.count(c, Q.LIMIT_WORD), texts) == whole == [1, 0, 0, 1, 2, 0, 0, 2]


def test_merging_asks_the_seam_and_agrees_with_pairs(spark):
    """The fold holds what merging line by line gives, and reads a long paragraph once."""
    import time

    from dotloom.functions import predicates as P
    from dotloom.operators import repair as RP

    given = [
        ["kale ola-", "cak bir"], ["gelece", "gız biz"], ["we add x", "+ y here"], ["the sin", "(x) is"], ["foo–", "–bar  baz"], ["A Head", "b"], ["ve x si-", "n(x) tam"],
    ]
    a, b = F.col("l")[0], F.col("l")[1]
    pair = F.when(P.can_merge(a, b), F.array(RP.merged_line(a, b, RP.joins_without_space(a, b)))).otherwise(F.col("l"))
    df = spark.createDataFrame([(l,) for l in given], "l array<string>")
    for r in df.select("l", RP.merge_wrapped_lines(F.col("l"))["lines"].alias("got"), pair.alias("want")).collect():
        assert r.got == r.want, r

    def seconds(n: int) -> float:
        long = spark.range(1).select(F.array_repeat(F.lit("some ordinary words that go on and on in a paragraph"), n).alias("l"))
        t0 = time.perf_counter()
        assert long.select(F.length(RP.merge_wrapped_lines(F.col("l"))["lines"][0])).first()[0] == 53 * n - 1
        return time.perf_counter() - t0

    seconds(10)
    assert seconds(4000) < 20  # some minutes when the merged line is read again at every step


def test_rare_runs_are_looked_for_by_their_rarest_sign_first(spark, apply):
    texts = ["x S c", "xSc", "a Sc", "S cx", "lim  LIM\nlim", "xlim lim lim", "x x x x", "ax x x x", "S S S S", "c c c c", "c cc c", "lim limb LIM _lim", "", "a b  c dd e", "a", "aa\tb"]
    for pattern, hint in Q.HINTS.items():
        assert apply(lambda c: Q._matches(c, pattern), texts) == apply(lambda c: R.matches(c, pattern), texts), pattern
        assert hint != pattern and str(Q._matches(F.col("x"), pattern)).count("rlike(") == 2
    assert apply(lambda c: R.count(c, Q.LIMIT_WORD_LED), texts) == apply(lambda c: R.count(c, Q.LIMIT_WORD), texts)
    single = apply(lambda c: F.regexp_count(c, F.lit(r"(?<!\S)\S(?!\S)")) / F.greatest(Q._token_count(c), F.lit(1)), texts)
    assert apply(Q._single_ratio, texts) == single
    symbols = R.java(r"[=≠≤≥∞∫√±×÷→←↔⇔∈∉^/_]")
    assert "(?<=" in symbols and apply(lambda c: c.rlike(symbols), ["a", "→", "↑", "^", "-", "x≠y", "∀", "_"]) == [False, True, False, True, False, True, False, True]


def test_only_segments_that_repair_looks_at_are_kept(spark, apply):
    from dotloom.functions import wordrepair as WR

    texts = ["plain words, and  more.", 'k"ume ve i:lem', "KAL¸s :nt(x) su¨re", "", "12 34"]
    all_changed = lambda c: F.filter(WR.repair_segments(c), lambda s: s["changed"])
    few = lambda c: F.filter(WR.repairable_segments(c), lambda s: s["changed"])
    assert apply(few, texts) == apply(all_changed, texts)
    assert apply(lambda c: F.size(WR.repairable_segments(c)), texts)[0] == 0


def test_arrow_rules_run_only_where_an_arrow_may_be(spark, apply):
    from dotloom.functions import text as B

    texts = ["x S c", "xSc = 2", "a -> b", "lim x S\r\nc", "no arrows=here", "a  b\t→ c", None, "", "S", "xS cd", "a->"]
    whole = lambda c: R.strip(R.sub_all(R.text(c), B.PDF_MATH))
    assert apply(B.normalize_pdf_math, texts) == apply(whole, texts)
    assert str(B.normalize_pdf_math(F.col("x"))).count("CASE WHEN") == 1


def test_tokens_are_counted_by_document_without_an_exchange_of_them(spark):
    plan = catalog.queries["highlight_tokens"](spark, SF_DIR)._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("HashAggregate") >= 4
    executed = catalog.queries["highlight_tokens"](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert executed.count("Exchange hashpartitioning(kind") == 1  # of the sums by document, not of the tokens of every document


def test_items_are_placed_by_one_walk_and_stay_with_their_document(spark):
    from dotloom.plans import structure as PS

    items = PS._items(spark, SF_DIR)
    assert "slice" not in items._jdf.queryExecution().optimizedPlan().toString()  # all words before a word, for every word
    plan = catalog.queries["lines_from_items"](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1


def test_plain_expressions_are_written_without_a_fold(spark, apply):
    from dotloom.functions import mathcode as M
    from dotloom.operators import transcoding as T

    plain = lambda c: M._plain_cells(M.raw_tokens(c), "strict")
    assert apply(plain, ["x + 2", "ab c", "x^2, y", "", "-x", "x + - y", "sin x", "(x)", "pi", "x ="])[3:] == [None] * 7
    lines = ["x + 2", "ab c", "x^2, y", "3 · a"]
    assert apply(plain, lines) == apply(M.linear_math_to_cells, lines) == ["⠭ ⠬ ⠼⠃", "⠁⠃ ⠈⠡ ⠉", "⠭ ⠘ ⠼⠃ ⠂ ⠽", "⠼⠉ ⠈⠡ ⠁"]
    df = spark.createDataFrame([(1, "x + 2\n\n a/b\n(x) ")], "doc_id int, text string")
    rows = T.explode_expressions(df)
    assert [(r.line_no, r.expression) for r in rows.collect()] == [(0, "x + 2"), (3, "(x)")]
    assert "Filter" not in rows._jdf.queryExecution().executedPlan().toString().replace("filter(", "")  # a rule behind a filter is worked out twice


def test_lines_are_trimmed_without_patterns_and_names_begin_with_a_class(spark, apply):
    from dotloom.functions import predicates as P

    assert "regexp_replace" not in str(R.strip(F.col("x"))) and "regexp_replace" not in str(P.is_equation_continuation(F.col("x")))
    texts = [" \t\n\x0b\f\r a b \r\n", "\xa0a\xa0", "", "   ", None, "é\n"]
    assert apply(R.strip, texts) == apply(lambda c: F.regexp_replace(c, r"^\s+|\s+\z", ""), texts)
    assert apply(R.rstrip, texts) == apply(lambda c: F.regexp_replace(c, r"\s+\z", ""), texts)
    named = R.java(P.LAYOUT_MATH_NAME)
    assert "(?=[" in named
    assert apply(lambda c: c.rlike(named), ["a LIM b", "slim", "lim_", "(log)", "int", "élim", "diffs"]) == [True, False, False, True, True, True, False]


def test_places_of_words_are_sums_by_run_and_within(spark):
    from dotloom.plans import structure as PS

    texts = ["", " ", "a", " a  bc ", " ".join("w" * (k % 5) for k in range(100)), "ğü 😀 x"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, x string")
    got = [r.p for r in df.select("i", PS._word_places(F.col("x")).alias("p")).orderBy("i").collect()]
    for text, places in zip(texts, got):
        at = 0
        for word, place in zip(text.split(" "), places, strict=True):
            assert (place.at, place.w) == (at, word)
            at += len(word) + 1


def test_a_let_is_no_mapped_array(spark):
    told = str(R.let(F.col("x"), lambda v: F.concat(v, v)))
    assert told.startswith("Column<'aggregate(") and "transform" not in told  # what is mapped is copied
    df = spark.createDataFrame([(1, "a"), (2, None)], "i int, x string")
    assert [r.y for r in df.select(R.let(F.col("x"), lambda v: F.concat(v, F.coalesce(v, F.lit("")))).alias("y")).collect()] == ["aa", None]


def test_items_stay_in_their_line_until_it_is_stacked(spark):
    from dotloom.functions import geometry as G

    told = str(G.merged_lines(F.col("lines")))
    assert told.count("items") == 1  # where stacked lines ask for them
    rows = [("a", 10.0, 700.0), (" b", 18.0, 700.0), (")", 40.0, 700.0), ("x", 10.0, 680.0), ("=", 18.0, 680.0), ("  ", 30.0, 680.0)]
    df = spark.createDataFrame([(1, [(t, x, y, 6.0 * len(t), 12.0) for t, x, y in rows])], "k int, items array<struct<str:string,x:double,y:double,width:double,height:double>>")
    lines = df.select(F.explode(G.item_lines(F.col("items"))).alias("l")).select("l.*").orderBy("line_no").collect()
    assert [(l.text, l.x0, l.x1, l.y0, l.y1) for l in lines] == [("a b)", 10.0, 46.0, 688.0, 712.0), ("x =", 10.0, 24.0, 668.0, 692.0)]


def test_even_lines_are_not_rewritten(apply):
    from dotloom.functions import predicates as P
    from dotloom.functions import text as B

    texts = ["a b", " a  b ", "\ta\t b\n\nc", "a \t b", "", None, "a\x0b b", "a" * 90 + " b " * 30, " ".join("ab" for _ in range(11)), "x  y"]
    squeezed = lambda c: R.strip(F.regexp_replace(R.text(c), r"\s+", " "))
    assert apply(lambda c: B._squeeze(R.text(c)), texts) == apply(squeezed, texts)
    blanks = lambda c: R.rstrip(F.regexp_replace(F.replace(F.replace(R.text(c), F.lit("\r\n"), F.lit("\n")), F.lit("\xa0"), F.lit(" ")), r"[ \t]+", " "))
    assert apply(B.normalize_line, texts) == apply(blanks, texts)
    words = lambda c: F.least(F.regexp_count(R.strip(R.text(c)), F.lit(r"\S+")), F.lit(P.MOST_WORDS))
    assert apply(lambda c: P._word_count(R.strip(R.text(c))), texts) == apply(words, texts)


def test_documents_ask_only_what_their_pages_show(apply):
    from dotloom.functions import wordrepair as WR

    texts = ["", None, "the and for", "ve ile bir", "the ve", "12 = 3", "Bu bölüm, the page", "şşş the list and the text", "x" * 2000, "a  b\t1234 56789\n" + "y" * 90, "z" * 1669, "z" * 1700]
    both = lambda c: L.detect_language(L.language_scores(c))["language"]
    assert apply(L.language_of, texts) == apply(both, texts) and "tokens" not in str(L.language_of(F.col("x")))
    rated = lambda c: F.struct(*[Q.readability(c, F.lit("pdf"))[k].alias(k) for k in ("score", "improved")])
    assert apply(Q.improved_and_score, texts) == apply(rated, texts)
    words = ['K"okler ve\n\n  "usler', "plain line\nkısm: bel:rl:\n", "p:\nx :nt(2) l:m(x)", "a¸sa˘gıda\r\nhi¸c ƒ", "", None, "\n"]
    segments = lambda c: F.array_join(F.transform(WR.repair_segments(c), lambda s: F.when(s["confidence"] >= WR.ACCEPT, s["text"])), "|")
    got = apply(WR.repair_text, words)
    assert got[0] == "Kökler ve\n\n  üsler" and got[1] == "plain line\nkısmi belirli\n" and got[2] == "pi\nx int(2) lim(x)" and got[4:] == ["", "", "\n"]
    assert got[3].split("\n") == ["aşağıda", "hiç f"] and apply(segments, ["plain"]) == [""]
