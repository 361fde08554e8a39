"""Repair operators over token, page and document tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import predicates as P
from ..functions import regex as R
from ..functions import text as B
from ..functions import wordrepair as WR

# --- fixed values: patterns ---------------------------------------------------
LIMIT_SUBSCRIPT = r"^[A-Za-z]\s*→\s*[+\-−]?(?:\d+(?:\.\d+)?|[A-Za-z][A-Za-z0-9]*|∞)$"
MATH_CONTINUATION = [
    r"[=≠≤≥∞∫√→^/_()]", r"(?i)\b(?:lim|sin|cos|tan|log|ln|sqrt)\b", r"\b[fgh]\(x\)\b",
]
RULE_HEADING = r"^(\d+\.\s+)?[A-Za-z][A-Za-z\s-]{1,80}:\s*$"
LIMIT_WITH_SUBSCRIPT = r"\blim\s+[A-Za-z]→[+\-−]?(?:\d+(?:\.\d+)?|[A-Za-z][A-Za-z0-9]*|∞)\b"
# ------------------------------------------------------------------------------


def word_tokens(df: DataFrame, text: str = "text") -> DataFrame:
    """Document -> one row per non-space segment (pos, word)."""
    keep = [c for c in df.columns if c != text]
    return df.select(
        *keep, F.posexplode(F.regexp_extract_all(R.text(text), F.lit(WR.SEGMENTS), 0)).alias("pos", "word")
    ).filter(~F.col("word").rlike(r"^\s"))


def repair_dictionary(df: DataFrame) -> DataFrame:
    """The fixed dictionary as a table (73 rows, safe to broadcast)."""
    return df.sparkSession.createDataFrame(list(WR.DICTIONARY.items()), "key string, repaired string")


def repair_words(tokens: DataFrame, word: str = "word") -> DataFrame:
    """Dictionary repair of a token table by one broadcast join."""
    dim = F.broadcast(repair_dictionary(tokens))
    joined = tokens.withColumn("key", WR.tr_lower(F.col(word))).join(dim, "key", "left")
    fixed = F.coalesce(WR.preserve_case(F.col(word), F.col("repaired")), F.col(word))
    return joined.withColumn("fixed", fixed).drop("key", "repaired")


def repair_report(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Per document: segments changed and accepted, best confidence.  No shuffle."""
    x = R.replace_all(R.text(text), [("\r\n", "\n"), ("ƒ", "f")])
    # every formula token holds a colon
    mapped = F.when(F.col("_x").contains(":"), B.repair_formula_tokens(F.col("_x"))).otherwise(F.col("_x"))
    seg = WR.repairable_segments(F.col("_m"))
    staged = df.withColumn("_x", x).withColumn("_m", mapped).withColumn("_s", seg)
    changed = F.filter("_s", lambda s: s["changed"])
    formula = F.col("_m") != F.col("_x")
    best = F.coalesce(F.array_max(F.transform(changed, lambda s: s["confidence"])), F.lit(0.0))
    return staged.select(
        key,
        F.coalesce(F.size(changed), F.lit(0)).cast("long").alias("tokens_changed"),
        F.coalesce(F.size(F.filter(changed, lambda s: s["confidence"] >= WR.ACCEPT)), F.lit(0)).cast("long").alias("tokens_accepted"),
        formula.alias("formula_changed"),
        F.greatest(best, F.when(formula, 0.99).otherwise(0.0)).alias("confidence"),
    )


def collapse_or_preserve(df: DataFrame, text: str = "text", source_type: str = "source_type") -> DataFrame:
    mode = B.structure_mode(F.col(text), F.col(source_type))
    staged = df.withColumn("_mode", mode)
    return staged.select(
        *df.columns, F.col("_mode").alias("mode"),
        F.when(F.col("_mode") == "line-preserved", R.text(text)).otherwise(B.collapse_paragraphs(F.col(text))).alias("clean_text"),
    )


def repair_page_breaks(pages: DataFrame, doc: str = "doc_id", page: str = "page_no", text: str = "text") -> DataFrame:
    """A word hyphenated over a page end is completed on the first page.

    Page i joins page i+1 when it ends in a hyphenated word and the next one
    starts with a word.  Only a page that is nothing but one hyphenated word
    depends on the page before it: if it lost that word it has nothing left to
    join with, so along a run of such pages the joins alternate.
    """
    w = Window.partitionBy(doc).orderBy(page)
    x = F.regexp_replace(R.text(text), r"\s+\z", "")
    s = pages.select(
        "*",
        x.rlike(r"\p{L}{2,}-\z").alias("_ends"),
        F.regexp_extract(x, r"^\s*(\p{L}+)", 1).alias("_first"),
        x.rlike(r"^\s*\p{L}+-\z").alias("_only"),
    )
    s = s.withColumn("_next", F.coalesce(F.lead("_first").over(w), F.lit("")))
    s = s.withColumn("_e", F.col("_ends") & (F.col("_next") != ""))
    s = s.withColumn("_chain", F.col("_e") & F.col("_only"))
    s = s.withColumn("_run", F.sum(F.when(F.col("_chain"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    run = Window.partitionBy(doc, "_run").orderBy(page)
    # rank 0 is the page before the run, whose own join decides the parity
    s = s.withColumn("_k", F.row_number().over(run) - F.when(F.first("_chain").over(run), 0).otherwise(1))
    s = s.withColumn("_head", F.first("_chain").over(run)).withColumn("_p", ~F.col("_head") & F.first("_e").over(run))
    join = F.when(F.col("_chain"), F.when(F.col("_k") % 2 == 1, ~F.col("_p")).otherwise(F.col("_p"))).otherwise(F.col("_e"))
    s = s.withColumn("_join", join).withColumn("_lost", F.coalesce(F.lag("_join").over(w), F.lit(False)))
    cut = F.when(F.col("_lost"), F.regexp_replace(F.col(text), r"^\s*\p{L}+[^\S\n]*", "")).otherwise(R.text(text))
    out = F.when(F.col("_join"), F.concat(F.regexp_replace(cut, r"-?\s*\z", ""), F.col("_next"))).otherwise(cut)
    tidy = R.strip(F.regexp_replace(out, r"\n{3,}", "\n\n"))
    return s.select(
        *[c for c in pages.columns if c != text],
        F.when(F.col("_join") | F.col("_lost"), tidy).otherwise(out).alias(text),
        F.col("_join").alias("joined"),
    )


def _last_word(t: Column) -> Column:
    return F.regexp_extract(t, r"(\p{L}+)-?\z", 1)


def _first_word(t: Column) -> Column:
    return F.regexp_extract(F.regexp_replace(t, r"^[-–—]+", ""), r"^\p{L}+", 0)


def joins_without_space(current: Column, following: Column) -> Column:
    a, b = R.strip(current), R.strip(following)
    last, first = _last_word(a), _first_word(b)
    broken = (
        ~last.rlike(r"\p{Lu}") & ~first.rlike(r"\p{Lu}") & last.rlike(r"(aca|ece)\z") & first.rlike(r"^g[ıiuü]z\z")
    )
    return (last != "") & (first != "") & (a.endswith("-") | broken)


def merged_line(current: Column, following: Column, tight: Column) -> Column:
    a = R.strip(current)
    b = F.regexp_replace(R.strip(following), r"^[-–—]+", "")
    last, first = _last_word(a), _first_word(b)
    token = F.concat(last, first)
    for end in "zmn":
        token = F.regexp_replace(token, rf"(aca|ece)g([ıiuü]){end}\z", f"$1ğ$2{end}")
    prefix = F.substring(a, F.lit(1), F.length(F.regexp_replace(a, r"\p{L}+-?\z", "")))
    close = F.concat(prefix, token, F.substring(b, F.length(first) + 1, F.length(b)))
    return R.strip(F.regexp_replace(F.when(tight, close).otherwise(F.concat(a, F.lit(" "), b)), r"\s+", " "))


def _squeezed(t: Column) -> Column:
    return R.strip(F.regexp_replace(t, R.UNEVEN_SPACE, " "))


def _line(l: Column) -> Column:
    """What merging asks of one line; ``rest`` is what follows the line before, ``first`` its first word."""

    def facts(v: Column) -> Column:
        return F.struct(
            v["t"].alias("t"), _squeezed(v["t"]).alias("sq"), P.is_plain_line(v["t"]).alias("plain"),
            _squeezed(v["b"]).alias("rest"), F.regexp_extract(v["b"], r"^\p{L}+", 0).alias("first"),
        )

    return R.let(R.let(R.strip(l), lambda t: F.struct(t.alias("t"), F.regexp_replace(t, r"^[-–—]+", "").alias("b"))), facts)


def merge_wrapped_lines(lines: Column) -> Column:
    """Lines of one block -> struct(lines, fixes): wrapped prose lines joined.

    Whether the next line joins depends on the line merged so far, so this is
    a fold over the (bounded) line array of a block.  The merged line is kept
    as pieces of which only the last word can still change; what is asked of
    it is asked of the seam, so the work grows with the text, not its square.
    """
    clean = F.transform(lines, lambda l: R.rstrip(R.text(l)))
    none = F.array().cast("array<string>")
    start = F.struct(
        none.alias("done"), F.lit(None).cast("string").alias("show"), none.alias("pre"), F.lit("").alias("tail"), F.lit("").alias("ctx"),
        F.lit(0).alias("len"), F.lit(False).alias("plain"), F.lit(False).alias("merged"), none.alias("fixes"),
    )

    def whole(pre: Column, tail: Column) -> Column:
        return F.array_join(F.array_append(pre, tail), " ")

    def shown(s: Column) -> Column:
        return F.when(s["merged"], whole(s["pre"], s["tail"])).otherwise(s["show"])

    def taken(s: Column, f: Column) -> Column:
        """The merged line with one line more; a word broken at the seam is put together."""

        def kept(v: Column) -> Column:
            # a formula that neither side holds lies across the seam, within eight characters of it
            text = whole(v["pre"], v["tail"])
            formula = P.is_formula_like(v["seam"]) & P.is_formula_like(text)
            return F.struct(
                s["done"].alias("done"), s["show"].alias("show"), v["pre"].alias("pre"), v["tail"].alias("tail"), v["ctx"].alias("ctx"), v["len"].alias("len"),
                (~formula & ~F.when(v["len"] <= 80, P.is_heading(text)).otherwise(False)).alias("plain"), F.lit(True).alias("merged"),
                F.array_union(s["fixes"], F.array(v["fix"])).alias("fixes"),
            )

        def made(pre: Column, tail: Column, left: Column, gap: str, length: Column, fix: Column | str) -> Column:
            return F.struct(
                pre.alias("pre"), tail.alias("tail"), F.right(F.concat(left, F.lit(gap), f["rest"]), F.lit(24)).alias("ctx"), length.alias("len"),
                F.concat(F.right(left, F.lit(8)), F.lit(gap), F.left(f["rest"], F.lit(8))).alias("seam"), (F.lit(fix) if isinstance(fix, str) else fix).alias("fix"),
            )

        def joined(v: Column) -> Column:
            word, last = v["word"], v["last"]
            broken = (
                ~last.rlike(r"\p{Lu}") & ~f["first"].rlike(r"\p{Lu}") & last.rlike(r"(aca|ece)\z") & f["first"].rlike(r"^g[ıiuü]z\z")
            )
            hyphen = word.endswith("-")
            token = F.concat(last, f["first"])
            for end in "zmn":
                token = F.regexp_replace(token, rf"(aca|ece)g([ıiuü]){end}\z", f"$1ğ$2{end}")
            before = F.length(s["tail"]) - F.length(word) - 1
            pre = F.when(before > 0, F.array_append(s["pre"], F.left(s["tail"], before))).otherwise(s["pre"])
            close = F.concat(
                F.substring(word, F.lit(1), F.length(word) - F.length(last) - F.when(hyphen, 1).otherwise(0)), token,
                F.substring(f["rest"], F.length(f["first"]) + 1, F.length(f["rest"])),
            )
            left = F.when(hyphen, F.regexp_replace(s["ctx"], r"-\z", "")).otherwise(s["ctx"])
            fix = F.when(hyphen, "merged hyphenated word").otherwise("merged broken word")
            tight = made(pre, close, left, "", s["len"] - F.length(word) + F.length(close), fix)
            bare = f["rest"] == ""
            loose = made(
                F.when(bare, s["pre"]).otherwise(F.array_append(s["pre"], s["tail"])), F.when(bare, s["tail"]).otherwise(f["rest"]),
                s["ctx"], " ", s["len"] + F.when(bare, 0).otherwise(F.length(f["rest"]) + 1), "merged wrapped line",
            )
            # a line of dashes alone adds nothing
            loose = F.when(bare, loose.withField("ctx", s["ctx"])).otherwise(loose)
            return F.when((last != "") & (f["first"] != "") & (hyphen | broken), tight).otherwise(loose)

        word = F.substring_index(s["tail"], " ", -1)
        return R.let(R.let(R.let(word, lambda w: F.struct(w.alias("word"), _last_word(w).alias("last"))), joined), kept)

    def step(s: Column, f: Column) -> Column:
        fresh = F.struct(
            F.when(s["show"].isNull(), s["done"]).otherwise(F.array_append(s["done"], shown(s))).alias("done"), f["t"].alias("show"), none.alias("pre"),
            f["sq"].alias("tail"), F.right(f["sq"], F.lit(24)).alias("ctx"), F.length(f["sq"]).alias("len"), f["plain"].alias("plain"),
            F.lit(False).alias("merged"), s["fixes"].alias("fixes"),
        )
        return F.when(s["show"].isNotNull() & s["plain"] & f["plain"], taken(s, f)).otherwise(fresh)

    def finish(c: Column, s: Column) -> Column:
        # a single line is passed through untrimmed
        last = F.when(F.size(c) == 1, F.get(c, F.lit(0))).otherwise(F.coalesce(shown(s), F.lit("")))
        return F.struct(F.filter(F.array_append(s["done"], last), lambda l: l != "").alias("lines"), s["fixes"].alias("fixes"))

    return R.let(clean, lambda c: F.aggregate(F.transform(c, _line), start, step, lambda s: finish(c, s)))


def _continues_math(l: Column) -> Column:
    return (l != "") & (
        R.matches(l, MATH_CONTINUATION[0]) | R.matches(l, MATH_CONTINUATION[1]) | R.matches(l, MATH_CONTINUATION[2])
    )


def join_math_lines(col: Column) -> Column:
    """Rule heading, formula, limit subscript and tail on one readable line.

    How many following lines a line would absorb depends on those lines only;
    a fold then walks the lines and skips the absorbed ones.
    """

    def merge(lines: Column) -> Column:
        at = lambda i: F.coalesce(F.get(lines, i), F.lit(""))
        limit = lambda l: R.matches(l, r"\blim\b")
        under = lambda l: R.matches(l, LIMIT_SUBSCRIPT)

        def taken(i: Column) -> Column:
            heading = R.matches(at(i), RULE_HEADING) & _continues_math(at(i + 1))
            return (
                F.when(heading & limit(at(i + 1)) & under(at(i + 2)), F.when(_continues_math(at(i + 3)), 3).otherwise(2))
                .when(heading, 1)
                .when(
                    limit(at(i)) & under(at(i + 1)),
                    F.when(_continues_math(at(i + 2)), F.when(_continues_math(at(i + 3)), 3).otherwise(2)).otherwise(1),
                )
                .when(R.matches(at(i), LIMIT_WITH_SUBSCRIPT) & _continues_math(at(i + 1)), 1)
                .otherwise(0)
            )

        def step(s: Column, i: Column) -> Column:
            def put(n: Column) -> Column:
                joined = B.normalize_pdf_math(
                    F.array_join(F.filter(F.slice(lines, i + 1, n + 1), lambda l: l != ""), " ")
                )
                return F.struct(
                    F.array_append(s["out"], F.when(n > 0, joined).otherwise(at(i))).alias("out"), n.alias("skip")
                )

            blank_again = (at(i) == "") & (F.coalesce(F.try_element_at(s["out"], F.lit(-1)), F.lit("x")) == "")
            return (
                F.when(s["skip"] > 0, F.struct(s["out"].alias("out"), (s["skip"] - 1).alias("skip")))
                .when(blank_again, s)
                .otherwise(R.let(taken(i), put))
            )

        start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("skip"))
        return F.aggregate(
            F.sequence(F.lit(0), F.size(lines) - 1), start, step, lambda s: F.array_join(s["out"], "\n")
        )

    def body(norm: Column) -> Column:
        # each line is normalised once more on its own; blank runs shrink
        lines = F.split(F.regexp_replace(norm, r"\n{2,}", "\n\n"), "\n")
        merged = R.let(F.transform(lines, B.normalize_pdf_math), merge)
        return F.when(norm == "", "").otherwise(R.strip(F.regexp_replace(merged, r"\n{3,}", "\n\n")))

    return R.let(B.normalize_pdf_math(col), body)
