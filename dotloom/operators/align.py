"""Alignment of original text with its cells.

Texts of one row are aligned in place.  Joins are on equal keys (document and
position), never on ranges, so no pairs are formed inside a document.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import blocks as K
from ..functions import language as L
from ..functions import regex as R
from ..functions import wordrepair as WR
from . import structure as S
from .transcoding import PAGE_MARKER

# --- fixed values: mathematical token shapes -----------------------------------
MATH_TEXT = r"\blim\b|√|∫|∑|→|=|\^|/|·|[(){}\[\]]"
MATH_TOKENS = r"\s+|[0-9]+(?:\.[0-9]+)?|[A-Za-z]+|[^\sA-Za-z0-9]"
MATH_OPERATOR = r"^[=+\-*/^(){}\[\],.:;]$"
# ---------------------------------------------------------------------------------


def paragraphs(col: Column) -> Column:
    """Text -> array of its non-empty paragraphs."""
    x = R.text(col)
    x = F.when(x.contains("\r"), F.replace(x, F.lit("\r\n"), F.lit("\n"))).otherwise(x)
    return F.filter(F.transform(F.split(x, "\n{2,}"), _stripped), lambda p: p != "")


def _stripped(p: Column) -> Column:
    """``R.strip``, which measures every character, only where a value begins or ends with white space."""
    edges = [side(F.lit(s)) for s in R.SPACES for side in (p.startswith, p.endswith)]
    return F.when(reduce(lambda a, b: a | b, edges), R.strip(p)).otherwise(p)


def aligned_rows(original: Column, braille: Column) -> Column:
    """Original paragraphs with their share of the Braille paragraphs: array of struct(original, braille).

    Fewer or as many Braille paragraphs are paired one to one; surplus ones go to proportional buckets.
    """

    def pair(v: Column) -> Column:
        o, b = v["o"], v["b"]
        n_o, n_b = F.size(o), F.size(b)
        ratio = n_b / F.greatest(n_o, F.lit(1))
        cut = lambda i: F.floor(i * ratio + 0.5).cast("int")
        end = lambda i: F.when(i == n_o - 1, n_b).otherwise(cut(i + 1))
        bucket = lambda i: F.array_join(F.slice(b, cut(i) + 1, end(i) - cut(i)), " ")
        row = lambda a, c: F.struct(a.alias("original"), c.alias("braille"))
        return (
            # Braille of a document without any original text stays visible
            F.when(n_o == 0, F.transform(b, lambda c: row(F.lit(""), c)))
            .when(n_b <= n_o, F.transform(o, lambda p, i: row(p, F.coalesce(F.get(b, i), F.lit("")))))
            .otherwise(F.transform(o, lambda p, i: row(p, bucket(i))))
        )

    return R.let(F.struct(paragraphs(original).alias("o"), paragraphs(braille).alias("b")), pair)


def align_paragraphs(df: DataFrame, key: str = "doc_id", original: str = "text", braille: str = "braille") -> DataFrame:
    """One row per original paragraph with its share of the Braille paragraphs; see ``aligned_rows``.

    Both texts are in the same row, so the buckets are array slices and nothing is joined or shuffled.
    """
    rows = df.select(key, F.posexplode(aligned_rows(F.col(original), F.col(braille))).alias("row_no", "_r"))
    return rows.select(key, "row_no", "_r.original", "_r.braille")


def align_words(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """Word pairs by position inside every aligned row, padded, with a running index.

    ``rows`` has a row per document with the array ``rows`` of struct(original, braille), as ``aligned_rows`` makes it.
    The pairs of all rows are one array, so a word's number is its place in it.
    """

    # a row without words on a side has one empty word there, as padding gives it
    words = lambda t: F.split(_stripped(R.text(t)), r"\s+")
    sides = F.transform("rows", lambda r: F.struct(words(r["original"]).alias("a"), words(r["braille"]).alias("b")))
    n = lambda r: F.greatest(F.size(r["a"]), F.size(r["b"]))
    padded = lambda side: F.flatten(
        F.transform("_s", lambda r: F.when(F.size(r[side]) == n(r), r[side]).otherwise(F.concat(r[side], F.array_repeat(F.lit(""), n(r) - F.size(r[side])))))
    )
    # columns of the words of all rows, filled without a step for each word
    every = F.arrays_zip(
        F.flatten(F.transform("_s", lambda r, i: F.array_repeat(i, n(r)))).alias("row_no"),
        F.flatten(F.transform("_s", lambda r: F.sequence(F.lit(0), n(r) - 1))).alias("pos"),
        padded("a").alias("original"), padded("b").alias("cells"),
    )
    shown = rows.select(key, sides.alias("_s")).select(key, F.posexplode(every).alias("word_index", "_w"))
    return shown.select(key, "_w.row_no", "_w.pos", "_w.original", "_w.cells", "word_index")


def attach_braille(df: DataFrame, keys: list[str] | None = None, tree: str = "tree", braille: str = "braille") -> DataFrame:
    """Leaf k of a document's block tree takes paragraph k of its Braille, the last leaf takes the rest, parents join
    their children.  Tree and Braille are in one row, so nothing is joined: (id, parent_id, cells) per node."""
    keys = keys or ["doc_id"]
    nodes = K.attached(F.col(tree), paragraphs(F.col(braille)))
    return df.select(*keys, F.explode(nodes).alias("_n")).select(*keys, "_n.id", "_n.parent_id", "_n.cells")


def is_math_text(col: Column) -> Column:
    return R.matches(R.text(col), MATH_TEXT)


def _tokens(text: Column, is_math: Column) -> Column:
    return F.when(is_math, R.extract_all(R.text(text), MATH_TOKENS)).otherwise(R.extract_all(R.text(text), r"\s+|[^\s]+"))


def _is_space(token: Column) -> Column:
    first = F.ascii(token)
    return (first == 32) | first.between(9, 13)


def highlight_tokens(df: DataFrame, text: str, is_math: Column) -> DataFrame:
    """Text -> rows (pos, token, kind, token_index); spaces carry no index."""
    keep = [c for c in df.columns if c != text]
    toks = _tokens(F.col(text), is_math)
    space = _is_space
    # most tokens are words, so one cheap test goes before that of the operators
    operator = lambda t: (F.length(t) == 1) & R.matches(t, MATH_OPERATOR)
    kind = lambda s, t, m: F.when(s, "space").when(~m, "word").when(operator(t), "operator").otherwise("math")
    x = df.withColumn("_m", is_math).withColumn("_t", toks)
    # a token's index is its place in the array of those that are not spaces
    x = x.withColumn("_z", F.transform("_t", lambda t, i: F.struct(i.alias("pos"), t.alias("token"), space(t).alias("space"))))
    x = x.withColumn("_shown", F.filter("_z", lambda z: ~z["space"]))
    one = lambda z, k: F.struct(z["pos"].alias("pos"), z["token"].alias("token"), k.cast("int").alias("token_index"), z["space"].alias("space"))
    shown = F.transform("_shown", lambda z, k: one(z, k))
    spaces = F.transform(F.filter("_z", lambda z: z["space"]), lambda z: one(z, F.lit(None)))
    e = x.select(*keep, "_m", F.size("_shown").alias("n_tokens"), F.explode(F.concat(shown, spaces)).alias("_z"))
    return e.select(*keep, "_z.pos", "_z.token", kind(F.col("_z.space"), F.col("_z.token"), F.col("_m")).alias("kind"), "_z.token_index", "n_tokens")


def counterpart(index: Column, n: Column, m: Column) -> Column:
    """Token i of n -> token of m on the other side."""
    return F.when(index.isNotNull() & (n > 0) & (m > 0), F.least(m - 1, F.floor(index / n * m).cast("int")))


def align_tokens(df: DataFrame, key: str, original: str, braille: str) -> DataFrame:
    """Token rows of both sides with the index of their counterpart."""
    sides = df.select(key, F.col(original).alias("_o"), F.col(braille).alias("_b"), is_math_text(F.col(original)).alias("_mo"))
    sides = sides.withColumn("_mb", F.col("_mo") | is_math_text(F.col("_b")))
    # both counts are known in the row, before its tokens are rows
    count = lambda text, is_math: F.size(F.filter(_tokens(F.col(text), F.col(is_math)), lambda t: ~_is_space(t)))
    sides = sides.withColumns({"_no": count("_o", "_mo"), "_nb": count("_b", "_mb")})
    o = highlight_tokens(sides.drop("_b", "_mb"), "_o", F.col("_mo")).withColumn("side", F.lit("original")).drop("_mo")
    b = highlight_tokens(sides.drop("_o", "_mo"), "_b", F.col("_mb")).withColumn("side", F.lit("braille")).drop("_mb")
    x = o.unionByName(b)
    n, m = F.col("_no"), F.col("_nb")
    other = F.when(F.col("side") == "original", counterpart(F.col("token_index"), n, m)).otherwise(counterpart(F.col("token_index"), m, n))
    return x.select(key, "side", "pos", "token", "kind", "token_index", other.alias("counterpart_index"), (n != m).alias("degraded"))


def interaction_keys(tokens: DataFrame, block: str, segment: str) -> DataFrame:
    """Keys that tie a token to its counterpart on the other side."""
    other = F.when(F.col("side") == "original", "braille").otherwise("original")
    key = lambda side, i: F.concat_ws("::", F.col(block).cast("string"), side, F.col(segment), F.lit("token"), i.cast("string"))
    i, c = F.col("token_index"), F.col("counterpart_index")
    token_key = F.when(
        i.isNull(), F.concat_ws("::", F.col(block).cast("string"), F.col("side"), F.col(segment), F.lit("space"), F.col("pos").cast("string"))
    ).otherwise(F.concat_ws("::", key(F.col("side"), i), F.col("pos").cast("string")))
    return tokens.select(
        "*", token_key.alias("token_key"), F.when(i.isNotNull(), key(F.col("side"), i)).alias("interaction_key"),
        F.when(i.isNotNull() & c.isNotNull(), key(other, c)).alias("counterpart_key"),
    )


def display_rows(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per line and word: the raw and the repaired word and a running index, its place among all words of the text."""
    x = F.regexp_replace(F.replace(R.text(text), F.lit("\r\n"), F.lit("\n")), r"\s+\z", "")
    shown = lambda t: F.regexp_extract_all(t, F.lit(r"\S+"), 0)

    def words(line: Column, n: Column) -> Column:
        return R.let(
            F.struct(shown(line).alias("raw"), F.when(WR.may_need_repair(line), shown(WR.repair_text(line))).alias("fix")),
            # a line that needs no repair is read once
            lambda v: F.when(
                v["fix"].isNull(), F.transform(v["raw"], lambda w, i: F.struct(n.alias("line_no"), i.alias("pos"), w.alias("raw"), w.alias("repaired")))
            ).otherwise(
                F.transform(
                    F.slice(F.sequence(F.lit(0), F.greatest(F.size(v["raw"]), F.size(v["fix"]))), F.lit(1), F.greatest(F.size(v["raw"]), F.size(v["fix"]))),
                    lambda i: F.struct(
                        n.alias("line_no"), i.alias("pos"), F.coalesce(F.get(v["raw"], i), F.lit("")).alias("raw"),
                        F.coalesce(F.get(v["fix"], i), F.get(v["raw"], i), F.lit("")).alias("repaired"),
                    ),
                )
            ),
        )

    e = df.select(key, F.posexplode(F.flatten(F.transform(F.split(x, "\n"), words))).alias("word_index", "_w"))
    return e.select(key, "_w.*", "word_index")


def review_pages(original_pages: Column, braille: Column) -> Column:
    """Share the Braille paragraphs out to the original pages.

    array of struct(original, braille): every page takes its proportional
    share, at least one chunk, and the last page takes the rest.  The clamps
    depend on what earlier pages took, so the pages of a document are folded.
    """

    def share(s: Column) -> Column:
        pages, chunks, want = s["pages"], s["chunks"], s["want"]
        n, total = F.size(pages), F.aggregate(want, F.lit(0), lambda a, x: a + x)
        start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("at"))

        def step(st: Column, i: Column) -> Column:
            left = F.size(chunks) - st["at"]
            later = F.size(F.filter(F.slice(want, i + 2, n), lambda x: x > 0))
            most = F.greatest(left - F.least(later, F.greatest(left - 1, F.lit(0))), F.lit(1))
            fair = F.floor(F.size(chunks) * F.get(want, i) / total + 0.5).cast("int")
            take = (
                F.when(i == n - 1, F.greatest(left, F.lit(0))).when(F.get(want, i) == 0, 0)
                .otherwise(F.greatest(F.lit(1), F.least(fair, most)))
            )
            return R.let(
                take,
                lambda k: F.struct(
                    F.array_append(st["out"], R.strip(F.array_join(F.slice(chunks, st["at"] + 1, k), "\n\n"))).alias("out"),
                    (st["at"] + k).alias("at"),
                ),
            )

        parts = F.aggregate(F.sequence(F.lit(0), n - 1), start, step, lambda st: st["out"])
        whole = F.array_join(chunks, "\n\n")
        got = (
            F.when(n <= 1, F.array(R.strip(R.text(braille)))).when(F.size(chunks) == 0, F.transform(pages, lambda _: F.lit("")))
            .when(total == 0, F.array(whole)).otherwise(parts)
        )
        return R.let(
            got,
            lambda g: F.transform(
                pages, lambda p, i: F.struct(p.alias("original"), F.coalesce(F.get(g, i), F.lit("")).alias("braille"))
            ),
        )

    parts = F.struct(
        original_pages.alias("pages"), paragraphs(braille).alias("chunks"),
        F.transform(original_pages, lambda p: F.size(paragraphs(p))).alias("want"),
    )
    empty = F.array().cast("array<struct<original:string,braille:string>>")
    return R.let(parts, lambda s: F.when(F.size(s["pages"]) == 0, empty).otherwise(share(s)))


def review_documents(
    df: DataFrame, key: str = "doc_id", text: str = "text", braille: str = "braille", source_type: str = "source_type", marker: str = PAGE_MARKER
) -> DataFrame:
    """Stored documents -> their pages side by side: page_no, original, braille, and the page's mode and language.

    Braille that has page markers is cut by them; where its pages are as many as the original's they are paired, else
    its paragraphs are shared out to the original pages (see ``review_pages``).
    """
    source = F.col(source_type)

    def pair(v: Column) -> Column:
        originals, cells = v["o"], v["b"]
        paired = F.transform(originals, lambda p, i: F.struct(p.alias("original"), F.coalesce(F.get(cells, i), F.lit("")).alias("braille")))
        keep = v["marked"] & ((F.size(originals) <= 1) | (F.size(originals) == F.size(cells)))
        whole = F.when(v["marked"], F.array_join(cells, "\n\n")).otherwise(v["raw"])
        return F.when(keep, paired).otherwise(review_pages(originals, whole))

    raw = R.strip(F.replace(R.text(braille), F.lit("\r\n"), F.lit("\n")))
    marked = raw.contains(marker)
    both = F.struct(
        S.review_page_texts(F.col(text), source, marker).alias("o"), raw.alias("raw"), marked.alias("marked"),
        F.when(marked, S.review_page_texts(raw, source, marker)).otherwise(F.array().cast("array<string>")).alias("b"),
    )
    rows = df.select(key, source_type, F.posexplode(R.let(both, pair)).alias("_p", "_r"))
    return rows.select(
        key, (F.col("_p") + 1).alias("page_no"), "_r.original", "_r.braille", K.structure(F.col("_r.original"), source)["mode"].alias("mode"),
        L.detect_language(L.language_scores(F.col("_r.original")))["language"].alias("language"),
    )
