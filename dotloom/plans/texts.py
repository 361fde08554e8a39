"""Named queries: text repair, normalisation and line predicates."""

from __future__ import annotations

from pyspark.sql import Column, Window, functions as F

from ..functions import predicates as P
from ..functions import regex as R
from ..functions import text as B
from ..functions import wordrepair as WR
from ..operators import repair as RP
from . import duck as D, sqlrules as S
from .catalog import catalog
from .sqlrepair import segments_sql
from .sqlstructure import merged_sql, recursive
from .views import library_docs, marked_docs, marked_lines, table, with_views


def _scalar(name: str, ids: str, fn, sql) -> None:
    """Register a scalar text rule over every document."""

    @catalog.add(name, ids, with_views(f"SELECT doc_id, {sql('text')} AS result FROM marked_docs", "marked_docs"))
    def _(spark, sf):
        return marked_docs(spark, sf).select("doc_id", fn(F.col("text")).alias("result"))


def _line_scalar(name: str, ids: str, fn, sql, only: str | None = None) -> None:
    """Register a scalar rule over every line; equal lines are counted once each."""
    oracle = None if sql is None else with_views(
        f"SELECT doc_id, line_no, {sql('text')} AS result FROM marked_lines", "marked_docs", "marked_lines"
    )

    @catalog.add(name, ids, oracle)
    def _(spark, sf):
        return marked_lines(spark, sf).select("doc_id", "line_no", fn(F.col("text")).alias("result"))


_scalar("fix_encoding", "B1", B.fix_encoding, S.fix_encoding)
_line_scalar("normalize_math_input", "B2", B.normalize_math_input, S.normalize_math_input)
_line_scalar("normalize_pdf_math", "B3", B.normalize_pdf_math, S.normalize_pdf_math)
_line_scalar("repair_formula_tokens", "B5", B.repair_formula_tokens, S.formula_tokens)
_line_scalar("normalize_structured_math", "B11", B.normalize_structured_math, S.normalize_structured_math)
_scalar("improve_text", "B13", B.improve_text, lambda x: S.trim(S.improve_spacing(x)))
_line_scalar("normalize_line", "B14", B.normalize_line, S.normalize_line)
_line_scalar("clean_optional", "B17", B.clean_optional, S.clean_optional)


def _continues(x: str) -> str:
    return f"({x} <> '' AND {S.any_of(x, *RP.MATH_CONTINUATION)})"


_LIM, _UNDER = (lambda x: D.matches(x, r"\blim\b")), (lambda x: D.matches(x, RP.LIMIT_SUBSCRIPT))
_TAKEN = f"""CASE WHEN {D.matches('a0', RP.RULE_HEADING)} AND {_continues('a1')} AND {_LIM('a1')} AND {_UNDER('a2')} THEN CASE WHEN {_continues('a3')} THEN 3 ELSE 2 END
  WHEN {D.matches('a0', RP.RULE_HEADING)} AND {_continues('a1')} THEN 1 WHEN {_LIM('a0')} AND {_UNDER('a1')} THEN CASE WHEN {_continues('a2')} THEN CASE WHEN {_continues('a3')} THEN 3 ELSE 2 END ELSE 1 END
  WHEN {D.matches('a0', RP.LIMIT_WITH_SUBSCRIPT)} AND {_continues('a1')} THEN 1 ELSE 0 END"""


@catalog.add("join_math_lines", "B4", recursive(with_views(f"""WITH jn AS (SELECT doc_id, {S.normalize_pdf_math('text')} AS t FROM marked_docs),
 j0 AS (SELECT doc_id, CAST(generate_subscripts(x, 1) AS INT) AS i, unnest(x) AS line FROM (SELECT doc_id, string_split(regexp_replace(t, '\\n{{2,}}', chr(10) || chr(10), 'g'), chr(10)) AS x FROM jn WHERE t <> '')),
 j1 AS (SELECT doc_id, i, {S.normalize_pdf_math('line')} AS a0 FROM j0),
 j2 AS (SELECT *, {', '.join(f"coalesce(lead(a0, {k}) OVER w, '') AS a{k}" for k in (1, 2, 3))} FROM j1 WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
 j3 AS (SELECT *, {_TAKEN} AS n FROM j2),
 j4 AS MATERIALIZED (SELECT doc_id, i, a0, n, CASE WHEN n > 0 THEN {S.normalize_pdf_math("concat_ws(' ', nullif(a0, ''), nullif(a1, ''), CASE WHEN n > 1 THEN nullif(a2, '') END, CASE WHEN n > 2 THEN nullif(a3, '') END)")} ELSE a0 END AS made FROM j3),
 j5 AS (SELECT DISTINCT doc_id, 0 AS i, 0 AS skip, CAST(NULL AS VARCHAR) AS out, 'x' AS last FROM j4
  UNION ALL SELECT n.doc_id, n.i, CASE WHEN p.skip > 0 THEN p.skip - 1 WHEN n.a0 = '' AND p.last = '' THEN 0 ELSE n.n END, CASE WHEN p.skip > 0 OR (n.a0 = '' AND p.last = '') THEN NULL ELSE n.made END, CASE WHEN p.skip > 0 OR (n.a0 = '' AND p.last = '') THEN p.last ELSE n.made END
  FROM j5 p JOIN j4 n ON n.doc_id = p.doc_id AND n.i = p.i + 1)
SELECT doc_id, {S.trim("regexp_replace(coalesce(x, ''), '" + chr(92) + "n{3,}', chr(10) || chr(10), 'g')")} AS result FROM jn LEFT JOIN (SELECT doc_id, string_agg(out, chr(10) ORDER BY i) AS x FROM j5 GROUP BY doc_id) USING (doc_id)""", "marked_docs")))
def _(spark, sf):
    return marked_docs(spark, sf).select("doc_id", RP.join_math_lines(F.col("text")).alias("result"))


@catalog.add("repair_colon_words", "B8")
def _(spark, sf):
    toks = RP.word_tokens(marked_docs(spark, sf).select("doc_id", "text"))
    colon = toks.filter(WR.is_colon_word(F.col("word"))).groupBy("word").agg(F.count("*").alias("uses"))
    fixed = colon.withColumn("_r", WR.repair_colon_word(F.col("word")))
    return fixed.select("word", "uses", F.col("_r.text").alias("repaired"), F.col("_r.confidence").alias("confidence"))


_TOKENS = f"""t AS (SELECT doc_id, CAST(generate_subscripts(x, 1) - 1 AS INT) AS pos, unnest(x) AS word
 FROM (SELECT doc_id, {D.extract_all('text', WR.SEGMENTS)} AS x FROM marked_docs))"""
_TR_LOWER = "lower(translate({0}, 'Iİ', 'ıi'))"
_DICT = "d(key, repaired) AS (VALUES " + ", ".join(f"({D.q(k)}, {D.q(v)})" for k, v in WR.DICTIONARY.items()) + ")"


def _tr_upper(x: str) -> str:
    return f"upper(translate({x}, 'iı', 'İI'))"


def preserve_case_sql(o: str, r: str) -> str:
    first = D.extract(o, r"\p{L}", 0)
    return f"""CASE WHEN starts_with({o}, ':') OR {first} = '' THEN {r} WHEN NOT regexp_matches({o}, '\\p{{Ll}}') THEN {_tr_upper(r)}
 WHEN {first} = {_tr_upper(first)} THEN concat({_tr_upper(f'substr({r}, 1, 1)')}, substr({r}, 2)) ELSE {r} END"""


@catalog.add("repair_words", "B6", with_views(f"""
WITH {_TOKENS}, {_DICT}
SELECT doc_id, pos, word, coalesce({preserve_case_sql('word', 'repaired')}, word) AS fixed
FROM t JOIN d ON key = {_TR_LOWER.format('word')}""", "marked_docs"))
def _(spark, sf):
    toks = RP.word_tokens(marked_docs(spark, sf).select("doc_id", "text"))
    fixed = RP.repair_words(toks)
    return fixed.filter(WR.tr_lower(F.col("word")).isin(list(WR.DICTIONARY)))


@catalog.add("repair_markers", "B7", with_views(f"""
WITH {_TOKENS}, m AS (SELECT doc_id, pos, word, {D.replace_all('word', WR.MARKER_PAIRS)} AS r FROM t WHERE regexp_matches(word, '["˘¸¨]'))
SELECT doc_id, pos, word, CASE WHEN regexp_matches(r, '["˘¸¨]') THEN word ELSE r END AS fixed FROM m""", "marked_docs"))
def _(spark, sf):
    toks = RP.word_tokens(marked_docs(spark, sf).select("doc_id", "text")).filter(F.col("word").rlike('["˘¸¨]'))
    return toks.withColumn("fixed", WR.repair_markers(F.col("word")))


@catalog.add("repair_report", "B9", with_views(f"""
WITH {segments_sql('marked_docs', 'doc_id')}
SELECT doc_id, count(*) FILTER (WHERE changed) AS tokens_changed, count(*) FILTER (WHERE changed AND confidence >= 0.85) AS tokens_accepted, bool_or(formula) AS formula_changed,
 greatest(coalesce(max(confidence) FILTER (WHERE changed), 0.0), CASE WHEN bool_or(formula) THEN 0.99 ELSE 0.0 END) AS confidence FROM sg GROUP BY doc_id""", "marked_docs"))
def _(spark, sf):
    return RP.repair_report(marked_docs(spark, sf), "doc_id")


@catalog.add("repair_documents", "B6 B7 B8", with_views(f"""
WITH {segments_sql('marked_docs', 'doc_id')}
SELECT doc_id, string_agg(CASE WHEN confidence >= 0.85 THEN fixed ELSE seg END, '' ORDER BY pos) AS result FROM sg GROUP BY doc_id""", "marked_docs"))
def _(spark, sf):
    return marked_docs(spark, sf).select("doc_id", WR.repair_text(F.col("text")).alias("result"))


_COLLAPSED = S.trim(
    D.sub(
        D.sub(
            D.sub(
                "replace(replace(replace(@x@, chr(10) || chr(10), chr(1)), chr(10), ' '), chr(1), chr(10) || chr(10))",
                r"[ \t\r\f\v]+", " ",
            ), r" ?\n ?", "\n",
        ), r"\n{3,}", "\n\n",
    )
)


#: Texts (``text``, with their lines ``ls``) whose lines are kept, and the others with lines joined.
LINE_MODE = """(source_type = 'pdf' OR (len(ls) > 1 AND (len(list_filter(ls, lambda l: length(l) <= 60)) / len(ls) >= 0.55 OR len(list_filter(ls, lambda l: regexp_matches(l, '[=∫√π∞≤≥⇔⇒⊂∈]'))) > 0)))"""
COLLAPSED = _COLLAPSED.replace("@x@", D.sub("text", r"[^\S\n]*\n[^\S\n]*", "\n"))


@catalog.add("collapse_or_preserve", "B10", with_views(f"""
WITH x AS (SELECT doc_id, source_type, text, list_filter(list_transform(string_split(text, chr(10)), lambda l: {S.trim('l')}), lambda l: l <> '') AS ls FROM (
  SELECT doc_id, (['manual','pdf','image','camera'])[doc_id % 4 + 1] AS source_type, text FROM paragraph_docs)),
 m AS (SELECT doc_id, text, CASE WHEN source_type = 'pdf' THEN 'line-preserved' WHEN len(ls) <= 1 THEN 'paragraph'
  WHEN len(list_filter(ls, lambda l: length(l) <= 60)) / len(ls) >= 0.55 OR len(list_filter(ls, lambda l: regexp_matches(l, '[=∫√π∞≤≥⇔⇒⊂∈]'))) > 0 THEN 'line-preserved'
  ELSE 'paragraph' END AS mode FROM x)
SELECT doc_id, mode, CASE WHEN mode = 'line-preserved' THEN text ELSE {_COLLAPSED.replace('@x@', D.sub('text', '[^\\S\\n]*\\n[^\\S\\n]*', chr(10)))} END AS clean_text FROM m""", "paragraph_docs"))
def _(spark, sf):
    from .views import paragraph_docs

    kinds = F.array(*map(F.lit, ["manual", "pdf", "image", "camera"]))
    d = paragraph_docs(spark, sf).select(
        "doc_id", "text", F.element_at(kinds, (F.col("doc_id") % 4 + 1).cast("int")).alias("source_type")
    )
    return RP.collapse_or_preserve(d).select("doc_id", "mode", "clean_text")


@catalog.add("limit_display_rows", "B12", with_views(f"""
WITH x AS (SELECT doc_id, line_no, text, replace(text, '->', '→') AS t FROM marked_lines)
SELECT doc_id, line_no, CASE WHEN {D.matches('t', B.LIMIT_LINE)} THEN concat(rtrim(concat({D.extract('t', B.LIMIT_LINE, 1)}, ' ', {D.extract('t', B.LIMIT_LINE, 3)})), chr(10),
  repeat(' ', CAST(length({D.extract('t', B.LIMIT_LINE, 1)}) - 3 AS INT)), {D.extract('t', B.LIMIT_LINE, 2)}) ELSE text END AS result FROM x""", "marked_docs", "marked_lines"))
def _(spark, sf):
    return marked_lines(spark, sf).select(
        "doc_id", "line_no", F.array_join(B.limit_display_rows(F.col("text")), "\n").alias("result")
    )


# pages of three lines; every third page ends in a hyphenated word, every ninth is one word
HYPHENATED = f"""g AS (SELECT doc_id, CAST(line_no // 3 AS INT) AS page_no, string_agg(text, chr(10) ORDER BY line_no) AS text FROM layout_lines GROUP BY doc_id, line_no // 3),
 pages3 AS (SELECT doc_id, page_no, CASE WHEN (doc_id + page_no) % 9 = 4 THEN concat({D.extract('text', r'[a-z]+', 0)}, '-')
  WHEN (doc_id + page_no) % 3 = 0 THEN concat({D.sub('text', r'[^\p{L}]+$', '')}, '-') ELSE text END AS text FROM g)"""


def hyphenated_pages(spark, sf):
    lines = F.split("text", "\n")
    pages = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(lines) - 1) / 3).cast("int")),
        lambda p: F.array_join(F.slice(lines, p * 3 + 1, F.lit(3)), "\n"),
    )
    k = (F.col("doc_id") + F.col("page_no"))
    t = F.col("text")
    return table(spark, sf, "documents").select("doc_id", F.posexplode(pages).alias("page_no", "text")).select(
        "doc_id", "page_no",
        F.when(k % 9 == 4, F.concat(F.regexp_extract(t, "[a-z]+", 0), F.lit("-")))
        .when(k % 3 == 0, F.concat(F.regexp_replace(t, r"[^\p{L}]+\z", ""), F.lit("-")))
        .otherwise(t).alias("text"),
    )


@catalog.add("repair_page_breaks", "B15", with_views(f"""
WITH RECURSIVE {HYPHENATED},
 f AS (SELECT *, regexp_matches(regexp_replace(text, '\\s+$', ''), '\\p{{L}}{{2,}}-$') AS ends, {D.extract('text', r'^\s*(\p{L}+)', 1)} AS first,
   regexp_matches(regexp_replace(text, '\\s+$', ''), '^\\s*\\p{{L}}+-$') AS only FROM pages3),
 e AS (SELECT *, coalesce(lead(first) OVER (PARTITION BY doc_id ORDER BY page_no), '') AS nxt FROM f),
 j AS (SELECT doc_id, page_no, text, nxt, (ends AND nxt <> '') AS joined, false AS lost FROM e WHERE page_no = 0
   UNION ALL SELECT e.doc_id, e.page_no, e.text, e.nxt, (e.ends AND e.nxt <> '' AND NOT (e.only AND j.joined)), j.joined
   FROM e JOIN j ON e.doc_id = j.doc_id AND e.page_no = j.page_no + 1),
 c AS (SELECT *, CASE WHEN lost THEN regexp_replace(text, '^\\s*\\p{{L}}+[^\\S\\n]*', '') ELSE text END AS cut FROM j),
 o AS (SELECT *, CASE WHEN joined THEN concat(regexp_replace(cut, '-?\\s*$', ''), nxt) ELSE cut END AS out FROM c)
SELECT doc_id, page_no, CASE WHEN joined OR lost THEN {S.trim(D.sub('out', chr(92) + 'n{3,}', chr(10) + chr(10)))} ELSE out END AS text, joined FROM o""".replace("WITH RECURSIVE", "WITH"), "layout_lines").replace("WITH layout_lines", "WITH RECURSIVE layout_lines", 1))
def _(spark, sf):
    return RP.repair_page_breaks(hyphenated_pages(spark, sf))


@catalog.add("merge_wrapped_lines", "B16", recursive(with_views(f"""WITH ml AS (SELECT doc_id, 0 AS grp, CAST(generate_subscripts(x, 1) AS INT) AS i, len(x) AS n, regexp_replace(unnest(x), '\\s+$', '') AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM marked_docs)),
 {merged_sql('ml', 'doc_id', 'mg')}, mt AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY seg) AS merged FROM mgo GROUP BY doc_id), mf AS (SELECT doc_id, string_agg(fix, ',' ORDER BY ofs) AS fixes FROM mgx GROUP BY doc_id)
SELECT doc_id, coalesce(merged, '') AS merged, coalesce(fixes, '') AS fixes FROM marked_docs LEFT JOIN mt USING (doc_id) LEFT JOIN mf USING (doc_id)""", "marked_docs")))
def _(spark, sf):
    d = marked_docs(spark, sf).select("doc_id", RP.merge_wrapped_lines(F.split("text", "\n")).alias("_m"))
    return d.select(
        "doc_id", F.array_join("_m.lines", "\n").alias("merged"), F.array_join("_m.fixes", ",").alias("fixes")
    )


def _flags(name: str, ids: str, **rules: tuple) -> None:
    """Register several predicates of a line as one query."""
    cols = ", ".join(f"{sql('text')} AS {n}" for n, (_, sql) in rules.items())

    @catalog.add(name, ids, with_views(f"SELECT doc_id, line_no, {cols} FROM marked_lines", "marked_docs", "marked_lines"))
    def _(spark, sf):
        return marked_lines(spark, sf).select(
            "doc_id", "line_no", *[fn(F.col("text")).alias(n) for n, (fn, _) in rules.items()]
        )


_flags("math_line_flags", "C3", is_math=(P.is_math_line, S.is_math_line))
_flags("formula_and_list_flags", "P1", formula=(P.is_formula_like, S.is_formula), list_item=(P.is_list_like, S.is_list))
_flags("heading_flags", "P2", heading=(P.is_heading, S.is_heading))
_flags("layout_math_flags", "P4", math=(P.is_layout_math, S.is_layout_math), step=(P.is_equation_step, S.is_equation_step))
_flags("prose_flags", "P5", prose=(P.is_prose, S.is_prose), short=(P.is_short_explanation, S.is_short_explanation),
       lead=(P.starts_explanatory, S.starts_explanatory))
_flags("caption_flags", "P6", caption=(P.is_caption, S.is_caption), heading=(P.is_layout_heading, S.is_layout_heading),
       rule_item=(P.is_rule_item, S.is_rule_item))
_flags("keyword_block_types", "P7", kind=(P.keyword_block_type, S.keyword_type))
_flags("theorem_flags", "P8", theorem=(P.is_theorem_start, lambda x: D.matches(S.trim(x), P.THEOREM_START)),
       note=(P.is_note_start, lambda x: D.matches(S.trim(x), P.NOTE_START)),
       theorem_end=(P.is_theorem_boundary, S.is_theorem_boundary), example_end=(P.is_example_boundary, S.is_example_boundary))
_flags("continuation_flags", "P9", theorem_math=(P.is_theorem_math, S.is_theorem_math), continues=(P.is_equation_continuation, S.is_continuation))


@catalog.add("mergeable_neighbours", "P3", with_views(f"""
WITH x AS (SELECT doc_id, line_no, text, lead(text) OVER (PARTITION BY doc_id ORDER BY line_no) AS following FROM marked_lines)
SELECT doc_id, line_no, {S.is_terminal('text')} AS terminal, coalesce({S.plain_line('text')} AND {S.plain_line('following')}, false) AS merge FROM x""", "marked_docs", "marked_lines"))
def _(spark, sf):
    w = Window.partitionBy("doc_id").orderBy("line_no")
    x = marked_lines(spark, sf).withColumn("following", F.lead("text").over(w))
    return x.select(
        "doc_id", "line_no", P.is_sentence_terminal(F.col("text")).alias("terminal"),
        P.can_merge(F.col("text"), F.col("following")).alias("merge"),
    )


@catalog.add("block_type_classes", "P10", with_views(f"""
SELECT doc_id, line_no, kind, kind = 'equation_group' AS math, kind IN ({', '.join(D.q(t) for t in P.TEXT_BLOCK_TYPES)}) AS is_text FROM (
 SELECT doc_id, line_no, CASE WHEN {S.is_layout_math('text')} THEN 'equation_group' ELSE coalesce({S.keyword_type('text')}, 'table_placeholder') END AS kind FROM marked_lines)""", "marked_docs", "marked_lines"))
def _(spark, sf):
    t = F.col("text")
    kind = F.when(P.is_layout_math(t), "equation_group").otherwise(F.coalesce(P.keyword_block_type(t), F.lit("table_placeholder")))
    x = marked_lines(spark, sf).select("doc_id", "line_no", kind.alias("kind"))
    return x.select("*", P.is_math_block_type(F.col("kind")).alias("math"), P.is_text_block_type(F.col("kind")).alias("is_text"))


@catalog.add("conversion_modes", "P11", with_views(f"""
SELECT doc_id, CASE WHEN source_type IN ('image', 'camera') THEN 'ocr' WHEN {D.matches('text', P.NEMETH_HINT)} THEN 'nemeth' ELSE 'text' END AS mode FROM marked_docs""", "marked_docs"))
def _(spark, sf):
    return marked_docs(spark, sf).select("doc_id", P.conversion_mode(F.col("text"), F.col("source_type")).alias("mode"))


@catalog.add("accepted_files", "P14", f"""
SELECT page_id, name, ext IN ('pdf', 'txt', 'jpg', 'jpeg', 'png') AS accepted,
 CASE WHEN ext IN ('jpg', 'jpeg', 'png') THEN 'image' WHEN ext = 'pdf' THEN 'pdf' WHEN ext = 'txt' THEN 'manual' END AS kind
FROM (SELECT page_id, name, lower(list_extract(string_split(name, '.'), -1)) AS ext FROM (
 SELECT page_id, concat(url, '.', (['pdf', 'TXT', 'jpg', 'Jpeg', 'png', 'docx', 'tar.gz'])[page_id % 7 + 1]) AS name FROM pages))""")
def _(spark, sf):
    ext = F.array(*map(F.lit, ["pdf", "TXT", "jpg", "Jpeg", "png", "docx", "tar.gz"]))
    p = table(spark, sf, "pages").select(
        "page_id", F.concat("url", F.lit("."), F.element_at(ext, (F.col("page_id") % 7 + 1).cast("int"))).alias("name")
    )
    return p.select("*", P.accepted_file(F.col("name")).alias("accepted"), P.source_type(F.col("name")).alias("kind"))
