"""Named queries: transcoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import cells as C, mathcode as M, transcode as X
from ..operators import transcoding as T
from . import duck as D, sqlrules as S
from .catalog import catalog
from .sqlmath import linear_sql
from .views import equations, marked_docs, marked_lines, table, with_views

_STRICT_TOKENS = (
    f"[{X.WORD}]+|\\p{{Nd}}+|[ \\n\\r\\t\\x0B\\f]|"
    f"[^\\s\\x0B\\p{{L}}\\p{{N}}_\\x1c-\\x1f\\x{{85}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]"
)


def strict_sql(x: str) -> str:
    """Strict profile, token by token (the definition, not the Spark route)."""
    return f"(SELECT {_strict_body('s.t')} FROM (SELECT {D.extract_all(x, _STRICT_TOKENS)} AS t) s)"


def _strict_body(t: str) -> str:
    letters = {**C.letter_cells("strict"), **C.DIGITS}
    caps = {**{k.upper(): v for k, v in {**C.LATIN, **C.TURKISH}.items() if k not in "iı"}, "I": "⠔", "İ": "⠊"}
    before, before2 = f"{t}[i - 1]", f"{t}[i - 2]"
    return f"""coalesce(array_to_string(list_transform({t}, lambda k, i:
 CASE WHEN regexp_matches(k, '^[{X.WORD}]*[{X.UPPER}][{X.WORD}]*$') AND NOT regexp_matches(k, '\\p{{Ll}}') AND length(k) > 1
   THEN concat('{C.CAPITAL * 2}', lower({D.map_characters('k', caps)}))
 WHEN regexp_matches(k, '^[{X.WORD}]') THEN CASE WHEN i > 1 AND {before} = '^' THEN {D.map_characters('k', letters)}
   ELSE {D.map_characters(D.sub('k', f'[{X.UPPER}]', C.CAPITAL + '$0'), letters)} END
 WHEN regexp_matches(k, '^\\p{{Nd}}') THEN concat(CASE WHEN i > 1 AND {before} = '^' THEN ''
   WHEN i > 1 AND regexp_matches({before}, '^\\p{{Nd}}') AND NOT (i > 2 AND {before2} = '^') THEN '' ELSE '{C.NUMBER}' END, {D.map_characters('k', letters)})
 ELSE {D.map_characters('k', C.STRICT_SYMBOLS)} END), ''), '')"""


_LENIENT_WS = "\\s\\x0B\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{feff}"


def lenient_sql(x: str) -> str:
    """Lenient profile, word by word and unit by unit."""
    table = {**C.letter_cells("lenient"), **C.DIGITS, **C.LENIENT_SYMBOLS}
    letters = "regexp_replace(w, '[^\\p{L}]', '', 'g')"
    caps = f"(length({letters}) > 1 AND NOT regexp_matches({letters}, '[\\p{{Ll}}\\p{{Lt}}]') AND regexp_matches({letters}, '\\p{{Lu}}'))"
    units = "regexp_extract_all(w, '[\\^_][0-9]*|[0-9]+|[^0-9\\^_]')"
    body = f"""concat(CASE WHEN {caps} THEN '{C.CAPITAL * 2}' ELSE '' END, array_to_string(list_transform({units}, lambda u, i:
 CASE WHEN regexp_matches(u, '^[0-9]') THEN concat('{C.NUMBER}', u)
 WHEN regexp_matches(u, '^\\p{{Lu}}') AND NOT {caps} AND NOT (i > 1 AND regexp_matches({units}[i - 1], '^[\\^_]')) THEN concat('{C.CAPITAL}', u)
 ELSE u END), ''))"""
    mapped = D.map_characters(f"array_to_string(list_transform(s.t, lambda w: {body}), '')", table)
    return f"(SELECT coalesce({mapped}, '') FROM (SELECT {D.extract_all(x, f'[{_LENIENT_WS}]+|[^{_LENIENT_WS}]+')} AS t) s)"


_CELLS = "".join(chr(0x2800 + i) for i in range(64))


def brf_sql(x: str) -> str:
    return f"translate({x}, {D.q(_CELLS)}, {D.q(C.NABCC)})"


# lines of the embosser file of a table b(doc_id, braille), numbered
WRAPPED = f"""l AS (SELECT doc_id, CAST(generate_subscripts(x, 1) AS INT) AS ln, unnest(x) AS line
   FROM (SELECT doc_id, string_split({brf_sql('braille')}, chr(10)) AS x FROM b)),
 w AS (SELECT doc_id, ln, CAST(generate_subscripts(x, 1) AS INT) AS wn, unnest(x) AS line
   FROM (SELECT doc_id, ln, CASE WHEN line = '' THEN [''] ELSE regexp_extract_all(line, '(?s).{{1,40}}') END AS x FROM l)),
 n AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id ORDER BY ln, wn) - 1 AS rn FROM w),
 p AS (SELECT doc_id, CAST(floor(rn / 25) AS INT) + 1 AS page_no, string_agg(line, chr(10) ORDER BY rn) AS page, count(*) AS n_lines
   FROM n GROUP BY doc_id, CAST(floor(rn / 25) AS INT))"""


def _strict_docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(
        "doc_id", "lang", X.to_braille_strict(F.col("text")).alias("braille")
    )


def brf_volume_by_language(df: DataFrame) -> DataFrame:
    """How many embosser lines and pages does each language need?"""
    return df.select("lang", T.brf_size(F.col("braille")).alias("_s")).groupBy("lang").agg(
        F.count("*").alias("documents"), F.sum("_s.pages").alias("brf_pages"), F.sum("_s.lines").alias("brf_lines")
    )


@catalog.add("brf_volume_by_language", "C1 C10 C11", f"""
WITH d AS (SELECT doc_id, lang, {strict_sql('text')} AS braille FROM documents), b AS (SELECT doc_id, braille FROM d), {WRAPPED}
SELECT lang, count(DISTINCT doc_id) AS documents, count(*) AS brf_pages, CAST(sum(n_lines) AS BIGINT) AS brf_lines
FROM p JOIN d USING (doc_id) GROUP BY lang""")
def _(spark, sf):
    return brf_volume_by_language(_strict_docs(spark, sf))


@catalog.add("braille_strict", "C1", f"SELECT doc_id, {strict_sql('text')} AS braille FROM documents")
def _(spark, sf):
    return _strict_docs(spark, sf).select("doc_id", "braille")


@catalog.add("braille_lenient", "C2", f"SELECT doc_id, {lenient_sql('text')} AS braille FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.to_braille_lenient(F.col("text")).alias("braille"))


@catalog.add("brf_characters", "C10", f"SELECT doc_id, {brf_sql(strict_sql('text'))} AS brf FROM documents")
def _(spark, sf):
    return _strict_docs(spark, sf).select("doc_id", X.cells_to_brf(F.col("braille")).alias("brf"))


@catalog.add("brf_page_rows", "C11", f"""
WITH b AS (SELECT doc_id, {strict_sql('text')} AS braille FROM documents), {WRAPPED}
SELECT doc_id, page_no, page FROM p""")
def _(spark, sf):
    return T.wrap_and_paginate(_strict_docs(spark, sf).select("doc_id", "braille"))


# stored text of even documents has two pages: the whole document and its first line
@catalog.add("brf_combined", "C12", f"""
WITH d AS (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN '' ELSE {strict_sql('text')} END AS one FROM documents),
 x AS (SELECT doc_id, 1 AS part, {D.strip('one')} AS braille FROM d WHERE {D.strip('one')} <> ''
   UNION ALL SELECT doc_id, 2 AS part, {D.strip("split_part(one, chr(10), 1)")} FROM d WHERE doc_id % 2 = 0 AND {D.strip("split_part(one, chr(10), 1)")} <> ''),
 b AS (SELECT doc_id * 2 + part - 1 AS doc_id, braille FROM x), {WRAPPED}
SELECT doc_id // 2 AS doc_id, string_agg(page, chr(10) || chr(12) || chr(10) ORDER BY p.doc_id, page_no) AS brf FROM p GROUP BY doc_id // 2""")
def _(spark, sf):
    d = table(spark, sf, "documents")
    one = F.when(F.col("doc_id") % 9 == 0, "").otherwise(X.to_braille_strict(F.col("text")))
    d = d.select("doc_id", one.alias("one"))
    stored = F.when(
        F.col("doc_id") % 2 == 0,
        F.concat("one", F.lit("\n" + T.PAGE_MARKER + "\n"), F.split_part("one", F.lit("\n"), F.lit(1))),
    ).otherwise(F.col("one"))
    return T.combine_brf(d.select("doc_id", stored.alias("braille")), "doc_id")


@catalog.add("unmapped_characters", "C9", f"""
WITH c AS (SELECT doc_id, unnest(string_split(text, '')) AS ch FROM documents)
SELECT ch, count(*) AS occurrences, count(DISTINCT doc_id) AS documents FROM c
WHERE ch NOT IN ({', '.join(D.q(k) for k in sorted({*C.all_cells('strict'), ' ', chr(10)}))}) GROUP BY ch""")
def _(spark, sf):
    return T.unmapped_characters(table(spark, sf, "documents"))


def token_type_sql(t: str, profile: str = "strict") -> str:
    names = ", ".join(D.q(n) for n in M.function_names(profile))
    return (
        f"CASE WHEN regexp_matches({t}, '^[0-9]') THEN 'NUMBER' WHEN lower({t}) IN ({names}) THEN 'FUNCTION' "
        f"WHEN regexp_matches({t}, '^[\\p{{L}}∅]') THEN 'VARIABLE' ELSE 'OPERATOR' END"
    )


def token_value_sql(t: str, profile: str = "strict") -> str:
    names = ", ".join(D.q(n) for n in M.function_names(profile))
    return (
        f"CASE WHEN lower({t}) IN ({names}) THEN lower({t}) WHEN {t} IN ('.', '·') THEN '*' WHEN {t} = ':' THEN '/' "
        f"WHEN regexp_matches({t}, '^[''′’‘]') THEN repeat(chr(39), CAST(length({t}) + 1 AS INT)) ELSE {t} END"
    )


def raw_tokens_sql(x: str, profile: str = "strict") -> str:
    return D.extract_all(f"replace({x}, '−', '-')", M.TOKEN_PATTERN[profile])


@catalog.add("math_tokens", "C7", with_views(f"""
SELECT p_partkey, pos, {token_type_sql('t')} AS type, {token_value_sql('t')} AS value FROM (
 SELECT p_partkey, CAST(generate_subscripts(x, 1) - 1 AS INT) AS pos, unnest(x) AS t FROM (SELECT p_partkey, {raw_tokens_sql('equation')} AS x FROM equations))""", "equations"))
def _(spark, sf):
    return T.math_tokens(equations(spark, sf), "equation")


@catalog.add("math_token_usage", "C7", f"""
SELECT type, value, count(*) AS uses, count(DISTINCT doc_id) AS documents FROM (
 SELECT doc_id, {token_type_sql('t')} AS type, {token_value_sql('t')} AS value FROM (
  SELECT doc_id, unnest({raw_tokens_sql('text')}) AS t FROM documents)) GROUP BY type, value""")
def _(spark, sf):
    toks = T.math_tokens(table(spark, sf, "documents").select("doc_id", "text"), "text")
    per_doc = toks.groupBy("type", "value", "doc_id").agg(F.count("*").alias("n"))
    return per_doc.groupBy("type", "value").agg(F.sum("n").alias("uses"), F.count("*").alias("documents"))


@catalog.add("explanation_segments", "C13", f"""
SELECT line_id, concat('seg_', CAST(i AS VARCHAR)) AS id, tok AS text,
 CASE WHEN regexp_matches(tok, '^\\s') THEN tok ELSE {strict_sql('tok')} END AS braille,
 CASE WHEN regexp_matches(tok, '^\\s') THEN 'space' WHEN length(tok) = 1 AND NOT regexp_matches(tok, '[\\p{{L}}\\p{{N}}]') THEN 'punctuation' ELSE 'word' END AS kind,
 NOT regexp_matches(tok, '^\\s') AS is_interactive
FROM (SELECT item_id AS line_id, CAST(generate_subscripts(x, 1) AS INT) AS i, unnest(x) AS tok FROM (
 SELECT item_id, {D.extract_all('text', T.SEGMENT_PATTERN)} AS x FROM benchmark))""")
def _(spark, sf):
    b = table(spark, sf, "benchmark").select(F.col("item_id").alias("line_id"), "text")
    return T.segment_tokens(b, "text")


def _linear(x: str, profile: str) -> str:
    return linear_sql(x, profile, token_type_sql, token_value_sql)


@catalog.add("linear_math_cells", "C8", with_views(f"SELECT doc_id, line_no, {_linear('text', 'strict')} AS cells FROM marked_lines", "marked_docs", "marked_lines"))
def _(spark, sf):
    return marked_lines(spark, sf).select("doc_id", "line_no", M.linear_math_to_cells(F.col("text")).alias("cells"))


@catalog.add("equation_cells", "C8", with_views(f"SELECT p_partkey, equation, {_linear('equation', 'strict')} AS cells FROM equations", "equations"))
def _(spark, sf):
    return equations(spark, sf).select("p_partkey", "equation", M.linear_math_to_cells(F.col("equation")).alias("cells"))


def line_sql(line: str) -> str:
    """Cells of one line: the mathematics code where the line asks for it and is linear, else the text code."""
    return f"CASE WHEN {S.is_math_line(line)} THEN coalesce({_linear(line, 'lenient')}, {lenient_sql(line)}) ELSE {lenient_sql(line)} END"


@catalog.add("converted_texts", "C4", with_views(f"""
WITH l AS (SELECT doc_id, CAST(generate_subscripts(x, 1) AS INT) AS i, unnest(x) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM marked_docs)),
 c AS (SELECT doc_id, i, {line_sql('line')} AS braille FROM l)
SELECT doc_id, string_agg(braille, chr(10) ORDER BY i) AS braille FROM c GROUP BY doc_id""", "marked_docs"))
def _(spark, sf):
    return T.convert_lines(marked_docs(spark, sf).select("doc_id", "text")).select("doc_id", "braille")


_EXPRESSIONS = f"""l AS (SELECT doc_id, CAST(generate_subscripts(x, 1) - 1 AS INT) AS line_no, unnest(x) AS line FROM (SELECT doc_id, string_split({S.fix_encoding('text')}, chr(10)) AS x FROM marked_docs)),
 m AS (SELECT doc_id, line_no, {D.strip('line')} AS expression FROM l WHERE {D.strip('line')} <> ''),
 n AS (SELECT doc_id, line_no, expression, {S.normalize_math_input('expression')} AS e FROM m),
 x AS (SELECT doc_id, line_no, expression, {_linear('e', 'strict')} AS braille FROM n)"""


@catalog.add("expression_rows", "C6", with_views(f"WITH {_EXPRESSIONS} SELECT doc_id, line_no, expression, braille, 'Direct translation' AS explanation FROM x WHERE braille IS NOT NULL", "marked_docs"))
def _(spark, sf):
    return T.explode_expressions(marked_docs(spark, sf).select("doc_id", "text"))


@catalog.add("auto_conversions", "C5", with_views(f"""
WITH {_EXPRESSIONS}, g AS (SELECT doc_id, string_agg(braille, chr(10) ORDER BY line_no) AS math FROM x WHERE braille IS NOT NULL GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN math IS NOT NULL THEN 'math' ELSE 'text' END AS mode, coalesce(math, {strict_sql(S.fix_encoding('d.text'))}) AS braille FROM marked_docs d LEFT JOIN g USING (doc_id)""", "marked_docs"))
def _(spark, sf):
    return T.auto_convert(marked_docs(spark, sf).select("doc_id", "text")).select("doc_id", "mode", "braille")
