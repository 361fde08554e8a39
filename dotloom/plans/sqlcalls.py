"""Named queries that call the rules from SQL."""

from __future__ import annotations

from ..functions.sqlfunctions import register_sql_functions
from . import duck as D, sqlrules as S
from .catalog import catalog
from .quality import DETECT, IMPROVED, corrupted_sql, score_sql, scores_sql
from .transcoding import brf_sql, lenient_sql, strict_sql
from .views import marked_docs, marked_lines, with_views


@catalog.add("line_rules_in_sql", "B1 B2 B3 B11 B14 P1 P2 P4 P5 P6 P7 C2 C3", with_views(f"""
SELECT doc_id, line_no, {S.fix_encoding('text')} AS fixed, {S.normalize_math_input('text')} AS math_input, {S.normalize_pdf_math('text')} AS pdf_math, {S.normalize_structured_math('text')} AS structured,
 {S.normalize_line('text')} AS clean, {S.is_heading('text')} AS heading, {S.is_layout_heading('text')} AS layout_heading, {S.is_caption('text')} AS caption, {S.keyword_type('text')} AS keyword,
 {S.is_math_line('text')} AS math_line, {lenient_sql('text')} AS cells FROM marked_lines WHERE {S.is_formula(S.trim('text'))} OR {S.is_list('text')} OR {S.is_prose('text')}""", "marked_docs", "marked_lines"))
def _(spark, sf):
    register_sql_functions(spark, "rule_")
    return spark.sql("""
SELECT doc_id, line_no, rule_fix_encoding(text) AS fixed, rule_normalize_math_input(text) AS math_input, rule_normalize_pdf_math(text) AS pdf_math, rule_normalize_structured_math(text) AS structured,
 rule_normalize_line(text) AS clean, rule_is_heading(text) AS heading, rule_is_layout_heading(text) AS layout_heading, rule_is_caption(text) AS caption, rule_keyword_block_type(text) AS keyword,
 rule_is_math_line(text) AS math_line, rule_to_braille_lenient(text) AS cells FROM {lines} WHERE rule_is_formula_like(trim(text)) OR rule_is_list_like(text) OR rule_is_prose(text)""", lines=marked_lines(spark, sf))


@catalog.add("document_rules_in_sql", "B13 C1 C10 F2 F3 F6 F7 G2", with_views(f"""
WITH {scores_sql('marked_docs', 'doc_id')}, l AS (SELECT doc_id, {DETECT} FROM sc), x AS (SELECT doc_id, source_type, text, {IMPROVED} AS t FROM marked_docs)
SELECT source_type, language, {corrupted_sql(S.trim('text'))} AS corrupted, count(*) AS documents, CAST(sum({score_sql(S.trim('text'))}) AS BIGINT) AS score,
 CAST(sum(length({S.trim('t')})) AS BIGINT) AS characters, CAST(sum(length({brf_sql(strict_sql('text'))})) AS BIGINT) AS cells FROM x JOIN l USING (doc_id) GROUP BY ALL""", "marked_docs"))
def _(spark, sf):
    register_sql_functions(spark, "rule_")
    return spark.sql("""
SELECT source_type, rule_detect_language(text).language AS language, rule_is_severely_corrupted(text) AS corrupted, count(*) AS documents, CAST(sum(rule_math_quality_score(text)) AS BIGINT) AS score,
 CAST(sum(length(rule_improve_text(text))) AS BIGINT) AS characters, CAST(sum(length(rule_cells_to_brf(rule_to_braille_strict(text)))) AS BIGINT) AS cells
FROM {docs} GROUP BY 1, 2, 3""", docs=marked_docs(spark, sf))
