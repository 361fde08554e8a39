"""Named queries: quality scores, language, keywords and tags."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions import language as G, quality as Q
from ..operators import language as LO
from . import duck as D, sqlrules as S
from .catalog import catalog
from .texts import _TR_LOWER
from .views import dealt, layout_lines, library_docs, marked_docs, paragraph_docs, table, with_views


def _any(x: str, ps: list[str]) -> str:
    return S.any_of(x, *ps)


def _tokens(x: str) -> str:
    return f"len(regexp_extract_all({x}, '\\S+'))"


def _ratio(x: str) -> str:
    words = f"regexp_extract_all({x}, '\\S+')"
    return f"(CASE WHEN len({words}) > 0 THEN len(list_filter({words}, lambda w: length(w) = 1)) / len({words}) ELSE 0 END)"


def score_sql(x: str) -> str:
    one = f"NOT contains({x}, chr(10))"
    tests = [
        (D.matches(x, Q.LIMIT_SHAPE), 10), (D.matches(x, Q.MATH_CALL), 6), (D.matches(x, Q.RELATION), 4),
        (D.matches(x, Q.TITLED_RULE), 4), (f"{D.count(x, '[(]')} = {D.count(x, '[)]')}", 2),
        (f"{D.count(x, Q.LIMIT_WORD)} > 1 AND {one}", -8), (f"{D.count(x, Q.RULE_NAME)} > 1 AND {one}", -14),
        (f"{D.count(x, Q.NUMBERED_RULE)} > 1 AND {one}", -10), (D.matches(x, Q.LETTER_RUN), -10),
        (D.matches(x, Q.X_RUN), -10), (_any(x, Q.BROKEN_ARROW), -12), (D.matches(x, Q.COLLAPSED_HEADS), -8),
        (D.matches(x, Q.LIMIT_RUN), -12), (f"{_ratio(x)} >= 0.35 AND {_tokens(x)} >= 8", -8),
    ]
    total = " + ".join(f"(CASE WHEN {c} THEN {w} ELSE 0 END)" for c, w in tests)
    return f"(CASE WHEN {x} = '' THEN -100 ELSE {total} END)"


def corrupted_sql(x: str) -> str:
    rules, limits = D.count(x, Q.NUMBERED_RULE), D.count(x, Q.LIMIT_WORD)
    return f"""({x} <> '' AND ({_any(x, Q.GARBAGE)} OR (NOT contains({x}, chr(10)) AND {D.count(x, Q.RULE_NAME)} >= 3 AND {limits} >= 3)
 OR ({_ratio(x)} >= 0.48 AND {_tokens(x)} >= 18 AND {D.matches(x, Q.LONG_LETTER_RUN)}) OR ({score_sql(x)} <= -24 AND ({rules} >= 2 OR {limits} >= 3))))"""


_T = S.trim("text")
_MARKED = f"x AS (SELECT doc_id, source_type, {_T} AS t FROM marked_docs)"


@catalog.add("math_heavy_pages", "F1", with_views(f"""
WITH {_MARKED}, i AS (SELECT doc_id, string_agg(text, ' ' ORDER BY line_no) AS items FROM layout_lines GROUP BY doc_id)
SELECT doc_id, {_any('t', [Q.MATH_SYMBOL, Q.MATH_NAME])} AS text_only,
 ({_any('t', [Q.MATH_SYMBOL, Q.MATH_NAME])} OR {_any('items', [Q.MATH_SYMBOL, Q.MATH_NAME, Q.MATH_CALL])}) AS with_items,
 {_any('t', Q.IMAGE_MATH)} AS image FROM x JOIN i USING (doc_id)""", "marked_docs", "layout_lines"))
def _(spark, sf):
    # the items of a page are its source lines
    d = marked_docs(spark, sf).join(table(spark, sf, "documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit(" ")).alias("items")), "doc_id")
    t, i = F.col("text"), F.col("items")
    return d.select(
        "doc_id", Q.is_math_heavy(t).alias("text_only"), Q.is_math_heavy(t, i).alias("with_items"),
        Q.is_math_heavy_image(t).alias("image"),
    )


@catalog.add("math_quality_scores", "F2", with_views(f"WITH {_MARKED} SELECT doc_id, {score_sql('t')} AS score FROM x", "marked_docs"))
def _(spark, sf):
    return marked_docs(spark, sf).select("doc_id", Q.math_quality_score(F.col("text")).alias("score"))


_SPACED = "(CASE WHEN doc_id % 2 = 1 THEN trim(regexp_replace(text, '([a-zA-Z])', '\\1 ', 'g')) ELSE concat('lim x→c f(x) = L ', text) END)"


def candidates(spark, sf):
    """Two readings of every page: the text, and one with spaced or prefixed letters."""
    d = dealt(table(spark, sf, "documents").select("doc_id", "text"))
    spaced = F.trim(F.regexp_replace(F.col("text"), "([a-zA-Z])", "$1 "))
    b = F.when(F.col("doc_id") % 2 == 1, spaced).otherwise(F.concat(F.lit("lim x→c f(x) = L "), F.col("text")))
    return d.select("doc_id", F.col("text").alias("text_a"), b.alias("text_b"))


@catalog.add("corrupted_pages", "F3", f"WITH x AS (SELECT doc_id, {S.trim(_SPACED)} AS t FROM documents) SELECT doc_id, {corrupted_sql('t')} AS corrupted FROM x")
def _(spark, sf):
    return candidates(spark, sf).select("doc_id", Q.is_severely_corrupted(F.col("text_b")).alias("corrupted"))


@catalog.add("best_candidates", "F4", f"""
WITH x AS (SELECT a.doc_id AS ka, b.doc_id AS kb, coalesce({S.trim('a.text')}, '') AS a, coalesce({S.trim('b.text_b')}, '') AS b
 FROM (SELECT doc_id, text FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)) a FULL OUTER JOIN (SELECT doc_id, {_SPACED} AS text_b FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)) b ON a.doc_id = b.doc_id),
 s AS (SELECT coalesce(ka, kb) AS doc_id, a, b, {corrupted_sql('a')} AS bad_a, {corrupted_sql('b')} AS bad_b, {score_sql('a')} AS sa, {score_sql('b')} AS sb FROM x)
SELECT doc_id, CASE WHEN b = '' THEN a WHEN a = '' THEN b WHEN bad_b AND NOT bad_a THEN a WHEN bad_a AND NOT bad_b THEN b WHEN sb >= sa + 4 THEN b ELSE a END AS text FROM s""")
def _(spark, sf):
    c = candidates(spark, sf)
    # either extraction may miss a page
    labels = table(spark, sf, "labels")
    a = c.select("doc_id", "text_a").join(labels.filter("toxic = 1"), "doc_id", "left_anti")
    b = c.select("doc_id", "text_b").join(labels.filter("quality = 0"), "doc_id", "left_anti")
    return a.join(b, "doc_id", "full_outer").select("doc_id", Q.best_candidate(F.col("text_a"), F.col("text_b")).alias("text"))


@catalog.add("second_pass_pages", "F5", with_views(f"""
WITH {_MARKED}, i AS (SELECT doc_id, string_agg(text, ' ' ORDER BY line_no) AS items, count(DISTINCT round(y0)) AS n FROM layout_lines GROUP BY doc_id),
 h AS (SELECT *, ({_any('t', [Q.MATH_SYMBOL, Q.MATH_NAME])} OR {_any('items', [Q.MATH_SYMBOL, Q.MATH_NAME, Q.MATH_CALL])}) AS heavy FROM x JOIN i USING (doc_id))
SELECT doc_id, (t = '' OR {_any('t', Q.SUSPICIOUS)} OR (heavy AND (({_ratio('t')} >= 0.35 AND {_tokens('t')} >= 8) OR n >= 3))) AS page,
 (t = '' OR {_any('t', Q.IMAGE_MATH)} OR {corrupted_sql('t')} OR {score_sql('t')} <= -10) AS image FROM h""", "marked_docs", "layout_lines"))
def _(spark, sf):
    items = layout_lines(spark, sf).groupBy("doc_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda s: s["text"]), " ").alias("items"),
        F.count_distinct(F.round("y0")).alias("n"),
    )
    d = marked_docs(spark, sf).join(items, "doc_id")
    t = F.col("text")
    return d.select("doc_id", Q.needs_second_pass(t, F.col("items"), F.col("n")).alias("page"), Q.image_needs_second_pass(t).alias("image"))


IMPROVED = S.improve_spacing("text")
_SUGGEST = [
    "regexp_matches(text, '\\t| {2,}')", "regexp_matches(text, '\\n{3,}')", "regexp_matches(text, '[•●▪◦]')", "long_lines > 0", "runs > 0",
    "len(regexp_extract_all(t, '[.!?]')) <= 1 AND length(t) > 180", "source_type IN ('pdf', 'image', 'camera')",
]


@catalog.add("readability", "F6", with_views(f"""
WITH x AS (SELECT doc_id, source_type, text, {IMPROVED} AS t FROM marked_docs),
 c AS (SELECT *, len(list_filter(string_split(t, chr(10)), lambda l: length(l) > 84)) AS long_lines, len(regexp_extract_all(t, '\\d{{4,}}')) AS runs FROM x)
SELECT doc_id, CAST(floor(greatest(35.0, 100 - long_lines * 8 - runs * 6 - greatest(0, length(t) - 500) / 18) + 0.5) AS BIGINT) AS score,
 concat_ws('|', {', '.join(f"CASE WHEN {c} THEN {D.q(s)} END" for c, s in zip(_SUGGEST, Q.SUGGESTIONS))}) AS suggestions,
 {S.trim('t')} <> {S.trim('text')} AS changed FROM c""", "marked_docs"))
def _(spark, sf):
    r = marked_docs(spark, sf).select("doc_id", Q.readability(F.col("text"), F.col("source_type")).alias("_r"))
    return r.select("doc_id", "_r.score", F.array_join("_r.suggestions", "|").alias("suggestions"), "_r.changed")


@catalog.add("extraction_routes", "F7", with_views("""
SELECT source_type, CASE WHEN len(regexp_extract_all(original_text, '[\\p{L}\\p{N}]')) >= 80 THEN 'text_layer' ELSE 'second_stage' END AS route, count(*) AS documents FROM library_docs GROUP BY ALL""", "library_docs"))
def _(spark, sf):
    route = F.when(Q.has_enough_text(F.col("original_text")), "text_layer").otherwise("second_stage")
    return library_docs(spark, sf).groupBy("source_type", route.alias("route")).agg(F.count("*").alias("documents"))


def _words(ws: list[str]) -> str:
    return ", ".join(D.q(w) for w in ws)


def scores_sql(src: str, key: str) -> str:
    """Language scores by exploding the words of ``src(key, text)``."""
    return f"""w AS (SELECT {key}, unnest(regexp_extract_all({_TR_LOWER.format('text')}, '\\p{{L}}+')) AS t FROM {src}),
 wc AS (SELECT {key}, count(*) AS tokens, count(*) FILTER (WHERE t IN ({_words(G.TURKISH_STOP_WORDS)})) AS trw, count(*) FILTER (WHERE t IN ({_words(G.ENGLISH_STOP_WORDS)})) AS enw FROM w GROUP BY {key}),
 sc AS (SELECT {', '.join('s.' + k.strip() for k in key.split(','))}, coalesce(tokens, 0) AS tokens, {D.count('text', G.TURKISH_LETTERS)} * 3 + coalesce(trw, 0) * 2 + {D.count('text', G.TURKISH_HINTS)} * 2 AS tr,
   coalesce(enw, 0) * 2 + {D.count('text', G.ENGLISH_HINTS)} * 2 AS en FROM {src} s LEFT JOIN wc USING ({key}))"""


DETECT = """CASE WHEN tokens = 0 OR (tr = 0 AND en = 0) THEN 'unknown' WHEN tr > 0 AND en > 0 AND abs(tr - en) <= greatest(2.0, greatest(tr, en) * 0.35) THEN 'mixed' WHEN tr > en THEN 'tr' ELSE 'en' END AS language,
 CASE WHEN tokens = 0 THEN 0.0 WHEN tr = 0 AND en = 0 THEN 0.2 WHEN tr > 0 AND en > 0 AND abs(tr - en) <= greatest(2.0, greatest(tr, en) * 0.35) THEN least(0.92, 0.52 + greatest(tr, en) / greatest(tokens * 2, 1))
 ELSE least(0.99, 0.58 + abs(tr - en) / greatest(tokens + 2, 4)) END AS confidence"""
_R6 = "floor(confidence * 1e6 + 0.5) / 1e6 AS confidence"


def _r6(name: str = "confidence"):
    return (F.floor(F.col(name) * 1e6 + 0.5) / 1e6).alias(name)


@catalog.add("language_scores", "G1", with_views(f"WITH {scores_sql('marked_docs', 'doc_id')} SELECT doc_id, tokens, tr, en FROM sc", "marked_docs"))
def _(spark, sf):
    return marked_docs(spark, sf).select("doc_id", G.language_scores(F.col("text")).alias("_s")).select("doc_id", "_s.*")


@catalog.add("detected_languages", "G2", with_views(f"WITH {scores_sql('marked_docs', 'doc_id')}, d AS (SELECT doc_id, {DETECT} FROM sc) SELECT doc_id, language, {_R6} FROM d", "marked_docs"))
def _(spark, sf):
    return LO.with_language(marked_docs(spark, sf)).select("doc_id", "language", _r6())


@catalog.add("languages_by_blocks", "G3", with_views(f"""
WITH b AS (SELECT doc_id, CAST(generate_subscripts(x, 1) - 1 AS INT) AS block_no, unnest(x) AS text FROM (SELECT doc_id, string_split(text, chr(10) || chr(10)) AS x FROM paragraph_docs)),
 {scores_sql('b', 'doc_id, block_no')}, d AS (SELECT doc_id, block_no, {DETECT} FROM sc),
 r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY (language = 'unknown'), confidence DESC, block_no) AS rn, count(*) OVER (PARTITION BY doc_id) AS n FROM d),
 k AS (SELECT doc_id, count(DISTINCT language) AS kinds FROM d WHERE language <> 'unknown' GROUP BY doc_id),
 f AS (SELECT r.doc_id, CASE WHEN coalesce(kinds, 0) > 1 THEN 'mixed' ELSE language END AS language, CASE WHEN coalesce(kinds, 0) > 1 THEN 0.9 WHEN language = 'unknown' THEN 0.0 ELSE confidence END AS confidence
   FROM r LEFT JOIN k USING (doc_id) WHERE rn = 1)
SELECT doc_id, language, {_R6} FROM f""", "paragraph_docs"))
def _(spark, sf):
    blocks = paragraph_docs(spark, sf).select("doc_id", F.posexplode(F.split("text", "\n\n")).alias("block_no", "text"))
    return LO.detect_language_by_blocks(LO.with_language(blocks), "doc_id").select("doc_id", "language", _r6())


@catalog.add("language_confusion", "G4", f"""
WITH {scores_sql('documents', 'doc_id')}, d AS (SELECT doc_id, {DETECT} FROM sc)
SELECT lang, count(*) FILTER (WHERE language = 'en') AS detected_en, count(*) FILTER (WHERE language = 'mixed') AS detected_mixed,
 count(*) FILTER (WHERE language = 'tr') AS detected_tr, count(*) FILTER (WHERE language = 'unknown') AS detected_unknown FROM d JOIN documents USING (doc_id) GROUP BY lang""")
def _(spark, sf):
    return LO.language_confusion(table(spark, sf, "documents"))


_KEYWORDS = f"""kt AS (SELECT doc_id, CAST(generate_subscripts(x, 1) AS INT) AS pos, unnest(x) AS token FROM (
  SELECT doc_id, regexp_split_to_array(regexp_replace(lower(replace(text, 'İ', 'i' || chr(775))), '[^a-z0-9ğüşöçıİ\\s-]', ' ', 'g'), '\\s+') AS x FROM src)),
 kc AS (SELECT doc_id, token, count(*) AS uses, min(pos) AS first_pos FROM kt WHERE length(token) > 3 AND token NOT IN ({_words(G.KEYWORD_STOP_WORDS)}) GROUP BY doc_id, token),
 kr AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY uses DESC, first_pos) AS rank FROM kc)"""


@catalog.add("top_keywords", "H1", f"WITH src AS (SELECT doc_id, text FROM documents), {_KEYWORDS} SELECT doc_id, rank, token, uses FROM kr WHERE rank <= 3")
def _(spark, sf):
    return LO.top_keywords(table(spark, sf, "documents"))


def normalize_tag_sql(x: str) -> str:
    return f"substr(regexp_replace(regexp_replace(lower({S.trim(x)}), '\\s+', '-', 'g'), '[^a-z0-9\\-ğüşöçı]', '', 'g'), 1, 24)"


def normalize_tags_sql(x: str) -> str:
    clean = f"list_filter(list_transform({x}, lambda t: {normalize_tag_sql('t')}), lambda t: t <> '')"
    return f"list_filter({clean}, lambda t, i: list_position({clean}, t) = i)[1:10]"


@catalog.add("suggested_tags", "H2", with_views(f"""
WITH src AS (SELECT doc_id, text FROM marked_docs), {_KEYWORDS}, kw AS (SELECT doc_id, list(token ORDER BY rank) AS ks FROM kr WHERE rank <= 3 GROUP BY doc_id),
 m AS (SELECT doc_id, text, source_type, CASE WHEN source_type IN ('image', 'camera') THEN 'ocr' WHEN doc_id % 3 = 0 THEN 'nemeth' ELSE 'text' END AS mode FROM marked_docs)
SELECT doc_id, array_to_string({normalize_tags_sql("list_filter(flatten([['My Tag', lang_tag], [CASE WHEN source_type <> 'manual' THEN source_type END, CASE WHEN mode = 'nemeth' THEN 'math' END, CASE WHEN mode = 'ocr' THEN 'ocr' END, CASE WHEN nl >= 4 THEN 'multi-section' END], coalesce(ks, [])]), lambda t: t IS NOT NULL)")}, ',') AS tags
FROM (SELECT m.*, ks, concat('  Doc  ', doc_id % 5, '!') AS lang_tag, length(text) - length(replace(text, chr(10), '')) AS nl FROM m LEFT JOIN kw USING (doc_id))""", "marked_docs"))
def _(spark, sf):
    src, k = F.col("source_type"), F.col("doc_id")
    mode = F.when(src.isin("image", "camera"), "ocr").when(k % 3 == 0, "nemeth").otherwise("text")
    own = F.array(F.lit("My Tag"), F.concat(F.lit("  Doc  "), (k % 5).cast("string"), F.lit("!")))
    d = marked_docs(spark, sf).withColumn("mode", mode).withColumn("own", own)
    return LO.suggest_tags(d, user_tags="own").select("doc_id", F.array_join("tags", ",").alias("tags"))


@catalog.add("normalized_tags", "H3", f"""
SELECT p_partkey, array_to_string({normalize_tags_sql("[p_name, p_brand, p_type, concat(' ', p_name, '  ', p_type, ' '), 'ÇOK İyi', p_brand, '!!']")}, ',') AS tags FROM part""")
def _(spark, sf):
    raw = F.array("p_name", "p_brand", "p_type", F.concat(F.lit(" "), "p_name", F.lit("  "), "p_type", F.lit(" ")), F.lit("ÇOK İyi"), F.col("p_brand"), F.lit("!!"))
    return table(spark, sf, "part").select("p_partkey", F.array_join(G.normalize_tags(raw), ",").alias("tags"))


@catalog.add("tag_facets", "H4", with_views("SELECT tag, count(DISTINCT doc_id) AS documents FROM (SELECT doc_id, unnest(tags) AS tag FROM library_docs) GROUP BY tag", "library_docs"))
def _(spark, sf):
    return LO.tag_facets(library_docs(spark, sf))
