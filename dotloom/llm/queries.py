"""Named queries over the given tables, one per operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dotloom.llm import bpe, decontaminate, filteraudit, fingerprints, langid, linededup, mixing, ngramjoin, packing, tokencount, topk
from dotloom.llm import toxicity, vectorcodes
from dotloom.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", bpe.round_trip(F.col("text")).alias("r")).select("doc_id", "r.*")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return tokencount.count_tokens(docs).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", langid.held_out(F.col("doc_id")))
    labelled = docs.where("not held_out").select("lang", "text")
    return langid.identify(docs.select("doc_id", "held_out", "text"), labelled).drop("text")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", topk.integers(F.col("embedding")).alias("v"))
    return topk.top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0))


OP9_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return linededup.dedup(docs).select("doc_id", "text", "n_lines", "n_removed")


OP5_SQL = r"""
WITH l AS (
  SELECT doc_id, line_no, line, length(line) AS n FROM (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
           generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS line_no FROM documents)
), d AS (
  SELECT line, n, min((doc_id, line_no)) AS pos FROM l WHERE n >= 20 GROUP BY line, n
), k AS (
  SELECT line, n, pos, m, 0 AS side, left(line, m // 2) AS half FROM (SELECT *, unnest([n - 1, n]) AS m FROM d)
  UNION ALL SELECT line, n, pos, m, 1, right(line, m // 2) FROM (SELECT *, unnest([n - 1, n]) AS m FROM d)
), near AS (
  SELECT DISTINCT a.line FROM k a JOIN k b ON a.m = b.m AND a.side = b.side AND a.half = b.half AND b.pos < a.pos
  WHERE levenshtein(a.line, b.line) <= 1
), judged AS (
  SELECT l.*, l.n >= 20 AND (l.line IN (SELECT line FROM near) OR (l.doc_id, l.line_no) <> d.pos) AS gone
  FROM l LEFT JOIN d ON l.line = d.line
)
SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (WHERE gone IS NOT TRUE), '') AS text,
       count(*)::INT AS n_lines, count(*) FILTER (WHERE gone)::INT AS n_removed
FROM judged GROUP BY doc_id
"""


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = mixing.described(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    return mixing.mixed_sample(docs).select("doc_id", "source", "lang", "topic", "n_tokens", "ratio", "probability")


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return ngramjoin.join_documents(docs, width=3, num=90, den=100)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", langid.held_out(F.col("doc_id")).alias("held_out"))
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    labelled = toxicity.labelled_texts(docs.where("not held_out"), labels)
    found = toxicity.detect(docs, labelled)
    return found.select(
        "doc_id", "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), F.size("passages").alias("n_passages")
    )


OP7_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS words FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2]) END) AS shingle
  FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1
), shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2
), link AS (
  SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 90 * (x.n + y.n - k)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(r.b) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN reach r ON r.a = d.doc_id GROUP BY 1, 2
"""


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = vectorcodes.compress(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
    digest = F.lit(vectorcodes.digest(books))
    return codes.select("vec_id", "code", "error", "label_error", digest.alias("codebooks_sha256"))


def _op11_sql() -> str:
    """Rounds of assignment and new entries over vectors of equal length, one part of one entry a row."""
    step = """
, a{0} AS MATERIALIZED (
  SELECT row, part, arg_min(entry, (d, entry)) AS entry, min(d) AS d FROM (
    SELECT s.row, s.part, c.entry, list_sum(list_transform(list_zip(s.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
    FROM s JOIN c{0} c ON s.part = c.part) GROUP BY row, part)"""
    new = """
, c{1} AS MATERIALIZED (
  SELECT c.part, c.entry, CASE WHEN u.v IS NULL THEN c.v ELSE u.v END AS v FROM c{0} c LEFT JOIN (
    SELECT part, entry, list(x ORDER BY place) AS v FROM (
      SELECT part, entry, place, floor(sum(x) / count(*))::BIGINT AS x FROM (
        SELECT s.part, a.entry, generate_subscripts(s.v, 1) AS place, unnest(s.v) AS x FROM s JOIN a{0} a ON s.row = a.row AND s.part = a.part)
      GROUP BY part, entry, place) GROUP BY part, entry) u ON u.part = c.part AND u.entry = c.entry)"""
    rounds = "".join(step.format(r) + new.format(r, r + 1) for r in range(vectorcodes.ROUNDS)) + step.format(vectorcodes.ROUNDS)
    return f"""
WITH k AS MATERIALIZED (
  SELECT *, row_number() OVER (ORDER BY vec_id NULLS LAST, v) - 1 AS row FROM (
    SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
), s AS MATERIALIZED (
  SELECT row, part, v[part * len(v) // 4 + 1 : (part + 1) * len(v) // 4] AS v FROM (SELECT row, v, unnest([0, 1, 2, 3]) AS part FROM k)
), c0 AS MATERIALIZED (SELECT part, row AS entry, v FROM s WHERE row < 256){rounds}
, coded AS (
  SELECT row, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error
  FROM a{vectorcodes.ROUNDS} GROUP BY row
)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
       (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) FROM c{vectorcodes.ROUNDS}) AS codebooks_sha256
FROM coded JOIN k USING (row)
"""


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    masks = filteraudit.flagged(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return filteraudit.audit(filteraudit.mask_counts(masks, table(spark, sf_dir, "labels")))


OP12_SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), f AS (
  SELECT doc_id, part, [len(words) < 100, 100 * len(list_distinct(words)) < 80 * len(words),
    100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text), regexp_matches(text, '[#$%&*|]'),
    coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)] AS fails FROM w
), l AS (
  SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS bad FROM labels GROUP BY 1
), d AS (SELECT f.*, coalesce(good, false) AS good, coalesce(bad, false) AS bad FROM f LEFT JOIN l USING (doc_id)
), x AS (SELECT unnest([1, 2, 3, 4, 5]) AS i), o AS (
  SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM x a JOIN x b ON b.i <> a.i JOIN x c ON c.i NOT IN (a.i, b.i)
  JOIN x d ON d.i NOT IN (a.i, b.i, c.i) JOIN x e ON e.i NOT IN (a.i, b.i, c.i, d.i)
), g AS (SELECT part, fails, good, bad, count(*) AS n FROM d GROUP BY ALL
), r AS (
  SELECT part, array_to_string(list_transform(o, lambda k: 'ABCDE'[k]), '') AS filter_order, step, o[step] AS filter, n, good, bad,
    fails[o[step]] AS own, list_bool_or(list_transform(o[1 : step - 1], lambda k: fails[k])) IS TRUE AS earlier,
    len(list_filter(fails, lambda b: b)) = 1 AS alone
  FROM g, o, (SELECT i AS step FROM x)
), s AS (
  SELECT part, filter_order, step, filter, sum(CASE WHEN NOT own AND NOT earlier THEN n ELSE 0 END)::BIGINT AS kept,
    sum(CASE WHEN own AND NOT earlier THEN n ELSE 0 END)::BIGINT AS removed, sum(CASE WHEN own AND earlier THEN n ELSE 0 END)::BIGINT AS redundant,
    sum(CASE WHEN own AND alone THEN n ELSE 0 END)::BIGINT AS unique_fails,
    sum(CASE WHEN own AND NOT earlier AND good THEN n ELSE 0 END)::BIGINT AS good_lost,
    sum(CASE WHEN own AND NOT earlier AND bad THEN n ELSE 0 END)::BIGINT AS toxic_lost
  FROM r GROUP BY ALL
)
SELECT * EXCLUDE (filter), sum(removed) OVER (PARTITION BY part, filter)::BIGINT AS shapley FROM s
"""


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))
    hit = decontaminate.hit_words()
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )


OP13_SQL = r"""
WITH t AS (
  SELECT 'd' AS kind, row_number() OVER () AS id, doc_id AS name, text FROM documents
  UNION ALL SELECT 'i', row_number() OVER (), item_id, text FROM benchmark
), w AS MATERIALIZED (
  SELECT kind, id, name, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                              '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM t
), win AS MATERIALIZED (
  SELECT DISTINCT name::VARCHAR AS item, n, array_to_string(w[i : i + n - 1], ' ') AS gram FROM (
    SELECT name, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM w WHERE kind = 'i' AND len(w) > 0)
), gram AS (
  SELECT id, n, i, array_to_string(w[i : i + n - 1], ' ') AS gram FROM (
    SELECT id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM w, (SELECT DISTINCT n FROM win) WHERE kind = 'd')
), hit AS MATERIALIZED (SELECT gram.id, gram.n, gram.i, win.item FROM gram JOIN win ON gram.n = win.n AND gram.gram = win.gram
), h AS (SELECT id, count(DISTINCT place) AS n_hit FROM (SELECT id, unnest(range(i, i + n)) AS place FROM hit) GROUP BY 1
), o AS (SELECT id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hit GROUP BY 1)
SELECT name AS doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN h USING (id) LEFT JOIN o USING (id) WHERE kind = 'd'
"""


QUERIES: dict[str, Query] = {
    "op1_bpe": op1_bpe,
    "op2_token_counts": op2_token_counts,
    "op3_language_id": op3_language_id,
    "op4_packing": op4_packing,
    "op5_line_dedup": op5_line_dedup,
    "op6_fingerprints": op6_fingerprints,
    "op7_ngram_join": op7_ngram_join,
    "op8_mixing": op8_mixing,
    "op9_top_k": op9_top_k,
    "op10_toxicity": op10_toxicity,
    "op11_vector_codes": op11_vector_codes,
    "op12_filter_audit": op12_filter_audit,
    "op13_decontamination": op13_decontamination,
}
ORACLES: dict[str, str] = {
    "op5_line_dedup": OP5_SQL,
    "op7_ngram_join": OP7_SQL,
    "op9_top_k": OP9_SQL,
    "op11_vector_codes": _op11_sql(),
    "op12_filter_audit": OP12_SQL,
    "op13_decontamination": OP13_SQL,
}
