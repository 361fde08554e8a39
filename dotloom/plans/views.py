"""Views that Spark derives from the given tables, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .duck import q
from .snippets import SNIPPETS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Rows of much work, dealt over all cores: a file is split by its row groups, and a group may hold the whole table.

    Dealt by a key, what is grouped by it, alone or with other columns, needs no further exchange.
    """
    spark = df.sparkSession
    return df.repartition(max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys)


def library_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array(*map(F.lit, ["manual", "pdf", "image", "camera", "graph", "word-addin"]))
    d = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.concat(F.lit("u"), (d % 50).cast("string")).alias("user_id"),
        F.concat(F.lit("doc-"), d.cast("string"), F.lit(".txt")).alias("file_name"),
        F.col("text").alias("original_text"),
        F.element_at(kinds, (d % 6 + 1).cast("int")).alias("source_type"),
        F.array("lang", "source").alias("tags"),
        (d % 7 == 0).alias("is_favorite"),
        (d % 11 == 0).alias("is_archived"),
        F.timestamp_add(
            "HOUR", d.cast("int"), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
        ).alias("created_at"),
    )


LIBRARY_DOCS = """
SELECT doc_id, concat('u', CAST(doc_id % 50 AS VARCHAR)) AS user_id, concat('doc-', CAST(doc_id AS VARCHAR), '.txt') AS file_name,
 text AS original_text, (['manual','pdf','image','camera','graph','word-addin'])[doc_id % 6 + 1] AS source_type,
 [lang, source] AS tags, doc_id % 7 = 0 AS is_favorite, doc_id % 11 = 0 AS is_archived,
 TIMESTAMP '2024-01-01 00:00:00' + doc_id * INTERVAL 1 HOUR AS created_at FROM documents"""


def layout_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, side = F.col("line_no"), F.col("line_no") % 9 == 8
    drop = 14 * n + 20 * F.floor(n / 7).cast("int")
    return (
        dealt(table(spark, sf_dir, "documents").select("doc_id", "text"))
        .select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "text"))
        .select(
            "doc_id", "line_no", "text",
            F.when(side, 470).otherwise(72).alias("x0"),
            F.when(side, 570).otherwise(72 + F.least(F.lit(468), 6 * F.length("text"))).alias("x1"),
            (768 - drop).alias("y0"), (780 - drop).alias("y1"),
        )
    )


LAYOUT_LINES = """
SELECT doc_id, line_no, text, CASE WHEN line_no % 9 = 8 THEN 470 ELSE 72 END AS x0,
 CASE WHEN line_no % 9 = 8 THEN 570 ELSE 72 + least(468, 6 * length(text)) END AS x1,
 768 - 14 * line_no - 20 * CAST(floor(line_no / 7) AS INT) AS y0, 780 - 14 * line_no - 20 * CAST(floor(line_no / 7) AS INT) AS y1
 FROM (SELECT doc_id, CAST(generate_subscripts(l, 1) - 1 AS INT) AS line_no, unnest(l) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))"""


def paragraph_text(col: Column) -> Column:
    """A blank line after every fifth line, stated per document."""
    lines = F.split(col, "\n")
    return F.array_join(
        F.transform(lines, lambda x, i: F.concat(x, F.when(i % 5 == 4, "\n").otherwise(""))), "\n"
    )


def paragraph_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dealt(table(spark, sf_dir, "documents").select("doc_id", "lang", "text")).select(
        "doc_id", "lang", paragraph_text(F.col("text")).alias("text")
    )


PARAGRAPH_DOCS = """
SELECT doc_id, any_value(lang) AS lang, string_agg(concat(text, CASE WHEN line_no % 5 = 4 THEN chr(10) ELSE '' END), chr(10) ORDER BY line_no) AS text
 FROM (SELECT doc_id, lang, CAST(generate_subscripts(l, 1) - 1 AS INT) AS line_no, unnest(l) AS text FROM (SELECT doc_id, lang, string_split(text, chr(10)) AS l FROM documents)) GROUP BY doc_id"""


def _signed(v: Column) -> Column:
    return F.when(v < 0, F.concat(F.lit(" - "), (-v).cast("string"))).otherwise(
        F.concat(F.lit(" + "), v.cast("string"))
    )


def equations(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    k, a, b = F.col("p_partkey"), F.col("p_size") - 25, F.col("p_partkey") % 21 - 10
    eq = (
        F.when(k % 6 == 0, F.concat(F.lit("y = "), a.cast("string"), F.lit("x"), _signed(b)))
        .when(k % 6 == 1, F.concat(F.lit("y = "), b.cast("string")))
        .when(k % 6 == 2, F.concat(F.lit("x = "), b.cast("string")))
        .when(k % 6 == 3, F.concat(F.lit("y = x^2"), _signed(b), F.lit("x"), _signed(a)))
        .when(k % 6 == 4, F.concat(F.lit("y = |x"), _signed(b), F.lit("|"), _signed(a)))
        .otherwise(
            F.concat(
                F.lit("(x"), _signed(a), F.lit(")^2 + (y"), _signed(b), F.lit(")^2 = "),
                F.col("p_size").cast("string"),
            )
        )
    )
    return dealt(p.select("p_partkey", eq.alias("equation")))


def _sql_signed(v: str) -> str:
    return f"CASE WHEN {v} < 0 THEN concat(' - ', CAST(-({v}) AS VARCHAR)) ELSE concat(' + ', CAST({v} AS VARCHAR)) END"


EQUATIONS = f"""
SELECT p_partkey, CASE p_partkey % 6
 WHEN 0 THEN concat('y = ', CAST(a AS VARCHAR), 'x', {_sql_signed('b')}) WHEN 1 THEN concat('y = ', CAST(b AS VARCHAR)) WHEN 2 THEN concat('x = ', CAST(b AS VARCHAR))
 WHEN 3 THEN concat('y = x^2', {_sql_signed('b')}, 'x', {_sql_signed('a')}) WHEN 4 THEN concat('y = |x', {_sql_signed('b')}, '|', {_sql_signed('a')})
 ELSE concat('(x', {_sql_signed('a')}, ')^2 + (y', {_sql_signed('b')}, ')^2 = ', CAST(p_size AS VARCHAR)) END AS equation
 FROM (SELECT p_partkey, p_size, p_size - 25 AS a, p_partkey % 21 - 10 AS b FROM part)"""


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    theme = F.when(k % 3 == 0, "dark").when(k % 3 == 1, "light").otherwise("neon")
    return table(spark, sf_dir, "customer").select(
        k.alias("id"),
        F.lower(F.concat(F.translate("c_name", "# ", ".."), F.lit("@example.com"))).alias("email"),
        F.when(k % 13 == 0, "owner").otherwise("member").alias("role"),
        F.concat(
            F.lit('{"themeMode":"'), theme, F.lit('","documentView":"'),
            F.when(k % 2 == 0, "library").otherwise("upload"), F.lit('"}'),
        ).alias("preferences"),
    )


PROFILES = """
SELECT c_custkey AS id, lower(concat(replace(replace(c_name, '#', '.'), ' ', '.'), '@example.com')) AS email,
 CASE WHEN c_custkey % 13 = 0 THEN 'owner' ELSE 'member' END AS role,
 concat('{"themeMode":"', CASE WHEN c_custkey % 3 = 0 THEN 'dark' WHEN c_custkey % 3 = 1 THEN 'light' ELSE 'neon' END,
 '","documentView":"', CASE WHEN c_custkey % 2 = 0 THEN 'library' ELSE 'upload' END, '"}') AS preferences FROM customer"""


def with_views(body: str, *views: str) -> str:
    """Prefix a DuckDB statement with the derived views it reads."""
    known = {
        "library_docs": LIBRARY_DOCS, "layout_lines": LAYOUT_LINES, "paragraph_docs": PARAGRAPH_DOCS,
        "equations": EQUATIONS, "profiles": PROFILES,
        "marked_docs": MARKED_DOCS, "marked_lines": MARKED_LINES,
    }
    ctes = ",\n".join(f"{v} AS ({known[v]})" for v in views)
    body = body.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"


def _picks(doc: Column) -> list[Column]:
    lines = F.array(*map(F.lit, SNIPPETS))
    n = len(SNIPPETS)
    return [F.element_at(lines, ((doc * m + k) % n + 1).cast("int")) for m, k in PICKS]


PICKS = [(1, 0), (7, 3), (11, 5), (13, 17)]


def marked_docs(spark: SparkSession, sf_dir: str, *keys: str) -> DataFrame:
    """Documents followed by four of the sample lines, chosen by document; dealt by ``keys`` where they are grouped later."""
    return dealt(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), *keys).select(
        "doc_id", "lang",
        F.element_at(F.array(*map(F.lit, ["manual", "pdf", "image", "camera"])), (F.col("doc_id") % 4 + 1).cast("int")).alias("source_type"),
        F.concat_ws("\n", F.col("text"), *_picks(F.col("doc_id"))).alias("text"),
    )


_LIST = "[" + ", ".join(q(s) for s in SNIPPETS) + "]"
MARKED_DOCS = f"""
SELECT doc_id, lang, (['manual','pdf','image','camera'])[doc_id % 4 + 1] AS source_type,
 concat_ws(chr(10), text, {', '.join(f"({_LIST})[(doc_id * {m} + {k}) % {len(SNIPPETS)} + 1]" for m, k in PICKS)}) AS text FROM documents"""


def _spaced(text: Column) -> Column:
    return F.flatten(
        F.transform(F.split(text, "\n"), lambda l, i: F.when(i % 6 == 5, F.array(l, F.lit(""))).otherwise(F.array(l)))
    )


def marked_lines(spark: SparkSession, sf_dir: str, *keys: str) -> DataFrame:
    """Lines of marked_docs; every sixth line is followed by a blank one."""
    return marked_docs(spark, sf_dir, *keys).select(
        "doc_id", "source_type", F.posexplode(_spaced(F.col("text"))).alias("line_no", "text")
    )


def marked_pages(spark: SparkSession, sf_dir: str, size: int = 9) -> DataFrame:
    """The lines of marked_lines as an array of page texts, ``size`` lines each."""
    d = marked_docs(spark, sf_dir).select("doc_id", "source_type", _spaced(F.col("text")).alias("_l"))
    pages = F.transform(
        F.sequence(F.lit(0), F.floor((F.size("_l") - 1) / size).cast("int")),
        lambda p: F.array_join(F.slice("_l", p * size + 1, F.lit(size)), "\n"),
    )
    return d.select("doc_id", "source_type", pages.alias("pages"))


MARKED_LINES = """
SELECT doc_id, source_type, CAST(generate_subscripts(l, 1) - 1 AS INT) AS line_no, unnest(l) AS text FROM (
 SELECT doc_id, source_type, flatten(list_transform(string_split(text, chr(10)), lambda x, i: CASE WHEN (i - 1) % 6 = 5 THEN [x, ''] ELSE [x] END)) AS l FROM marked_docs)"""
