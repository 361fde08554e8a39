"""Named queries: files written from the given tables and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import transcode as X
from ..sources import packs, readers, writers
from . import duck as D
from .catalog import catalog
from .streams import _scratch
from .transcoding import WRAPPED, strict_sql
from .views import dealt, layout_lines, table, with_views


@catalog.add("layout_items_read", "A6", with_views("""
SELECT CAST(doc_id AS VARCHAR) AS doc_id, CAST(1 + line_no // 50 AS INT) AS page_no, text AS str, CAST(x0 AS DOUBLE) AS x, CAST(y0 AS DOUBLE) AS y, CAST(x1 - x0 AS DOUBLE) AS width, CAST(12 AS DOUBLE) AS height FROM layout_lines""", "layout_lines"))
def _(spark, sf):
    n = F.lit(0.0)
    item = F.struct(
        F.col("text").alias("str"),
        F.array(F.lit(1.0), n, n, F.lit(1.0), F.col("x0").cast("double"), F.col("y0").cast("double")).alias("transform"),
        (F.col("x1") - F.col("x0")).cast("double").alias("width"), F.lit(12.0).alias("height"),
    )
    pages = layout_lines(spark, sf).groupBy(F.col("doc_id").cast("string").alias("doc_id"), (1 + F.floor(F.col("line_no") / 50)).cast("int").alias("page_no")).agg(
        F.collect_list(item).alias("items")
    )
    docs = pages.groupBy("doc_id").agg(
        F.collect_list(F.struct("page_no", F.lit(612.0).alias("width"), F.lit(792.0).alias("height"), "items")).alias("pages")
    )
    path = _scratch(spark) + "/layout"
    docs.write.mode("overwrite").json(path)
    return readers.read_layout_items(spark, path).select("doc_id", "page_no", "str", "x", "y", "width", "height")


@catalog.add("combined_brf_file", "A9", f"""
WITH b AS (SELECT doc_id, {D.strip(strict_sql('text'))} AS braille FROM documents WHERE {D.strip(strict_sql('text'))} <> ''), {WRAPPED}
SELECT page FROM p""")
def _(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", X.to_braille_strict(F.col("text")).alias("braille_text"))
    path = _scratch(spark) + "/brf"
    writers.write_brf(docs, path, "doc_id", combined=True)
    # every page of every document is one record of the combined file
    return spark.read.option("lineSep", writers.PAGE_SEPARATOR).text(path).select(F.col("value").alias("page"))


_EXPORTED = f"{D.strip(strict_sql('text'))}"


@catalog.add("text_pack_read", "A10", f"SELECT concat(doc_id, '.txt') AS name, {_EXPORTED} AS text FROM documents")
def _(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", X.to_braille_strict(F.col("text")).alias("braille_text"))
    path = _scratch(spark) + "/txt"
    writers.write_txt(docs, path, "doc_id")
    return packs.read_pack(spark, path)


@catalog.add("brf_pack_read", "A9", f"""
WITH b AS (SELECT doc_id, {_EXPORTED} AS braille FROM documents), {WRAPPED}
SELECT concat(doc_id, '.brf') AS name, coalesce(q.text, '') AS text FROM documents LEFT JOIN (SELECT doc_id, string_agg(page, concat(chr(10), chr(12), chr(10)) ORDER BY page_no) AS text FROM p WHERE doc_id IN (SELECT doc_id FROM b WHERE braille <> '') GROUP BY doc_id) q USING (doc_id)""")
def _(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", X.to_braille_strict(F.col("text")).alias("braille_text"))
    path = _scratch(spark) + "/brf"
    writers.write_brf(docs, path, "doc_id")
    return packs.read_pack(spark, path)


@catalog.add("text_files_read", "A4", f"SELECT concat({_EXPORTED}, chr(10)) AS original_text, 'manual' AS source_type FROM documents WHERE {_EXPORTED} <> ''")
def _(spark, sf):
    docs = dealt(table(spark, sf, "documents").select("text")).select(X.to_braille_strict(F.col("text")).alias("braille_text"))
    path = _scratch(spark) + "/txt"
    writers.write_text_files(docs, path)
    texts = readers.read_text_documents(spark, path, writers.RECORD_SEPARATOR).select("original_text", "source_type")
    return texts.filter(F.col("original_text") != "\n")
