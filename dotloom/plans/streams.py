"""Named queries: the continuous jobs, over the given event and document tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import predicates as P
from ..sources.writers import read_library
from ..streaming import jobs as J
from . import duck as D, sqlrules as Q
from .catalog import catalog
from .transcoding import line_sql, strict_sql
from .views import library_docs, with_views


def _scratch(spark: SparkSession) -> str:
    """A fresh folder below the shared checkpoint folder of the cluster; a local one only with a local master."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return f"{shared.rstrip('/')}/{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def _streamed_sql() -> str:
    """The conversions of the library, document by document: text code, or line by line."""
    lines = """l1 AS (SELECT doc_id, CAST(generate_subscripts(x, 1) AS INT) AS i, unnest(x) AS line FROM (SELECT doc_id, string_split(regexp_replace(original_text, '\\n{2,}', chr(10) || chr(10), 'g'), chr(10)) AS x FROM m WHERE mode <> 'text'))"""
    return with_views(f"""WITH m AS (SELECT *, CASE WHEN source_type IN ('image', 'camera') THEN 'ocr' WHEN {D.matches('original_text', P.NEMETH_HINT)} THEN 'nemeth' ELSE 'text' END AS mode FROM library_docs),
 {lines}, l2 AS (SELECT doc_id, string_agg({line_sql('line')}, chr(10) ORDER BY i) AS cells FROM l1 GROUP BY doc_id)
SELECT doc_id, source_type, mode AS conversion_mode, array_to_string(list_filter([source_type, mode], lambda t: t <> ''), ',') AS tags,
 CASE WHEN mode = 'text' THEN {strict_sql(Q.fix_encoding('original_text'))} ELSE cells END AS braille_text FROM m LEFT JOIN l2 USING (doc_id)""", "library_docs")


@catalog.add("streamed_conversions", "L1 A8", _streamed_sql())
def _(spark: SparkSession, sf: str) -> DataFrame:
    base = _scratch(spark)
    docs = library_docs(spark, sf).select("doc_id", "user_id", "file_name", "original_text", "source_type")
    docs.write.mode("overwrite").parquet(f"{base}/in")
    J.stream_convert(spark, f"{base}/in", f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return read_library(spark, f"{base}/out").select(
        "doc_id", "source_type", "conversion_mode", F.array_join("tags", ",").alias("tags"), "braille_text"
    )


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return J.read_events(spark, f"{sf}/events.parquet")


def _windows(spark: SparkSession, sf: str, slide: str | None, size: str) -> DataFrame:
    keys = ["window_start", "window_end", "event_type"]
    out = J.latest(J.drain(J.activity_windows(_events(spark, sf), size, slide), _scratch(spark)), keys)
    fmt = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return out.select(fmt("window_start"), fmt("window_end"), "event_type", "events")


@catalog.add("activity_daily", "L2", """
SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS window_start, strftime(date_trunc('day', ts) + INTERVAL 1 DAY, '%Y-%m-%d %H:%M:%S') AS window_end,
 event_type, count(*) AS events FROM events GROUP BY ALL""")
def _(spark, sf):
    return _windows(spark, sf, None, "1 day")


@catalog.add("activity_sliding_week", "L2", """
SELECT strftime(date_trunc('day', ts) - k * INTERVAL 1 DAY, '%Y-%m-%d %H:%M:%S') AS window_start, strftime(date_trunc('day', ts) + (7 - k) * INTERVAL 1 DAY, '%Y-%m-%d %H:%M:%S') AS window_end,
 event_type, count(*) AS events FROM events, range(7) r(k) GROUP BY ALL""")
def _(spark, sf):
    return _windows(spark, sf, "1 day", "7 days")


@catalog.add("running_quota", "L3", """
SELECT user_id, documents, CAST(least(100, floor(documents / 50 * 100 + 0.5)) AS BIGINT) AS usage, documents >= 40 AS is_warning, documents >= 50 AS is_exceeded
FROM (SELECT user_id, count(*) AS documents FROM events GROUP BY user_id)""")
def _(spark, sf):
    return J.latest(J.drain(J.running_quota(_events(spark, sf)), _scratch(spark)), ["user_id"])
