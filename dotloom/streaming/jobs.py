"""Continuous jobs: the same column functions over streams.

State is bounded: windows are closed by a watermark, and the quota keeps one
counter per user.  Checkpoints and sinks are paths the caller passes, which on
a cluster lie in shared storage.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import predicates as P
from ..functions import regex as R
from ..functions import text as B
from ..functions import transcode as X
from ..operators import library as L
from ..operators.transcoding import convert_text
from ..sources.writers import append_documents

DOCUMENT_SCHEMA = "doc_id long, user_id string, file_name string, original_text string, source_type string"
EVENT_SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def convert_columns(df: DataFrame) -> DataFrame:
    """Upload -> library row: mode and cells; stateless, so batch and stream agree."""
    mode = P.conversion_mode(F.col("original_text"), F.col("source_type"))
    fixed = B.fix_encoding(R.text("original_text"))
    return df.withColumn("conversion_mode", mode).withColumn(
        "braille_text",
        F.when(F.col("conversion_mode") == "text", X.to_braille_strict(fixed)).otherwise(convert_text(F.col("original_text"))),
    )


def stream_convert(spark: SparkSession, src_dir: str, sink: str, checkpoint: str) -> StreamingQuery:
    """Convert every new upload once and append it to the library.

    Every micro-batch is a batch of ``append_documents``: one that runs again after a failure replaces its own rows.
    """
    src = spark.readStream.schema(DOCUMENT_SCHEMA).parquet(src_dir)
    tags = F.array(F.col("source_type"), F.col("conversion_mode"))

    def append(rows: DataFrame, batch: int) -> None:
        append_documents(rows, sink, batch)

    return (
        convert_columns(src).withColumn("tags", tags).writeStream.foreachBatch(append).outputMode("append")
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def activity_windows(events: DataFrame, size: str = "7 days", slide: str | None = "1 day", late: str = "1 day") -> DataFrame:
    """Events per type in event-time windows; rows later than ``late`` are dropped."""
    span = F.window("ts", size, slide) if slide else F.window("ts", size)
    w = events.withWatermark("ts", late).groupBy(span.alias("w"), "event_type").agg(F.count("*").alias("events"))
    return w.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "event_type", "events")


def running_quota(events: DataFrame, limit: int = L.DOCUMENT_LIMIT) -> DataFrame:
    """Documents per user so far with the quota flags; one counter per user."""
    n = events.groupBy("user_id").agg(F.count("*").alias("documents"))
    return n.select("*", *L.quota_columns(F.col("documents"), limit))


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Stream over a table of events, one file or a folder of part files."""
    # a source takes a plain path for a folder, but a pattern for whatever matches it
    return spark.readStream.schema(EVENT_SCHEMA).parquet(f"{path[:-1]}[{path[-1]}]")


def drain(df: DataFrame, base: str, mode: str = "update") -> DataFrame:
    """Run a stream over all available input and return what it emitted.

    Every micro-batch is written to its own folder below ``base``, so a batch
    that is run again after a failure replaces its earlier output.  The result
    carries the ``batch`` that emitted a row; a stream that emitted nothing gives an empty one.
    """

    def save(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{base}/result/batch={batch}")

    q = (
        df.writeStream.foreachBatch(save).outputMode(mode).option("checkpointLocation", f"{base}/checkpoint")
        .trigger(availableNow=True).start()
    )
    q.awaitTermination()
    try:
        return df.sparkSession.read.parquet(f"{base}/result")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return df.sparkSession.createDataFrame([], df.schema.add("batch", "int"))


def latest(emitted: DataFrame, keys: list[str]) -> DataFrame:
    """The last version of every key of an update stream."""
    values = [c for c in emitted.columns if c not in (*keys, "batch")]
    last = emitted.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("_v"))
    return last.select(*keys, *[F.col(f"_v.{c}").alias(c) for c in values])
