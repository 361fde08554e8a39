"""Sinks: library tables and export files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import language as L
from ..operators.transcoding import PAGE_MARKER, PAGE_SEPARATOR, combine_brf, document_brf, stored_pages
from .packs import write_pack

RECORD_SEPARATOR = "\x1e"
LIBRARY_COLUMNS = ["user_id", "file_name", "original_text", "braille_text", "source_type", "conversion_mode", "tags"]


def append_documents(df: DataFrame, path: str, batch: str | int | None = None) -> None:
    """Append converted documents with normalised tags, by source type.

    With ``batch``, what an earlier run of the same batch wrote is replaced, so a batch that is run again after a
    failure adds nothing twice: its rows lie in a folder of their own, which ``read_library`` reads with all others.
    """
    out = df.withColumn("tags", L.normalize_tags(F.col("tags")))
    folder, mode = ("none", "append") if batch is None else (batch, "overwrite")
    out.write.mode(mode).partitionBy("source_type").parquet(f"{path}/batch={folder}")


def read_library(spark: SparkSession, path: str) -> DataFrame:
    """Documents of all batches that ``append_documents`` wrote."""
    return spark.read.option("basePath", path).parquet(f"{path}/batch=*").drop("batch")


def write_brf(
    df: DataFrame, path: str, order: str, cells: str = "braille_text", combined: bool = False, marker: str = PAGE_MARKER, parts: int = 16
) -> None:
    """Embosser text: a pack of one record per document (``<order>.brf``), or one ordered collection.

    A pack has at most ``parts`` files, however many documents there are.  The combined form is a sorted set of part
    files: read one after the other, with the page separator between rows, they are the combined file.
    """
    if combined:
        rows = combine_brf(df, order, cells, marker)
        rows.select(F.col("brf").alias("value")).write.mode("overwrite").option("lineSep", PAGE_SEPARATOR).text(path)
        return
    name = F.concat(F.col(order).cast("string"), F.lit(".brf"))
    write_pack(df.select(name.alias("name"), document_brf(F.col(cells), marker).alias("text")), path, parts)


def write_txt(df: DataFrame, path: str, order: str, cells: str = "braille_text", marker: str = PAGE_MARKER, parts: int = 16) -> None:
    """Unicode cells, the pages of a document joined by a form feed: a pack of one record per document (``<order>.txt``)."""
    name = F.concat(F.col(order).cast("string"), F.lit(".txt"))
    text = F.array_join(stored_pages(F.col(cells), marker), PAGE_SEPARATOR)
    write_pack(df.select(name.alias("name"), text.alias("text")), path, parts)


def write_text_files(df: DataFrame, path: str, cells: str = "braille_text", marker: str = PAGE_MARKER) -> None:
    """Unicode cells as text files, one for each partition: every document ends in a line end and a record separator."""
    text = F.concat(F.array_join(stored_pages(F.col(cells), marker), PAGE_SEPARATOR), F.lit("\n"))
    df.select(text.alias("value")).write.mode("overwrite").option("lineSep", RECORD_SEPARATOR).text(path)
