"""Sources: every external shape a document can arrive in, as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.graphs import read_graph_payloads

__all__ = [
    "read_text_documents", "read_golden_tsv", "read_layout_items", "read_graph_payloads", "explode_layout_items",
]

GOLDEN_SCHEMA = "case_id string, expression string, expected_tokens string, expected_ast string, expected_cells string"
LAYOUT_SCHEMA = (
    "doc_id string, pages array<struct<page_no:int,width:double,height:double,"
    "items:array<struct<str:string,transform:array<double>,width:double,height:double>>>>"
)


def read_text_documents(spark: SparkSession, path: str, separator: str | None = None) -> DataFrame:
    """One row per text file: file_name, original_text, source_type; with a separator, one per document of a file."""
    raw = spark.read.text(path, wholetext=separator is None, lineSep=separator)
    return raw.select(
        F.col("_metadata.file_name").alias("file_name"), F.col("value").alias("original_text"), F.lit("manual").alias("source_type")
    )


def decode_escapes(col: Column) -> Column:
    """``\\uXXXX`` escapes decoded by reading the value as a JSON string."""
    quoted = F.concat(F.lit('{"a":"'), F.replace(col, F.lit('"'), F.lit('\\"')), F.lit('"}'))
    return F.when(col.contains("\\u"), F.from_json(quoted, "a string")["a"]).otherwise(col)


def read_golden_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Five-column TSV of test cases; '#' starts a comment line.

    A row with another number of fields fails the job when it is read.
    """
    lines = spark.read.text(path).filter(~F.col("value").startswith("#") & (F.trim("value") != ""))
    parts = lines.select(F.split("value", "\t").alias("p"))
    wrong = F.raise_error(F.concat(F.lit("expected 5 fields, found "), F.size("p").cast("string")))
    names = [c.split()[0] for c in GOLDEN_SCHEMA.split(", ")]
    checked = parts.select(F.when(F.size("p") == 5, F.col("p")).otherwise(wrong.cast("array<string>")).alias("p"))
    return checked.select(*[decode_escapes(F.get("p", F.lit(i))).alias(n) for i, n in enumerate(names)])


def explode_layout_items(df: DataFrame) -> DataFrame:
    """Documents of pages of items -> one row per item with its position."""
    pages = df.select("doc_id", F.explode("pages").alias("p"))
    items = pages.select(
        "doc_id", F.col("p.page_no").alias("page_no"), F.col("p.width").alias("page_width"), F.col("p.height").alias("page_height"),
        F.explode("p.items").alias("i"),
    )
    at = lambda k: F.coalesce(F.get("i.transform", F.lit(k)), F.lit(0.0))
    size = lambda n: F.coalesce(F.col(f"i.{n}"), F.lit(0.0))
    return items.select(
        "doc_id", "page_no", "page_width", "page_height", F.coalesce("i.str", F.lit("")).alias("str"),
        at(4).alias("x"), at(5).alias("y"), size("width").alias("width"), size("height").alias("height"),
    )


def read_layout_items(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of positioned text items, one document per line."""
    return explode_layout_items(spark.read.schema(LAYOUT_SCHEMA).json(path))
