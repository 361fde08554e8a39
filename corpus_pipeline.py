"""From raw documents to token ids: language, repeated lines, near duplicates, mixture, encoding.

Every stage takes (spark, docs, sf_dir), works on all documents that the one before kept, and is written as Parquet
and read again.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dotloom.llm import bpe, langid, linededup, mixing, ngramjoin
from dotloom.llm.common import fresh, table, written

#: Documents whose language is less likely than this, against all others, are rejected.
LEAST_SCORE = 0.5


def _without_replacing(docs: DataFrame, names: tuple[str, ...], stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``stage`` on ``docs``, whose own columns of ``names``, which it would replace, come back as they were."""
    own = {f"_own_{k}": c for k, c in enumerate(docs.columns) if c.lower() in names}
    aside = docs.withColumnsRenamed({c: k for k, c in own.items()})
    return stage(aside).drop(*names).withColumnsRenamed(own).select(*docs.columns)


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that can be told; text without a letter is rejected."""
    labelled = docs.where(~langid.held_out(F.col("doc_id"))).select("lang", "text")
    own = fresh(docs, "told")
    told = docs.withColumn(own, langid.predicted(F.col("text"), langid.train(labelled), spark))
    return told.where((F.col(f"{own}.lang_pred") != "und") & (F.col(f"{own}.score") >= LEAST_SCORE)).drop(own)


def lines_deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated lines; those of which nothing is left go.  n_chars follows the text."""

    def stage(docs: DataFrame) -> DataFrame:
        kept = linededup.dedup(docs).where((F.col("n_removed") == 0) | (F.trim("text") != ""))
        if "n_chars" in docs.columns:
            kept = kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
        return kept

    return _without_replacing(docs, ("n_lines", "n_removed"), stage)


def near_duplicates_dropped(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links by five-word shingles at a similarity of 0.8."""
    return ngramjoin.first_of_each(docs, width=5, num=80, den=100).select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample of documents whose tokens meet the target shares of sources, languages and topics."""
    names = ("topic", "n_tokens", "ratio", "probability")
    return _without_replacing(docs, names, lambda d: mixing.mixed_sample(mixing.described(d)))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and the digest of the text that they decode to.

    Null and empty texts have no ids; whole texts are encoded, however long; repeated rows stay, and no rows give none.
    """
    own = docs.select("doc_id", "lang", "source", bpe.checked(F.col("text")).alias("r"))
    return own.select("doc_id", "lang", "source", "r.ids", F.size("r.ids").cast("long").alias("n_tokens"), "r.decoded_sha256")


STAGES = [
    ("language", identified),
    ("line_dedup", lines_deduplicated),
    ("near_duplicates", near_duplicates_dropped),
    ("mixing", mixed),
    ("bpe", encoded),
]

#: The first stage learns a model, which SQL doesn't express; tests hold all stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
