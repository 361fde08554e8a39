"""Language and keyword operators over document and block tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import language as L
from ..functions import regex as R


def with_language(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds tokens, tr, en, language, confidence; no shuffle."""
    scored = df.withColumn("_s", L.language_scores(F.col(text)))
    d = scored.withColumn("_d", L.detect_language(F.col("_s")))
    return d.select(*df.columns, "_s.tokens", "_s.tr", "_s.en", "_d.language", "_d.confidence")


def detect_language_by_blocks(blocks: DataFrame, key: str, order: str = "block_no") -> DataFrame:
    """Per document: mixed when blocks disagree, else the most confident block."""
    known = F.col("language") != "unknown"
    # ties go to the first block
    pick = F.when(known, F.struct(F.col("confidence"), (-F.col(order)).alias("o")))
    g = blocks.groupBy(key).agg(
        F.max_by("language", pick).alias("_l"),
        F.max(F.when(known, F.col("confidence"))).alias("_c"),
        F.min(F.when(known, F.col("language"))).alias("_lo"),
        F.max(F.when(known, F.col("language"))).alias("_hi"),
    )
    several = F.col("_lo") != F.col("_hi")
    return g.select(
        key,
        F.when(several, "mixed").otherwise(F.coalesce(F.when(F.col("_c").isNotNull(), F.col("_l")), F.lit("unknown"))).alias("language"),
        F.when(several, 0.9).otherwise(F.coalesce("_c", F.lit(0.0))).alias("confidence"),
    )


def language_confusion(df: DataFrame, labelled: str = "lang", text: str = "text") -> DataFrame:
    """Labelled against detected language, one row per label."""
    kinds = ["en", "mixed", "tr", "unknown"]
    found = with_language(df.select(labelled, text), text)
    return found.groupBy(labelled).agg(
        *[F.count_if(F.col("language") == k).alias(f"detected_{k}") for k in kinds]
    )


def top_keywords(df: DataFrame, key: str = "doc_id", text: str = "text", k: int = 3) -> DataFrame:
    """The k most frequent keywords of each document, first seen wins ties.

    Counted inside the row, so neither texts nor tokens move: equal tokens are neighbours once sorted, a run's
    length is its count, and its first member has the first position.
    """
    return df.select(key, F.posexplode(keywords(F.col(text), k)).alias("_r", "_k")).select(
        key, (F.col("_r") + 1).alias("rank"), "_k.token", "_k.uses"
    )


def keywords(text: Column, k: int = 3) -> Column:
    """Array of struct(token, uses): the k most frequent keywords of a text, in order."""
    placed = F.transform(L.keyword_tokens(text), lambda t, i: F.struct(t.alias("token"), i.alias("pos")))
    ordered = F.sort_array(F.filter(placed, lambda x: ~x["token"].isin(list(L.KEYWORD_STOP_WORDS))))

    def first(s: Column, i: Column) -> Column:
        return (i == 0) | (F.get(s, i)["token"] != F.get(s, i - 1)["token"])

    def counted(s: Column, starts: Column) -> Column:
        runs = F.transform(
            starts,
            lambda b, j: F.struct(
                (b - F.coalesce(F.get(starts, j + 1), F.size(s))).alias("fewer"), F.get(s, b)["pos"].alias("pos"), F.get(s, b)["token"].alias("token")
            ),
        )
        return F.transform(F.slice(F.sort_array(runs), 1, k), lambda r: F.struct(r["token"].alias("token"), (-r["fewer"]).cast("long").alias("uses")))

    none = F.array().cast("array<int>")
    places = lambda s: F.when(F.size(s) > 0, F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: first(s, i))).otherwise(none)
    return R.let(ordered, lambda s: R.let(places(s), lambda starts: counted(s, starts)))


def suggest_tags(df: DataFrame, key: str = "doc_id", text: str = "text", user_tags: str | None = None) -> DataFrame:
    """Suggested tags per document; needs source_type and mode columns."""
    return df.select(
        key,
        L.seed_tags(
            F.col(text), F.col("source_type"), F.col("mode"), F.transform(keywords(F.col(text)), lambda s: s["token"]),
            None if user_tags is None else F.col(user_tags),
        ).alias("tags"),
    )


def tag_facets(df: DataFrame, key: str = "doc_id", tags: str = "tags") -> DataFrame:
    """Every tag with its number of documents, by name."""
    return (
        df.select(F.explode(F.array_distinct(tags)).alias("tag"))
        .groupBy("tag").agg(F.count("*").alias("documents")).orderBy("tag")
    )
