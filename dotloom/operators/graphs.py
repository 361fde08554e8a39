"""Graph operators: payload tables and recognised lines of graph images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import equations as E
from ..functions import graphs as G
from ..functions import regex as R
from .transcoding import convert_text


def read_graph_payloads(df: DataFrame, json_col: str) -> DataFrame:
    """JSON text column -> typed payload column; broken JSON gives null fields."""
    return df.withColumn("payload", G.read_payload(F.col(json_col)))


def normalize_payloads(df: DataFrame, json_col: str) -> DataFrame:
    """JSON payloads -> type, confidence, equation, features, notes, descriptions.

    The stages are separate projections, so each value is computed once.
    """
    keep = [c for c in df.columns if c != json_col]
    p = read_graph_payloads(df, json_col).select(*keep, "payload")
    p = p.withColumn("_given", G.normalize_features(F.col("payload")))
    eq = E.squeeze(F.translate(R.text("payload.equation_text"), "−–—", "---"))
    p = p.withColumn("equation", F.when(eq != "", eq)).withColumn("_e", E.equation_features(F.col("equation")))
    summary = E.squeeze(F.col("payload.shape_summary"))
    p = p.withColumn("features", E.merge_hints(F.col("_given"), F.col("_e")))
    r = E.resolve_type(G.normalize_type(F.col("payload.graph_type")), E.type_from_features(summary, F.col("_given")), F.col("_e.type"))
    p = p.withColumn("_r", r)
    f, kind = F.col("features"), F.col("_r.type")
    p = p.withColumn("summary", G.shape_summary(kind, f, summary))
    natural, compact = F.col("payload.natural_description"), F.col("payload.braille_friendly_description")
    notes = F.coalesce("payload.uncertainties", F.array().cast("array<string>"))
    more = F.coalesce("payload.notes", F.array().cast("array<string>"))
    return p.select(
        *keep, kind.alias("graph_type"), G.normalize_confidence(F.col("payload.confidence")).alias("confidence"),
        "equation", "summary", "features", G.normalize_axes(F.col("payload")).alias("axes"), G.given_texts(F.col("payload")).alias("given"),
        F.when(G.is_well_formed(natural), natural).otherwise(G.describe(kind, F.col("equation"), F.col("summary"), f)).alias("natural_description"),
        F.when(G.is_well_formed(compact, True), compact).otherwise(G.describe(kind, F.col("equation"), F.col("summary"), f, True)).alias("compact_description"),
        G.relations(kind, f).alias("relations"), G.unique_texts(F.concat(notes, more, F.col("_r.notes"))).alias("notes"),
    )


NORMALIZED = [
    "graph_type", "confidence", "equation", "summary", "features", "axes", "given", "natural_description", "compact_description", "notes"
]


def display_records(normalized: DataFrame, keys: list[str], locales: tuple[str, ...] = ("en",)) -> DataFrame:
    """Normalised payloads -> their records for display in each locale, with the explanation in cells."""
    p = normalized.select(*keys, F.struct(*NORMALIZED).alias("_p"))
    each = F.array(*[F.struct(F.lit(loc).alias("locale"), G.display_record(F.col("_p"), loc).alias("r")) for loc in locales])
    r = p.select(*keys, F.col("_p.given.cells").alias("_given"), F.explode(each).alias("_r")).select(*keys, "_given", "_r.locale", "_r.r.*")
    synced = F.when(F.col("compact") != "", F.col("compact")).otherwise(F.col("explanation"))
    return r.withColumn("cells", F.when(F.col("_given") != "", F.col("_given")).otherwise(convert_text(synced))).drop("_given")


def pick_labels(lines: DataFrame, keys: list[str], width: float, height: float) -> DataFrame:
    """Title, axis names and caption of every page from its recognised lines.

    ``y`` grows downwards here.  Each label is the best line of a page zone; the
    four picks are aggregates over one pass, so no zone is sorted.
    """
    has = F.col("text").rlike(r"\p{L}")
    n, x, y = F.length("text"), F.col("x_mid"), F.col("y_mid")
    zone = {
        "title": (y <= height * 0.24, F.struct(n.alias("a"), (-y).alias("b"), (-x).alias("c"))),
        "axis_x": (y >= height * 0.72, F.struct((-y).alias("a"), n.alias("b"), (-x).alias("c"))),
        "axis_y": ((x <= width * 0.28) & y.between(height * 0.12, height * 0.84), F.struct((-y).alias("a"), n.alias("b"), (-x).alias("c"))),
        "caption": (y >= height * 0.82, F.struct(n.alias("a"), y.alias("b"), (-x).alias("c"))),
    }
    return lines.groupBy(*keys).agg(
        *[F.coalesce(F.max_by("text", F.when(has & cond, rank)), F.lit("")).alias(name) for name, (cond, rank) in zone.items()]
    )
