"""Mixing sources to target weights by iterative proportional fitting (operator 8, built-in functions only).

Token weights are summed for each cell of source, language and topic.  Raking multiplies the cells, one attribute
after the other, so that its sums meet their targets, until nothing moves.  A cell's fitted weight against its
observed one calibrates the probability with which its documents are sampled.

Documents are aggregated once and joined with the cells once; the fitting moves only cells.  A cell never gets
more than what keeping all its documents gives (the bound is part of the fitting), so probabilities stay below 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dotloom.llm.common import fresh, text_of, written

DIMENSIONS = ("source", "lang", "topic")
KEEP = 0.5  # share of all tokens that the sample aims at
TEMPER = 0.7  # targets are corpus shares to this power
TOLERANCE = 1e-4
ROUNDS = 40
#: What counts as a token: shares of languages by it are within a hundredth of those by real tokens on the given tables.
PIECES = r"[A-Za-z]{1,3}|[0-9]{1,3}|[^\sA-Za-z0-9]"


def topic(text: Column) -> Column:
    """What kind of text a document is, by marks that it holds."""
    bars = F.length(text) - F.length(F.replace(text, F.lit("|"), F.lit("")))
    return (
        F.when(F.trim(text) == "", "empty")
        .when(text.contains("License"), "licence")
        .when(bars >= 5, "table")
        .when(text.rlike(r"[#*$%&]{3}"), "noise")
        .when(text.rlike(r"\d[\d.\- ]{6,}\d"), "numbers")
        .otherwise("prose")
    )


def described(docs: DataFrame) -> DataFrame:
    """``docs`` with topic and n_tokens (about the tokens of byte-level BPE), as the default dimensions and weight.

    They replace columns of these names.  Null and empty texts are of the topic "empty" and have no tokens; a text
    without spaces has tokens by its length.  Rows that repeat are alike, and an empty table stays empty.
    """
    return docs.withColumns({"topic": topic(text_of()), "n_tokens": F.regexp_count(text_of(), F.lit(PIECES)).cast("long")})


def tempered_targets(cells: DataFrame, dimensions: tuple[str, ...], temper: float) -> dict[str, DataFrame]:
    """For each dimension (value, share): the observed shares to a power, scaled to sum to 1."""
    out = {}
    for d in dimensions:
        sums = cells.where("observed > 0").groupBy(d).agg(F.pow(F.sum("observed"), F.lit(temper)).alias("share"))
        whole = sums.agg(F.sum("share")).first()[0] or 1.0
        out[d] = sums.withColumn("share", F.col("share") / whole)
    return out


def rake(cells: DataFrame, targets: dict[str, DataFrame], keep: float = KEEP, tolerance: float = TOLERANCE, rounds: int = ROUNDS) -> DataFrame:
    """``cells`` (dimensions, observed) with ``fitted``: sums over each dimension meet its target shares.

    ``targets`` has a table (value, share) for each dimension.  A value without a target keeps no weight.  If
    targets cannot all be met, as with the bound fitted <= observed / keep, the last round's weights are returned.
    """
    total = float(cells.agg(F.sum("observed")).first()[0] or 0)
    fitted = cells
    for d, t in targets.items():
        fitted = fitted.join(t.withColumnRenamed("share", f"share_{d}"), d, "left").na.fill(0.0, [f"share_{d}"])
    fitted = written(fitted.withColumn("fitted", F.col("observed").cast("double")))
    bound = F.col("observed") / keep
    for _ in range(rounds if total else 0):
        step = fitted.withColumn("before", F.col("fitted"))
        for d in targets:
            have = F.sum("fitted").over(Window.partitionBy(d))
            wanted = F.when(have > 0, F.col("fitted") * F.col(f"share_{d}") * total / have).otherwise(0.0)
            step = step.withColumn("fitted", F.least(wanted, bound))
        step = written(step.withColumn("moved", F.abs(F.col("fitted") / F.greatest("before", F.lit(1e-12)) - 1)))
        fitted = step.drop("before", "moved")
        if step.agg(F.max("moved")).first()[0] < tolerance:
            break
    return fitted.select(*targets, "observed", "fitted")


def gaps(fitted: DataFrame, targets: dict[str, DataFrame]) -> DataFrame:
    """(dimension, value, target, share): what share of the fitted weight each value has, beside its target."""
    total = F.lit(float(fitted.agg(F.sum("fitted")).first()[0] or 0))
    out = None
    for d, t in targets.items():
        sums = fitted.groupBy(d).agg(F.try_divide(F.sum("fitted"), total).alias("got"))
        one = sums.join(t, d, "left").select(F.lit(d).alias("dimension"), F.col(d).alias("value"), F.col("share").alias("target"), F.col("got").alias("share"))
        out = one if out is None else out.unionByName(one)
    return out


def mixed_sample(docs: DataFrame, dimensions: tuple[str, ...] = DIMENSIONS, keep: float = KEEP, temper: float = TEMPER) -> DataFrame:
    """Rows of ``docs`` sampled so that token weights meet the targets, with ``ratio`` and ``probability``.

    ``docs`` has the dimensions and ``n_tokens``; a null dimension is a value of its own.  Documents of a cell without
    tokens are sampled with probability ``keep``.  The choice hashes doc_id and text, so it is repeatable, and repeated
    rows are kept or left together.  Other columns stay; an empty table stays empty.
    """
    names = {d: fresh(docs, f"_{d}") for d in dimensions}
    marked = docs.withColumns({n: F.coalesce(F.concat(F.lit("="), F.col(d).cast("string")), F.lit("")) for d, n in names.items()})
    own = tuple(names.values())
    cells = written(marked.groupBy(*own).agg(F.sum("n_tokens").alias("observed")).na.fill(0, ["observed"]))
    fitted = rake(cells, tempered_targets(cells, own, temper), keep)
    ratio = F.when(F.col("observed") > 0, F.col("fitted") / F.col("observed")).otherwise(1.0)
    weights = fitted.select(*own, ratio.alias("ratio"), F.least(F.lit(1.0), keep * ratio).alias("probability"))
    chance = F.pmod(F.xxhash64("doc_id", "text", F.lit("mix")), F.lit(1 << 53)) / float(1 << 53)
    return marked.drop("ratio", "probability").join(weights, list(own)).where(chance < F.col("probability")).drop(*own)
