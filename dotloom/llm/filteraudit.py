"""How filters on documents overlap, for every order of applying them (operator 12).

Each document gets one bit for every filter that it fails.  Four of the five look at the document alone.  The fifth,
"the same text as a smaller doc_id", is prepared by a counting Bloom sketch: each task counts, up to two, the places
that its texts' hashes fall on; the merged sketch clears every text that has a place to itself, since that text is
certainly unique.  Only the rest, possible repeats, are exchanged whole and grouped by their full text for the least
doc_id.  Flags and labels meet by doc_id, masks are counted by part, and the audit of all orders is a sum over those
counts: how many documents a filter removes at a step depends on the masks alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import permutations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dotloom.llm.common import ship, text_of, written

FILTERS = "ABCDE"
#: Counters for each document, within the bounds below; a merged sketch has a quarter of a byte for each.
COUNTERS, FEWEST, MOST = 8, 1 << 16, 1 << 27
#: Places of a text, taken from its hash by odd multipliers.
MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
SLICE = 1 << 16


def own_failures(text: Column) -> Column:
    """Bits of the filters A to D that a text fails."""
    words = F.array_remove(F.split(text, "[\\x20\\x09-\\x0D]+"), "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    tests = [n < 100, 100 * distinct < 80 * n, 100 * capitals > 10 * F.length(text), text.rlike("[#$%&*|]")]
    return sum((t.cast("int") * (1 << i) for i, t in enumerate(tests)), F.lit(0))


def places(hashes: np.ndarray, counters: int) -> np.ndarray:
    """The places of each hash, one row for each multiplier; ``counters`` is a power of two."""
    shift = np.uint64(64 - (counters.bit_length() - 1))
    return (hashes.view(np.uint64)[None, :] * MULTIPLIERS[:, None]) >> shift


def sketch(hashes: DataFrame, counters: int) -> np.ndarray:
    """Merged counting sketch of the long column ``h``: two bits a counter, 0, 1, or 2 for more.

    Tasks send the places they counted, 2 bytes each, in slices of SLICE counters, so a text that a task holds a
    million times sends no more than one it holds twice.  The driver gets counters / 4 bytes, at most MOST / 4.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        pending: list[np.ndarray] = []

        def fold() -> None:
            nonlocal once, twice
            found, n = np.unique(np.concatenate([once, twice, twice, *pending]), return_counts=True)
            once, twice = found[n == 1], found[n > 1]
            pending.clear()

        for batch in batches:
            h = batch.column("h").to_numpy()
            # places of one text that coincide count once
            p = np.sort(places(h, counters), axis=0)
            fresh = np.ones(p.shape, bool)
            fresh[1:] = p[1:] != p[:-1]
            pending.append(p[fresh])
            if sum(map(len, pending)) > 1 << 20:
                fold()
        fold()
        for times, own in ((1, once), (2, twice)):
            number, start = np.unique(own // SLICE, return_index=True)
            offsets = (own % SLICE).astype(np.uint16)
            rows = [(int(s), times, o.tobytes()) for s, o in zip(number, np.split(offsets, start[1:]))] if len(own) else []
            yield pa.RecordBatch.from_pylist([dict(zip(("slice", "times", "offsets"), r)) for r in rows], schema=sent)

    def merged(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(min(SLICE, counters), np.uint8)
        for batch in batches:
            for times, offsets in zip(batch.column("times").to_pylist(), batch.column("offsets").to_pylist()):
                own = np.frombuffer(offsets, np.uint16)  # each offset once
                total[own] = np.minimum(total[own] + times, 2)
        packed = total[0::4] | total[1::4] << 2 | total[2::4] << 4 | total[3::4] << 6
        yield pa.RecordBatch.from_pylist([{"slice": key[0].as_py(), "counters": packed.tobytes()}], schema=kept)

    sent = pa.schema([("slice", pa.int64()), ("times", pa.int32()), ("offsets", pa.binary())])
    kept = pa.schema([("slice", pa.int64()), ("counters", pa.binary())])
    parts = hashes.select("h").mapInArrow(counted, "slice long, times int, offsets binary")
    slices = parts.groupBy("slice").applyInArrow(merged, "slice long, counters binary").toArrow()
    out = np.zeros(counters // 4, np.uint8)
    for number, own in zip(slices.column("slice").to_pylist(), slices.column("counters").to_pylist()):
        out[number * SLICE // 4 :][: len(own)] = np.frombuffer(own, np.uint8)
    return out


def maybe_repeated(merged: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """False for a hash that has a place to itself."""
    p = places(hashes, len(merged) * 4)
    count = merged[p >> np.uint64(2)] >> ((p & np.uint64(3)) << np.uint64(1)).astype(np.uint8) & 3
    return (count > 1).all(axis=0)


def possible_repeats(slim: DataFrame) -> Callable[[str], Column]:
    """Test of a hash column: false only where no other row of ``slim`` has the same ``h``."""
    spark, n = slim.sparkSession, slim.count()
    merged = spark.sparkContext.broadcast(sketch(slim, min(max(1 << (COUNTERS * n).bit_length(), FEWEST), MOST)))

    @F.pandas_udf("boolean")
    def possible(h: pd.Series) -> pd.Series:
        return pd.Series(maybe_repeated(merged.value, h.to_numpy(np.int64)))

    return possible


def first_ids(docs: DataFrame, possible: Callable[[str], Column]) -> DataFrame:
    """doc_id and hashes of the first document of every text that may repeat."""
    texts = docs.where("doc_id is not null").select("doc_id", text_of().alias("text")).withColumn("h", F.xxhash64("text"))
    firsts = texts.where(possible("h")).groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.first("h").alias("h"))
    return firsts.select("doc_id", "h", F.hash("text").alias("h2"), F.lit(True).alias("first"))


def flagged(docs: DataFrame) -> DataFrame:
    """doc_id, part and ``mask`` (bit k: the document fails the k-th of FILTERS) of every row of ``docs``.

    Null text is empty, a null language is the part "".  E compares doc_ids, so a row without one never fails it and
    fails no other; rows with the same doc_id and text are alike.  Extra columns aren't looked at.
    """
    ship(docs.sparkSession)
    text = text_of()
    slim = written(
        docs.select(
            "doc_id", F.coalesce("lang", F.lit("")).alias("part"), own_failures(text).alias("own"),
            F.xxhash64(text).alias("h"), F.hash(text).alias("h2"),
        )
    )
    possible = possible_repeats(slim)
    met = slim.join(first_ids(docs, possible), ["doc_id", "h", "h2"], "left")
    repeated = possible("h") & F.col("first").isNull() & F.col("doc_id").isNotNull()
    return met.select("doc_id", "part", (F.col("own") + F.when(repeated, 16).otherwise(0)).alias("mask"))


def mask_counts(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (n), good ones and toxic ones for each part and mask; a document is either if any of its labels says so."""
    known = labels.groupBy("doc_id").agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).cast("long").alias("good"),
        F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).cast("long").alias("bad"),
    )
    met = masks.join(known, "doc_id", "left")
    return met.groupBy("part", "mask").agg(
        F.count("*").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")
    )


def audit(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """One row for each part, order of the filters and step, from additive counts of masks.

    ``counts`` has part, mask, n, good and bad.  shapley is summed over all orders: of c failing filters each comes
    first in 1/c of them.
    """
    orders = ["".join(p) for p in permutations(filters)]
    bit_of = lambda step: F.expr(f"shiftleft(1, instr('{filters}', substr(filter_order, {step}, 1)) - 1)")
    steps = (
        counts.withColumn("filter_order", F.explode(F.array(*map(F.lit, orders))))
        .withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(filters)))))
        .withColumn("bit", bit_of("step"))
        .withColumn("before", sum((F.when(F.col("step") > k, bit_of(k)).otherwise(0) for k in range(1, len(filters))), F.lit(0)))
    )
    mask = F.col("mask")
    own, earlier = mask.bitwiseAND(F.col("bit")) != 0, mask.bitwiseAND(F.col("before")) != 0
    removed = own & ~earlier
    total = lambda test, x="n": F.coalesce(F.sum(F.when(test, F.col(x))), F.lit(0)).cast("long")
    share = F.col("n") * F.lit(len(orders)) / F.greatest(F.bit_count(mask), F.lit(1))
    return steps.groupBy("part", "filter_order", "step").agg(
        total(~own & ~earlier).alias("kept"), total(removed).alias("removed"), total(own & earlier).alias("redundant"),
        total(mask == F.col("bit")).alias("unique_fails"), total(removed, "good").alias("good_lost"),
        total(removed, "bad").alias("toxic_lost"), F.coalesce(F.sum(F.when(own, share.cast("long"))), F.lit(0)).alias("shapley"),
    )
