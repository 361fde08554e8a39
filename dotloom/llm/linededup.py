"""Line dedup by a deletion-neighbourhood join (operator 5).

Two lines within one edit (a character inserted, deleted or replaced) have a common variant: one loses a
character and equals the other, or both lose the character at one place and are equal.  Every line emits all its
variants as hashed keys, equal keys are joined with the earliest line that has them, the edit distance of these
pairs is verified, and of similar lines the earliest stays.

The neighbourhood of a long line is large, so lines that cannot have a partner are put aside first: within one
edit, all but one of a line's parts agree, counted from the nearer end.  Halves are compared for all lines, sixteenths
for those that are left.  Neither step loses a pair, and no step emits pairs of lines that only share a key: each
line meets the earliest one of its key alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dotloom.llm.common import fresh, only, probably_in, settle, text_of, written
from dotloom.llm.ngramjoin import mixed

#: Shorter lines are kept as they are: one edit makes another word of a word.
MIN_CHARS = 20
PARTS = 16
FLUSH_KEYS = 500_000
U = np.uint64
ODD = 0x9E3779B97F4A7C15
INVERSE = pow(ODD, -1, 2**64)
_powers = [np.ones(1, U), np.ones(1, U)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n of the hash's base and of its inverse."""
    if len(_powers[0]) <= n:
        for k, base in enumerate((ODD, INVERSE)):
            steps = np.full(2 * n + 1, base, U)
            steps[0] = 1
            _powers[k] = np.cumprod(steps)
    return _powers[0], _powers[1]


class Hashed:
    """Hashes of a line's beginnings joined with its ends, each in constant time."""

    def __init__(self, line: str):
        codes = np.frombuffer(line.encode("utf-32-le"), np.uint32).astype(U)
        self.n = len(codes)
        self.up, self.down = powers(self.n)
        self.sums = np.concatenate([np.zeros(1, U), np.cumsum(mixed(codes + U(1)) * self.up[: self.n])])

    def kept(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Of the strings of the ``first`` and the ``last`` so many characters."""
        end = self.sums[self.n] - self.sums[self.n - last]
        return self.sums[first] + end * self.down[self.n - last - first]

    def without_part(self, parts: int) -> np.ndarray:
        """Keys of the line without one of its parts; lines within one edit share one at least.

        Lines of m and of m or m + 1 characters are cut by m, so a line has keys for both roles.
        """
        out = []
        for m in (self.n - 1, self.n):
            cuts = np.arange(parts + 1) * m // parts
            out.append(mixed(self.kept(cuts[:-1], m - cuts[1:]) + mixed(np.arange(parts, dtype=U) + U(m * 64))))
        return np.concatenate(out)

    def variants(self) -> np.ndarray:
        """Of the line, and of the line without each of its characters."""
        at = np.arange(self.n)
        return np.concatenate([self.sums[self.n :], self.kept(at, self.n - 1 - at)])


def keys(lines: DataFrame, parts: int | None) -> DataFrame:
    """(key, place, size, h, c, at) of lines (h, c, at, line).

    With ``parts``, the keys without one part.  Else the variants: ``place`` is that of the missing character, -1
    for the line itself, and ``size`` the variant's length.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flushed() -> pa.RecordBatch:
            take = pa.array(np.repeat(np.array(rows), [len(k) for k in found]))
            columns = [pa.array(np.concatenate(x)) for x in ([k.view(np.int64) for k in found], places, sizes)]
            own = [batch.column(c).take(take) for c in ("h", "c", "at")]
            return pa.RecordBatch.from_arrays([*columns, *own], ["key", "place", "size", "h", "c", "at"])

        only("linededup")
        for batch in batches:
            rows, found, places, sizes, held = [], [], [], [], 0
            for i, line in enumerate(batch.column("line").to_pylist()):
                hashed = Hashed(line)
                k = hashed.without_part(parts) if parts else hashed.variants()
                rows.append(i)
                found.append(k)
                places.append(np.arange(-1, len(k) - 1, dtype=np.int32))
                size = np.full(len(k), hashed.n - 1, np.int32)
                size[0] += 1
                sizes.append(size)
                held += len(k)
                if held >= FLUSH_KEYS:
                    yield flushed()
                    rows, found, places, sizes, held = [], [], [], [], 0
            if rows:
                yield flushed()
        settle()

    at = lines.schema["at"].dataType.simpleString()
    return lines.select("h", "c", "at", "line").mapInArrow(emit, f"key long, place int, size int, h long, c long, at {at}")


def shared(keyed: DataFrame) -> DataFrame:
    """(h, c) of lines that share a key with another line."""
    w = Window.partitionBy("key")
    alike = keyed.select("h", "c", F.min("h").over(w).alias("lo"), F.max("h").over(w).alias("hi"))
    return alike.where("lo < hi").select("h", "c").distinct()


def line_rows(docs: DataFrame, min_chars: int) -> DataFrame:
    """One row for each line of ``min_chars`` or more: its position ``at`` (document, line), hashes h and c, and text."""
    lines = docs.select("doc_id", "text_key", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return lines.where(F.length("line") >= min_chars).select(
        F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("doc"), "text_key", "line_no").alias("at"),
        F.xxhash64("line").alias("h"), F.crc32("line").alias("c"), "line",
    )


def halves(line: Column) -> Column:
    """Keys of both halves of a line, for both of its roles (see ``Hashed.without_part``)."""
    n = F.length(line)
    each = []
    for m in (n - 1, n):
        p = F.floor(m / 2).cast("int")
        each += [F.xxhash64(F.lit(0), m, F.substring(line, F.lit(1), p)), F.xxhash64(F.lit(1), m, F.substring(line, n - p + 1, p))]
    return F.array(*each)


def similar(lines: DataFrame) -> DataFrame:
    """(h, c) of those distinct lines (h, c, at, line) that an earlier one is within one edit of."""
    texts = written(lines.join(shared(keys(lines, PARTS)), ["h", "c"], "left_semi"))
    line = F.struct("at", "h", "c")
    of_place, of_key = Window.partitionBy("key", "size", "place"), Window.partitionBy("key", "size")
    met = (
        keys(texts, None).repartition("key").withColumn("line", line)
        .withColumn("same_place", F.min("line").over(of_place))
        .withColumn("whole", F.min(F.when(F.col("place") < 0, F.col("line"))).over(of_key))
        .withColumn("shortened", F.min(F.when(F.col("place") >= 0, F.col("line"))).over(of_key))
    )
    other = F.when(F.col("place") < 0, F.array("shortened")).otherwise(F.array("same_place", "whole"))
    pairs = met.select("h", "c", "at", F.explode(other).alias("other")).where("other.at < at")
    pairs = pairs.select("h", "c", F.col("other.h").alias("other_h"), F.col("other.c").alias("other_c")).distinct()
    one, two = texts.select("h", "c", "line"), texts.select(F.col("h").alias("other_h"), F.col("c").alias("other_c"), F.col("line").alias("other_line"))
    both = pairs.join(one, ["h", "c"]).join(two, ["other_h", "other_c"])
    return both.where(F.levenshtein("line", "other_line", 1) >= 0).select("h", "c").distinct()


def dedup(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` without lines of which an earlier line, in any document, is a copy or within one edit.

    Adds ``n_lines`` and ``n_removed`` (which replace columns of these names) and shortens ``text``; other columns
    stay.  Earlier is by (doc_id, text, line), null ids last.  A line goes if any earlier line is similar, whether that
    stays or not.  Lines of fewer than ``min_chars`` characters stay.  Rows that repeat both doc_id and text are one
    document and are treated alike.  Null and empty text becomes the empty text.  An empty table stays empty.
    """
    keyed = docs.select("doc_id", text_of().alias("text")).withColumn("text_key", F.xxhash64("text"))
    found = line_rows(keyed, min_chars)
    stored = written(found.select("at", "h", "c", halves(F.col("line")).alias("halves")))
    wanted = written(shared(stored.select("h", "c", F.explode("halves").alias("key"))))
    distinct = stored.groupBy("h", "c").agg(F.min("at").alias("at"), F.count(F.lit(1)).alias("n"))
    # a line's text comes from its first place alone
    firsts = wanted.join(distinct, ["h", "c"]).select("h", "c", "at")
    near_texts = probably_in(found, "h", wanted.select("h")).join(firsts, ["h", "c", "at"], "left_semi").dropDuplicates(["h", "c"])
    near = similar(written(near_texts))
    decided = distinct.join(near.withColumn("near", F.lit(True)), ["h", "c"], "left").where("n > 1 or near")
    gone = (
        stored.select("at", "h", "c").join(decided.select("h", "c", F.col("at").alias("first"), "near"), ["h", "c"])
        .where("near or at <> first")
        .groupBy(F.col("at.doc").alias("doc"), F.col("at.text_key").alias("key")).agg(F.collect_set("at.line_no").alias("gone"))
    )
    lines = F.split("text", "\n")
    doc, key, set_ = (fresh(docs, c) for c in ("_ld_doc", "_ld_key", "_ld_gone"))
    gone = gone.toDF(doc, key, set_)
    gone_lines = F.coalesce(set_, F.array().cast("array<int>"))
    kept = F.filter(lines, lambda _, i: ~F.array_contains(gone_lines, i))
    own = {"text": text_of(), doc: F.coalesce("doc_id", F.lit(2**63 - 1)), key: F.xxhash64(text_of())}
    return (
        docs.withColumns(own).join(gone, [doc, key], "left")
        .withColumns({"n_lines": F.size(lines), "n_removed": F.size(gone_lines), "text": F.array_join(kept, "\n")})
        .drop(doc, key, set_)
    )
