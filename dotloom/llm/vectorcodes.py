"""Product codes of vectors with exact integer k-means (operator 11).

Components become integers and every vector is cut into equal consecutive parts, each with a codebook of its own.  The
nearest entry is found by matrix products in float64 that are exact: integers are broken into limbs so short that a
product of limbs, summed over a part, stays below 2^53; the limb products are recombined in int64, where the squared
distance is formed, and the first least one wins.  A round sums parts and counts for each entry inside the task, adds
them up by (part, entry, position), and the new entries are floors of integer quotients, so the result does not depend
on how rows are dealt to tasks.

Integers are written once to the shared folder; the six passes over them read that table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dotloom.llm.common import ship, written

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Rows of one matrix product.
ROWS = 4096
#: Squared lengths below this keep every squared distance inside int64.
LONGEST = float(1 << 60)
#: A label of at least one row in so many is joined by broadcast; there can't be more of them.
HOT = 1000


def integers(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of every component.

    Null where the vector is null, holds a null or non-finite component, or is so long that squared distances to it
    would not fit into 64 bits.
    """
    scaled = F.transform(vector, lambda x: F.floor(x.cast("double") * scale))
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * scale) < F.lit(float(1 << 62))))
    square = F.aggregate(vector, F.lit(0.0), lambda s, x: s + F.pow(x.cast("double") * scale, 2))
    return F.when(finite & (square < LONGEST), scaled)


def limb_bits(width: int) -> int:
    """Bits of a limb, so that ``width`` products of two limbs stay below 2^53."""
    return (52 - max(width - 1, 0).bit_length()) // 2


def limbs(values: np.ndarray, bits: int) -> list[np.ndarray]:
    """``values`` as a sum of float64 matrices times powers of 2^bits; all but the last are in 0 .. 2^bits - 1."""
    out, rest = [], values
    while len(rest) and (rest.max(initial=0) >= 1 << bits or rest.min(initial=0) < -(1 << bits)):
        out.append((rest & ((1 << bits) - 1)).astype(np.float64))
        rest = rest >> bits
    return [*out, rest.astype(np.float64)]


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact a @ b.T of integer matrices whose products fit into int64."""
    bits = limb_bits(a.shape[1])
    total = np.zeros((len(a), len(b)), np.int64)
    for i, x in enumerate(limbs(a, bits)):
        for j, y in enumerate(limbs(b, bits)):
            total += (x @ y.T).astype(np.int64) << (bits * (i + j))  # carries beyond 2^63 cancel out
    return total


def nearest(values: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry of ``book`` for each row, the lowest of equals, and its squared distance."""
    gap = (book * book).sum(axis=1)[None, :] - 2 * products(values, book)
    index = gap.argmin(axis=1)
    return index, gap[np.arange(len(values)), index] + (values * values).sum(axis=1)


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list column as rows of ``width`` integers; missing components are 0."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False)
    if (lengths == width).all():
        return flat.reshape(len(column), width)
    out = np.zeros((len(column), width), np.int64)
    out[np.repeat(np.arange(len(column)), lengths), np.concatenate([np.arange(n) for n in lengths] or [lengths])] = flat
    return out


def _blocks(batches: Iterator[pa.RecordBatch], parts: int, width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of the batches and their vectors as rows x parts x width."""
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            piece = batch.slice(start, ROWS)
            yield piece, matrix(piece.column("v"), parts * width).reshape(piece.num_rows, parts, width)


def _sums(books: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
        for _, values in _blocks(batches, parts, width):
            for p in range(parts):
                index, _ = nearest(values[:, p], books[p])
                order = np.argsort(index, kind="stable")
                used, first = np.unique(index[order], return_index=True)
                total[p, used] += np.add.reduceat(values[order, p], first, axis=0)
                count[p] += np.bincount(index, minlength=entries)
        part, entry = np.nonzero(count)
        rows = [(part * entries + entry).repeat(width + 1), np.tile(np.arange(width + 1), len(part))]
        values = np.concatenate([total[part, entry], count[part, entry][:, None]], axis=1).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (*rows, values)], ["entry", "place", "n"])

    return run


def _codes(books: np.ndarray, schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    parts, _, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, values in _blocks(batches, parts, width):
            found = [nearest(values[:, p], books[p]) for p in range(parts)]
            code = ["".join(f"{i:02x}" for i in row) for row in np.stack([i for i, _ in found], axis=1).tolist()]
            error = np.sum([d for _, d in found], axis=0)
            yield pa.RecordBatch.from_arrays(
                [piece.column("vec_id"), piece.column("label"), pa.array(code, pa.string()), pa.array(error, pa.int64())], schema=schema
            )

    return run


def train(kept: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (parts x entries x width) after ``rounds`` rounds over the integer vectors ``v`` of ``kept``.

    The driver holds ``entries`` vectors and as many sums, whatever the number of rows.  A table of fewer vectors than
    ``entries`` has that many entries; one without vectors has none.
    """
    ship(kept.sparkSession)
    size = kept.agg(F.max(F.size("v"))).first()[0]
    width = -(-(size or 0) // parts)
    head = kept.orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).select("v").toArrow().column("v").combine_chunks()
    books = matrix(head, parts * width).reshape(len(head), parts, width).transpose(1, 0, 2).copy()
    entries = books.shape[1]
    if not entries or not width:
        return books
    for _ in range(rounds):
        sums = kept.select("v").mapInArrow(_sums(books), "entry long, place long, n long")
        sums = sums.groupBy("entry", "place").agg(F.sum("n").alias("n")).toArrow()
        entry, place, n = (sums.column(c).to_numpy() for c in ("entry", "place", "n"))
        table = np.zeros((parts * entries, width + 1), np.int64)
        table[entry, place] = n
        used = table[:, width] > 0
        books.reshape(-1, width)[used] = table[used, :width] // table[used, width:]
    return books


def encode(kept: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, label, code (two hex digits a part) and error (squared distance) of every row of ``kept``."""
    ship(kept.sparkSession)
    if not books.size:
        zeros = F.lit("00" * books.shape[0])
        return kept.select("vec_id", "label", zeros.alias("code"), F.lit(0).cast("long").alias("error"))
    label = kept.schema["label"].dataType.simpleString()
    rows = kept.select("vec_id", F.col("label").cast("string").alias("label"), "v")
    schema = pa.schema([("vec_id", pa.int64()), ("label", pa.string()), ("code", pa.string()), ("error", pa.int64())])
    coded = rows.mapInArrow(_codes(books, schema), "vec_id long, label string, code string, error long")
    return coded.withColumn("label", F.col("label").cast(label))


def label_totals(coded: DataFrame) -> DataFrame:
    """``coded`` with label_error: the sum of ``error`` over all rows of the same label, nulls together.

    Labels are added up before any exchange.  Those of at least one row in HOT, HOT of them at most, come by broadcast,
    so only rows of rare labels are dealt by label.
    """
    exact = F.sum(F.col("error").cast("decimal(38,0)"))
    totals = written(coded.groupBy("label").agg(exact.try_cast("long").alias("label_error"), F.count("*").alias("n")))
    limit = (totals.agg(F.sum("n")).first()[0] or 0) / HOT
    hot = totals.where(F.col("n") >= limit).select(F.col("label").alias("l"), "label_error", F.lit(True).alias("hot"))
    rare = totals.where(F.col("n") < limit).select(F.col("label").alias("l"), "label_error")
    rows = coded.join(F.broadcast(hot), F.col("label").eqNullSafe(F.col("l")), "left").drop("l")
    first = rows.where("hot").drop("hot")
    rest = rows.where("hot is null").drop("hot", "label_error")
    return first.unionByName(rest.join(rare, F.col("label").eqNullSafe(F.col("l"))).drop("l"))


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """Codes of ``vectors`` (vec_id, embedding, label) and the codebooks they refer to.

    Rows whose vector is null, holds a null or non-finite component or is too long for 64-bit squares take no part.
    A vector shorter than the longest, or whose length isn't a multiple of ``parts``, goes on with zeros; an empty
    vector is all zeros.  The first entries are the vectors of the smallest vec_ids, null ids last, equal ids by their
    vectors.  Repeated rows each have a row and each count.  An empty table gives no rows and empty codebooks.  Other
    columns are not looked at, whatever their names.
    """
    v = integers(F.col("embedding"))
    kept = written(vectors.select("vec_id", "label", v.alias("v")).where("v is not null"))
    books = train(kept, parts, entries, rounds)
    return label_totals(written(encode(kept, books))), books


def digest(books: np.ndarray) -> str:
    """SHA-256 of the decimal components of all entries, by part, entry and position."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
