"""Exact top-k inner products over a bit-sliced index (operator 9).

Vectors are turned into integers.  A block of rows is indexed by bit slices: one bitmap for every bit of every
attribute, quantised by leaving out its ``DROPPED`` lowest bits.  A query multiplies each attribute by its own value:
with the value written as a sum of signed powers of two, the product is the attribute's slices at other weights.
Carry-save adders over bitmaps, three of one weight into one of the same and one of the next, reduce all of them to
the slices of the approximate score, and the k best rows are selected from the most significant slice downward.
A row can beat them exactly only if its approximate score is within a bound that the left-out bits give; those
boundary rows are few, and their exact scores decide.

Blocks of rows meet blocks of queries by an equi-join of block numbers; each pair of blocks returns k rows a query.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS = 65_536  # candidates in a block, about
QUERIES = 2_048  # queries in a block, about
DROPPED = 3
ONE = np.uint64(1)


def integers(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of every component; null if the vector or a component is null or not finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.when(finite, F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long")))


def digits(value: int) -> list[tuple[int, int]]:
    """A number as a sum of signed powers of two, no two of them adjacent: (exponent, sign)."""
    out, power, rest, sign = [], 0, abs(value), 1 if value >= 0 else -1
    while rest:
        if rest & 1:
            d = 2 - (rest & 3)
            out.append((power, d * sign))
            rest -= d
        rest >>= 1
        power += 1
    return out


class Index:
    """Bit slices of a block of integer vectors (rows x attributes)."""

    def __init__(self, values: np.ndarray):
        self.values = values
        self.n = len(values)
        self.coarse = values >> DROPPED
        self.low = self.coarse.min(axis=0)  # slices are of coarse - low, so they have no sign
        words = -(-self.n // 64)
        self.slices: list[list[np.ndarray]] = []
        for column in (self.coarse - self.low).T:
            own = []
            for j in range(int(column.max()).bit_length()):
                packed = np.zeros(words * 8, np.uint8)
                bits = np.packbits(((column >> j) & 1).astype(np.uint8), bitorder="little")
                packed[: len(bits)] = bits
                own.append(packed.view(np.uint64))
            self.slices.append(own)
        self.every = np.full(words, ~np.uint64(0))
        if self.n % 64:
            self.every[-1] = (ONE << np.uint64(self.n % 64)) - ONE

    def sums(self, query: np.ndarray) -> list[np.ndarray]:
        """Slices, least significant first, of a number that orders the rows by query * coarse.

        Negative products are added as complements: one constant for all rows, which doesn't change the order.
        """
        columns: dict[int, list[np.ndarray]] = {}
        for value, slices in zip(query.tolist(), self.slices):
            for power, sign in digits(value):
                for j, bits in enumerate(slices):
                    columns.setdefault(power + j, []).append(bits if sign > 0 else bits ^ self.every)
        out, weight, top = [], 0, max(columns, default=-1)
        while weight <= top:
            own = columns.pop(weight, [])
            upper = columns.setdefault(weight + 1, [])
            while len(own) > 2:
                a, b, c = own.pop(), own.pop(), own.pop()
                half = a ^ b
                upper.append((a & b) | (half & c))
                own.append(half ^ c)
            if len(own) == 2:
                a, b = own
                upper.append(a & b)
                own = [a ^ b]
            out.append(own[0] if own else np.zeros_like(self.every))
            weight += 1
            if upper:
                top = max(top, weight)
        return out

    def best(self, slices: list[np.ndarray], k: int, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows surely among the k greatest, and rows equal to the k-th, from the most significant slice downward."""
        sure, equal, need = np.zeros_like(among), among, k
        for bits in reversed(slices):
            ones = equal & bits
            count = int(np.bitwise_count(ones).sum())
            if count >= need:
                equal = ones
            else:
                sure, equal, need = sure | ones, equal & ~bits, need - count
        return sure, equal

    def rows(self, bitmap: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little")[: self.n])

    def at_least(self, slices: list[np.ndarray], value: int) -> np.ndarray:
        """Rows whose number is ``value`` or more."""
        if value <= 0:
            return self.every
        if value >= 1 << len(slices):
            return np.zeros_like(self.every)
        above, equal = np.zeros_like(self.every), self.every
        for j in range(len(slices) - 1, -1, -1):
            if value >> j & 1:
                equal = equal & slices[j]
            else:
                above, equal = above | (equal & slices[j]), equal & ~slices[j]
        return above | equal

    def top(self, query: np.ndarray, k: int, ids: np.ndarray, own: int) -> list[tuple[int, int]]:
        """The k best (score, id) other than ``own``, ties to smaller ids."""
        others = self.every
        mine = np.flatnonzero(ids == own)
        if len(mine):
            flags = np.zeros(len(self.every) * 64, np.uint8)
            flags[mine] = 1
            others = self.every & ~np.packbits(flags, bitorder="little").view(np.uint64)
        slices = self.sums(query)
        sure, equal = self.best(slices, k, others)
        some = self.rows(sure | equal)
        if not len(some):
            return []
        # query * value = 2^DROPPED * query * coarse + query * left-out bits, and these are 0 to 2^DROPPED - 1
        least_rows = self.rows(equal)[:1] if equal.any() else some
        worst = min(sum(int(s[r >> 6] >> np.uint64(r & 63) & ONE) << j for j, s in enumerate(slices)) for r in least_rows.tolist())
        room = int(np.abs(query).sum()) * ((1 << DROPPED) - 1)
        candidates = self.rows(self.at_least(slices, worst - -(-room >> DROPPED) - 1) & others)
        scores = self.values[candidates] @ query
        order = np.lexsort((ids[candidates], -scores))[:k]
        return [(int(scores[i]), int(ids[candidates[i]])) for i in order]


def search_block(rows: pa.Table, queries: pa.Table, k: int) -> pa.Table:
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
    if not len(rows) or not len(queries):
        return schema.empty_table()
    vectors, asked = rows.column("v").to_pylist(), queries.column("v").to_pylist()
    wide = max(map(len, [*vectors, *asked]))
    values = np.array([v + [0] * (wide - len(v)) for v in vectors], np.int64).reshape(-1, wide)
    ids = rows.column("vec_id").to_numpy()
    index, out = Index(values), []
    for own, q in zip(queries.column("vec_id").to_pylist(), asked):
        found = index.top(np.array(q + [0] * (wide - len(q)), np.int64), k, ids, own)
        out += [(own, i, s) for s, i in found]
    return pa.Table.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(3)], schema=schema)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k rows of ``vectors`` with the greatest inner product.

    Both tables have ``vec_id`` and an integer array ``v``; rows where either is null take no part.  A row whose
    vec_id is the query's is never returned; ties go to the smaller vec_id.  Missing components are 0.  A repeated
    vec_id among the candidates competes with each of its rows, a repeated query is answered once.  Scores must fit
    into 64 bits.  Extra columns are not looked at.
    """
    rows = vectors.where("v is not null and vec_id is not null").select("vec_id", "v")
    asked = queries.where("v is not null and vec_id is not null").select("vec_id", "v").dropDuplicates(["vec_id"])
    n_rows, n_asked = rows.count(), asked.count()
    r, c = -(-n_rows // ROWS) or 1, -(-n_asked // QUERIES) or 1
    numbers = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    row_blocks = rows.withColumn("r", F.pmod(F.monotonically_increasing_id(), F.lit(r))).withColumn("c", numbers(c))
    asked_blocks = asked.withColumn("c", F.pmod(F.xxhash64("vec_id"), F.lit(c))).withColumn("r", numbers(r))
    found = (
        row_blocks.groupBy("r", "c").cogroup(asked_blocks.groupBy("r", "c"))
        .applyInArrow(lambda a, b: search_block(a, b, k), "query_id long, vec_id long, score long")
    )
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", best).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
