"""Packed id matrices by best-fit decreasing (operator 4).

Every task tokenises its documents and packs them block by block: segments in order of falling length, each into
the fullest row that still takes it.  A segment tree over the remaining capacities finds that row in
O(log row length).  Documents longer than a row are cut into full rows and a rest, losing nothing.

Nothing is shuffled.  A block holds ``BLOCK_TOKENS`` at most (or one document), and wastes less than a few rows.
A repeated task packs the same rows again, since a split of the input always has the same documents in order.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dotloom.llm import pretokens as pre
from dotloom.llm.tokencount import ranks

ROW_TOKENS = 2048
BLOCK_TOKENS = 2_000_000
CACHE_CHUNKS = 400_000

SCHEMA = """
  pack_id long, n_tokens int, ids binary, positions binary, cu_seqlens array<int>, doc_ids array<long>, offsets array<int>
"""


class CapacityTree:
    """Counts of rows by remaining capacity, in a segment tree."""

    def __init__(self, most: int):
        self.size = 1 << most.bit_length()
        self.count = [0] * (2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(most + 1)]

    def add(self, capacity: int, row: int) -> None:
        self.rows[capacity].append(row)
        i = capacity + self.size
        while i:
            self.count[i] += 1
            i >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """Removes a row of the least capacity that is at least ``need``: (capacity, row)."""
        i, count = need + self.size, self.count
        if not count[i]:
            while i > 1 and (i & 1 or not count[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
        while i < self.size:
            i = 2 * i if count[2 * i] else 2 * i + 1
        capacity = i - self.size
        row = self.rows[capacity].pop()
        while i:
            count[i] -= 1
            i >>= 1
        return capacity, row


def best_fit_decreasing(lengths: list[int], most: int) -> list[list[int]]:
    """Rows as lists of indices into ``lengths`` (each 1 to ``most``); ties go in the given order."""
    tree, rows = CapacityTree(most), []
    for k in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        found = tree.take(lengths[k])
        if found is None:
            capacity, row = most, len(rows)
            rows.append([])
        else:
            capacity, row = found
        rows[row].append(k)
        if capacity > lengths[k]:
            tree.add(capacity - lengths[k], row)
    return rows


class ChunkIds:
    """Ids of the chunks met so far, up to a bounded number.  Special strings in a text are ordinary text."""

    def __init__(self, merges: str):
        self.encoding, self.first, self.later = ranks(merges), {}, {}

    def encode(self, text: str) -> bytes:
        if len(self.later) > CACHE_CHUNKS or len(self.first) > CACHE_CHUNKS:
            self.first.clear()
            self.later.clear()
        head, *rest = pre.chunks(text)
        return b"".join([self._of(self.first, head, "") if head else b"", *[self._of(self.later, c, " ") for c in rest]])

    def _of(self, known: dict[str, bytes], chunk: str, lead: str) -> bytes:
        ids = known.get(chunk)
        if ids is None:
            ids = array("i", self.encoding.encode_ordinary(lead + chunk)).tobytes()
            if len(chunk) <= pre.CACHED_CHARS:
                known[chunk] = ids
        return ids


@lru_cache(maxsize=2)
def chunk_ids(merges: str) -> ChunkIds:
    return ChunkIds(merges)


def packed_block(docs: list[tuple[int | None, np.ndarray]], row_tokens: int, pad: int, kind: str) -> list[tuple]:
    """Rows of a block of (doc_id, ids)."""
    segments = [(d, at) for d, (_, ids) in enumerate(docs) for at in range(0, len(ids), row_tokens)]
    lengths = [min(row_tokens, len(docs[d][1]) - at) for d, at in segments]
    out = []
    for row in best_fit_decreasing(lengths, row_tokens):
        ids, positions = np.full(row_tokens, pad, kind), np.zeros(row_tokens, kind)
        ends = [0]
        for k in row:
            d, at = segments[k]
            a, b = ends[-1], ends[-1] + lengths[k]
            ids[a:b] = docs[d][1][at : at + lengths[k]]
            positions[a:b] = np.arange(lengths[k])
            ends.append(b)
        out.append((ends[-1], ids.tobytes(), positions.tobytes(), ends, [docs[segments[k][0]][0] for k in row], [segments[k][1] for k in row]))
    return out


def pack(docs: DataFrame, row_tokens: int = ROW_TOKENS, merges: str | None = None, eos: int = 50256) -> DataFrame:
    """Matrices of packed ids: one row of the result for each row of ``row_tokens`` ids.

    ``ids`` and ``positions`` are little-endian (two bytes an entry if ids and positions fit, else four), filled up
    with ``eos`` and 0.  ``positions`` begin anew with every segment; ``cu_seqlens`` has the segments' ends, from 0.
    ``doc_ids`` and ``offsets`` tell each segment's document and where in its ids the segment begins.
    A document's ids end with ``eos``.  Null and empty texts have no ids and no segment.  Repeated rows are packed as
    often as they come, null ids are kept, extra columns are not looked at, and an empty table gives no rows.
    """
    where = merges or public_tokenizers.path("byte_bpe_50k.tiktoken")
    kind = "<u2" if row_tokens <= 65536 and max(eos, ranks(where).max_token_value) < 65536 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, first = chunk_ids(where), TaskContext.get().partitionId() << 33
        end = array("i", [eos]).tobytes()
        block: list[tuple[int | None, np.ndarray]] = []
        held = made = 0

        def packed() -> pa.RecordBatch:
            nonlocal block, held, made
            rows = packed_block(block, row_tokens, eos, kind)
            ids = pa.array(range(first + made, first + made + len(rows)), pa.int64())
            made += len(rows)
            block, held = [], 0
            types = [pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32())]
            columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
            return pa.RecordBatch.from_arrays([ids, *columns], ["pack_id", "n_tokens", "ids", "positions", "cu_seqlens", "doc_ids", "offsets"])

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                if not text:
                    continue
                ids = np.frombuffer(encoder.encode(text) + end, np.int32)
                if held and held + len(ids) > BLOCK_TOKENS:
                    yield packed()
                block.append((doc_id, ids))
                held += len(ids)
        if block:
            yield packed()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def write_matrices(packed: DataFrame, path: str) -> None:
    """Writes packed rows as Parquet: ids and positions as fixed-length binary, beside their segment tables."""
    packed.write.mode("overwrite").parquet(path)
