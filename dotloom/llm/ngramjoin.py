"""N-gram Jaccard join by PartEnum signatures (operator 7).

Documents with equal sets of word shingles are one node.  Two nodes of sizes a <= b can only link if b <= a / t for
the threshold t, so sizes fall into bands, and a set signs for its own band and for the next.  Sets of a band that
link differ in at most k shingles.  The shingle domain is cut into n1 partitions by hash: in at least one of them
the sets differ in at most k2 = k // n1 shingles, so that of its n2 cells some n2 - k2 agree.  A signature is the hash of
what the set has in one such subset of cells; all subsets are enumerated, and sets that link share a signature.

Nodes that share signatures, directly or through others, are a cluster; only its members can link.  Clusters, or their
groups where these are less to copy, are met in blocks of bounded size: a member is copied to the blocks it meets, pairs
of members are never rows.  They meet twice.  First with counts of their shingles by bin, which are short and differ by no
more than the sets do; members that may still link make new, smaller clusters.  These are verified exactly, with
all shingles.  A block returns links that connect what is connected in it, at most one less than its members.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations
from math import exp, sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dotloom.llm.common import fresh, only, probably_in, remembers, settle, text_of, written
from dotloom.llm.components import components

U = np.uint64
CACHE_WORDS = 100_000
BLOCK = 512  # nodes in a block of a unit, about
FEWEST_BINS, MOST_BINS = 64, 4096  # of a set's counts; between them, an eighth of its shingles at least
COLUMNS = 4096  # shingles whose incidence a block holds at a time


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_words = WordHashes()
remembers("ngramjoin", _words.clear)


def mixed(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


def shingles(text: str, width: int) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles of ``width`` words.

    A-Z are lower-cased; words are runs without ASCII white space.  With fewer words the whole sequence is the one
    shingle; without words there is none.
    """
    words = text.encode().lower().split()
    if not words:
        return np.empty(0, U)
    if len(_words) > CACHE_WORDS:
        _words.clear()
    w = np.fromiter(map(_words.__getitem__, words), U, len(words))
    if len(w) < width:
        out = U(len(w))
        for x in w:
            out = mixed(np.atleast_1d(out) + x)[0]
        return np.atleast_1d(out)
    h = np.full(len(w) - width + 1, width, U)
    for i in range(width):
        h = mixed(h + w[i : len(w) - width + 1 + i])
    return np.unique(h)


class Scheme:
    """Bands and partitions for links with den * intersection >= num * union."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.ends = [0, 1]  # largest size of each band; sizes begin with 1
        self.layouts: dict[int, tuple[int, int, int, int] | None] = {}

    def band(self, n: int) -> int:
        while self.ends[-1] < n:
            self.ends.append((self.ends[-1] + 1) * self.den // self.num)
        return bisect_left(self.ends, n, 1)

    def layout(self, band: int) -> tuple[int, int, int, int] | None:
        """(k, n1, n2, k2) for sets of this band and the one below; None if only equal sets link."""
        if band not in self.layouts:
            self.band(self.ends[-1] + 1) if band >= len(self.ends) else None
            k = 2 * self.ends[band] * (self.den - self.num) // (self.den + self.num)
            least = self.ends[band - 2] + 1 if band >= 2 else 1
            self.layouts[band] = None if k == 0 else (k, 1, k + 4, k) if k <= 3 else (k, partitions(k, least), 1, 0)
        return self.layouts[band]

    def signatures(self, h: np.ndarray) -> np.ndarray:
        """Signatures of a set, for its band and the next.

        Cells without shingles agree among all sets, which says nothing.  At most k cells differ between sets that
        link, so a set that fills more than k cells agrees in a filled one with each of them: it leaves out the
        subsets where it has nothing.  The few sets that fill fewer keep them.
        """
        out = []
        b = self.band(len(h))
        for band in (b, b + 1):
            shape = self.layout(band)
            if shape is None:
                continue
            k, n1, n2, k2 = shape
            cell = ((h >> U(20)) % U(n1 * n2)).astype(np.int64)
            sums = np.zeros(n1 * n2, U)
            np.add.at(sums, cell, mixed(h + U(0x9E37)))
            filled = np.bincount(cell, minlength=n1 * n2) > 0
            subsets = _subsets(n2, n2 - k2)
            kept = filled.reshape(n1, n2)[:, subsets].any(axis=2)
            value = mixed(sums.reshape(n1, n2)[:, subsets] + subsets.astype(U)).sum(axis=2, dtype=U)
            tag = np.arange(kept.size, dtype=U).reshape(kept.shape) + (U(band) << U(40))
            signs = mixed(value + mixed(tag))
            out.append(signs[kept] if filled.sum() > k else signs.ravel())
        return np.concatenate(out) if out else np.empty(0, U)


def partitions(k: int, least: int) -> int:
    """Partitions of which sets of ``least`` shingles or more fill over ``k``, but for about one set in 30,000."""
    n1 = k + 1
    while n1 < 4 * k:
        empty = exp(-least / n1)
        spread = sqrt(n1 * empty * max(0.0, 1 - empty * (1 + least / n1)))
        if n1 * (1 - empty) - 4 * spread > k:
            break
        n1 += 1
    return n1


@lru_cache(maxsize=64)
def _subsets(n: int, size: int) -> np.ndarray:
    return np.array(list(combinations(range(n), size)))


@lru_cache(maxsize=4)
def scheme(num: int, den: int) -> Scheme:
    return Scheme(num, den)


def node_of(h: np.ndarray) -> int:
    """Identity of a set of shingles, as a signed 64-bit value."""
    return int(mixed(np.atleast_1d(mixed(h).sum(dtype=U) + U(len(h))))[0].astype(np.int64))


def counts(h: np.ndarray) -> np.ndarray:
    """Shingles of a set by bin, 255 at most; the number of bins is a power of two."""
    bins = min(max(FEWEST_BINS, 1 << (len(h) // 8).bit_length()), MOST_BINS)
    return np.minimum(np.bincount((h & U(bins - 1)).astype(np.int64), minlength=bins), 255).astype(np.uint8)


def folded(c: np.ndarray, bins: int) -> np.ndarray:
    """The counts of the same set in fewer bins."""
    return np.minimum(c.reshape(-1, bins).sum(axis=0, dtype=np.int64), 255).astype(np.int16)


def _longs(parts: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    flat = np.concatenate(parts) if parts else np.empty(0, U)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64)))


def signed(text: Column, width: int, num: int, den: int) -> Column:
    """Struct of node (null for an empty set), n_shingles, the set's counts by bin and signatures of a text.

    In a batch, only the first of equal sets carries signatures.
    """

    @F.arrow_udf("node long, n_shingles long, counts binary, signatures array<long>")
    def sign(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        only("ngramjoin")
        for batch in batches:
            nodes, sizes, bins, signs, seen = [], [], [], [], set()
            for t in batch.to_pylist():
                h = shingles(t, width)
                node = node_of(h) if len(h) else None
                nodes.append(node)
                sizes.append(len(h))
                bins.append(counts(h).tobytes())
                signs.append(np.empty(0, U) if node is None or node in seen else scheme(num, den).signatures(h))
                seen.add(node)
            yield pa.StructArray.from_arrays(
                [pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(bins, pa.binary()), _longs(signs)],
                ["node", "n_shingles", "counts", "signatures"],
            )
        settle()

    return sign(text)


def sets(text: Column, width: int) -> Column:
    """Struct of node and shingle hashes of a text."""

    @F.arrow_udf("node long, shingles array<long>")
    def hashed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        only("ngramjoin")
        for batch in batches:
            h = [shingles(t, width) for t in batch.to_pylist()]
            nodes = pa.array([node_of(x) if len(x) else None for x in h], pa.int64())
            yield pa.StructArray.from_arrays([nodes, _longs(h)], ["node", "shingles"])
        settle()

    return hashed(text)


def counted(text: Column, width: int) -> Column:
    """Struct of node (null for an empty set), n_shingles and the set's counts by bin of a text."""

    @F.arrow_udf("node long, n_shingles long, counts binary")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        only("ngramjoin")
        for batch in batches:
            h = [shingles(t, width) for t in batch.to_pylist()]
            nodes = pa.array([node_of(x) if len(x) else None for x in h], pa.int64())
            sizes = pa.array([len(x) for x in h], pa.int64())
            yield pa.StructArray.from_arrays([nodes, sizes, pa.array([counts(x).tobytes() for x in h], pa.binary())], ["node", "n_shingles", "counts"])
        settle()

    return count(text)


def candidate_groups(signs: DataFrame) -> DataFrame:
    """(gid, node, least) of nodes that share a signature; signatures of the same nodes make one group."""
    w = Window.partitionBy("sig")
    shared = signs.select(
        "sig", "node",
        F.min("node").over(w).alias("least"), F.max("node").over(w).alias("most"), F.sum(F.col("node") % 1_000_003).over(w).alias("s"),
    )
    return shared.where("least < most").select(F.xxhash64("least", "most", "s").alias("gid"), "node", "least").distinct()


def fetched_sets(docs: DataFrame, members: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """(node, shingles) of the nodes that are members of groups, each from one of its texts."""
    wanted = members.select("node").distinct().join(nodes.groupBy("node").agg(F.min("text_key").alias("text_key")), "node")
    wanted = written(wanted.select("text_key"))
    texts = docs.select("text").withColumn("text_key", F.xxhash64("text"))
    near = probably_in(texts, "text_key", wanted)
    exact = near.join(wanted, "text_key", "left_semi").dropDuplicates(["text_key"])
    return written(exact.select(sets(F.col("text"), width).alias("s")).select("s.*").dropDuplicates(["node"]))


def clustered(groups: DataFrame, edges: DataFrame) -> DataFrame:
    """(root, gid, node) of the members of groups that ``edges`` (a, b) connect; a group is cut where nothing connects it."""
    ends = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    root = ends.join(components(edges), "node", "left").withColumn("root", F.coalesce("root", "node"))
    return groups.select("gid", "node").join(root, "node").select("root", F.xxhash64("gid", "root").alias("gid"), "node")


def units(members: DataFrame) -> DataFrame:
    """(unit, i, j, own, node): which blocks of which unit a node is met in, and its own block there.

    ``members`` is as ``clustered`` returns it.  A unit is a cluster, all members of a root, or each of its groups,
    whichever means fewer copies.  Its nodes are dealt to blocks of about ``BLOCK``, and every block meets every other one and itself.
    """
    copies = lambda size: size * F.ceil(size / BLOCK)
    nodes = members.select("root", "node").distinct()
    sizes = nodes.groupBy("root").agg(F.count(F.lit(1)).alias("size"))
    by_group = members.groupBy("root", "gid").agg(F.count(F.lit(1)).alias("m"))
    apart = by_group.groupBy("root").agg(F.sum(copies(F.col("m"))).alias("apart"))
    sizes = written(sizes.join(apart, "root").select("root", "size", (copies(F.col("size")) <= F.col("apart")).alias("whole")))
    close = nodes.join(sizes.where("whole"), "root").select(F.col("root").alias("unit"), "node", "size")
    groups = members.join(sizes.where("not whole").select("root"), "root", "left_semi")
    groups = groups.join(by_group.select("gid", F.col("m").alias("size")), "gid").select(F.col("gid").alias("unit"), "node", "size")
    n = F.ceil(F.col("size") / BLOCK)
    own = F.pmod(F.xxhash64("node"), n)
    dealt = close.unionByName(groups).where("size > 1").select("unit", "node", own.alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("other"))
    return dealt.select("unit", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node")


def may_link(nodes: list[int], sizes: np.ndarray, held: list[bytes], num: int, den: int) -> list[tuple[int, int]]:
    """Pairs that connect all nodes whose sets may link by their counts.

    Sets of together s shingles link if at most s * (den - num) / (den + num) of these are in one set only, and the counts
    of two sets differ by no more than that.
    """
    c = [np.frombuffer(x, np.uint8) for x in held]
    bins, tables = np.array([len(x) for x in c]), {}

    def table(level: int) -> np.ndarray:
        if level not in tables:
            tables[level] = np.zeros((len(c), level), np.int16)
            for r in np.nonzero(bins >= level)[0]:
                tables[level][r] = folded(c[r], level)
        return tables[level]

    left, out = np.arange(len(nodes)), []
    while len(left):
        reached, left = [int(left[0])], left[1:]
        while reached and len(left):
            x = reached.pop()
            most = (sizes[left] + sizes[x]) * (den - num)
            near = np.abs(sizes[left] - sizes[x]) * (den + num) <= most
            if near.any():
                t = table(min(bins[x], bins[left[near]].min()))
                differ = np.abs(t[left[near]] - t[x]).sum(axis=1, dtype=np.int64)
                near[near] = differ * (den + num) <= most[near]
                out += [(nodes[x], nodes[y]) for y in left[near]]
                reached += left[near].tolist()
                left = left[~near]
    return out


def possible(groups: DataFrame, nodes: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) that connect all members of groups that may link by the counts of ``nodes``."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("ngramjoin")
        at, held = None, []

        def found() -> pa.RecordBatch:
            own, sizes, bins = zip(*held)
            pairs = may_link(own, np.array(sizes), bins, num, den)
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], ["a", "b"])

        for batch in batches:
            for unit, i, j, *row in zip(*(batch.column(c).to_pylist() for c in ("unit", "i", "j", "node", "n_shingles", "counts"))):
                if (unit, i, j) != at:
                    if len(held) > 1:
                        yield found()
                    at, held = (unit, i, j), []
                held.append(row)
        if len(held) > 1:
            yield found()
        settle()

    clusters = written(clustered(groups, groups.select(F.col("node").alias("a"), F.col("least").alias("b"))))
    counts_of = nodes.select("node", "n_shingles", "counts").dropDuplicates(["node"])
    dealt = units(clusters).join(counts_of, "node").repartition("unit", "i", "j").sortWithinPartitions("unit", "i", "j")
    return written(dealt.select("unit", "i", "j", "node", "n_shingles", "counts").mapInArrow(meet, "a long, b long").distinct())


def forest(nodes: np.ndarray, own: np.ndarray, sets_: list[np.ndarray], num: int, den: int) -> list[tuple[int, int]]:
    """Links that connect what links connect among these sets, those within one of two blocks left to its own turn."""
    flat = np.concatenate(sets_)
    row = np.repeat(np.arange(len(sets_)), [len(x) for x in sets_])
    _, column, seen = np.unique(flat, return_inverse=True, return_counts=True)
    common = seen > 1
    place = np.cumsum(common) - 1
    some = common[column]
    row, column = row[some], place[column[some]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    both = np.zeros((len(sets_), len(sets_)), np.float32)
    cuts = np.searchsorted(column, np.arange(0, int(common.sum()) + COLUMNS, COLUMNS))
    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
        part = np.zeros((len(sets_), COLUMNS), np.float32)
        part[row[a:b], column[a:b] - k * COLUMNS] = 1
        both += part @ part.T
    size = np.array([len(x) for x in sets_])
    linked = den * both.astype(np.int64) >= num * (size[:, None] + size[None, :] - both.astype(np.int64))
    if own.min() != own.max():
        linked &= own[:, None] != own[None, :]
    parent = list(range(len(sets_)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for a, b in zip(*np.nonzero(np.triu(linked, 1))):
        x, y = find(int(a)), find(int(b))
        if x != y:
            parent[x] = y
            out.append((int(nodes[a]), int(nodes[b])))
    return out


def links(members: DataFrame, sets_: DataFrame, num: int, den: int) -> DataFrame:
    """Links (a, b) that connect all nodes of one component of the join, among ``members`` as ``clustered`` returns them."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("ngramjoin")
        at, nodes, own, held = None, [], [], []

        def found() -> pa.RecordBatch:
            pairs = forest(np.array(nodes), np.array(own), held, num, den) if len(nodes) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], ["a", "b"])

        for batch in batches:
            keys = zip(*(batch.column(c).to_pylist() for c in ("unit", "i", "j", "node", "own")))
            shingle_lists = batch.column("shingles")
            values, ends = shingle_lists.values.to_numpy(), shingle_lists.offsets.to_numpy()
            for r, (unit, i, j, node, block) in enumerate(keys):
                if (unit, i, j) != at:
                    if len(nodes) > 1:
                        yield found()
                    at, nodes, own, held = (unit, i, j), [], [], []
                nodes.append(node)
                own.append(block)
                held.append(values[ends[r] : ends[r + 1]].copy())
        if len(nodes) > 1:
            yield found()
        settle()

    dealt = units(members).join(sets_, "node").repartition("unit", "i", "j").sortWithinPartitions("unit", "i", "j")
    return written(dealt.select("unit", "i", "j", "own", "node", "shingles").mapInArrow(verify, "a long, b long"))


def labelled(docs: DataFrame, width: int, num: int, den: int, keep_signatures: bool) -> DataFrame:
    """doc_id, text_key, n_shingles, component (a node; null for an empty set) and component_id of every row of ``docs``."""
    texts = docs.select("doc_id", text_of().alias("text"))
    rows = texts.select("doc_id", F.xxhash64("text").alias("text_key"), signed(F.col("text"), width, num, den).alias("s"))
    if keep_signatures:
        stored = written(rows.select("doc_id", "text_key", "s.*"))
        nodes, signs = stored.drop("signatures"), stored.select("node", "signatures")
    else:
        plain = texts.select("doc_id", F.xxhash64("text").alias("text_key"), counted(F.col("text"), width).alias("s"))
        nodes = written(plain.select("doc_id", "text_key", "s.*"))
        signs = rows.select("s.node", "s.signatures")
    groups = written(candidate_groups(signs.select("node", F.explode("signatures").alias("sig"))))
    members = written(clustered(groups, possible(groups, nodes, num, den)))
    found = links(members, fetched_sets(texts, members, nodes, width), num, den)
    least = nodes.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"))
    rooted = least.join(components(found), "node", "left").withColumn("root", F.coalesce("root", "node"))
    lowest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = written(rooted.join(lowest, "root").select("node", F.col("root").alias("component"), "component_id"))
    own = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return nodes.join(named, "node", "left").select("doc_id", "text_key", "n_shingles", "component", own.alias("component_id"))



def join_documents(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100, keep_signatures: bool = True) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` (least doc_id reachable by links) of every row of ``docs``.

    Two documents link when ``den * |intersection| >= num * |union|`` of their sets of word shingles.
    Null text, or text without words, has an empty set, links with nothing and keeps its own id.  Equal texts
    always link.  Repeated rows are returned as often as they come.  Null ids are passed over when the least id is
    taken; a component of null ids only has a null id.  Extra columns are not looked at.

    ``keep_signatures`` stores the signatures between their two uses; without it texts are read once more instead.
    """
    found = labelled(docs, width, num, den, keep_signatures)
    return found.select("doc_id", "n_shingles", "component_id")


def first_of_each(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``docs`` with one row of each component of near duplicates: that of the least doc_id.

    Of rows with that id, and of repeated rows, the one of the least text hash stays.  Documents without words are
    not linked with anything and stay.  Columns stay as they are.
    """
    key = fresh(docs, "_key")
    keyed = docs.withColumn(key, F.xxhash64(text_of()))
    joined = labelled(docs, width, num, den, keep_signatures=False)
    best = Window.partitionBy("component").orderBy(F.asc_nulls_last("doc_id"), "text_key")
    wordy = joined.where("component is not null").select("doc_id", "text_key", "component").distinct()
    stay = wordy.withColumn("rank", F.row_number().over(best)).where("rank = 1").select("doc_id", "text_key")
    stay = written(stay.unionByName(joined.where("component is null").select("doc_id", "text_key").distinct()))
    same = keyed["doc_id"].eqNullSafe(stay["doc_id"]) & (keyed[key] == stay["text_key"])
    return keyed.join(stay, same, "left_semi").dropDuplicates(["doc_id", key]).drop(key)
