"""What a written step leaves on disk."""

import time
from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

from dotloom.llm import ngramjoin
from dotloom.llm.common import CLEANUP, written


def test_shuffle_files_go_when_a_step_is_written(spark):
    folders = [Path(str(f)) for f in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    held = lambda: {p for f in folders for p in f.glob("*/shuffle_*")}
    before, setting = held(), spark.conf.get(CLEANUP)
    out = written(spark.range(200_000).groupBy((F.col("id") % 50_003).alias("k")).agg(F.sum("id").alias("s")))
    for _ in range(50):
        if held() <= before:
            break
        time.sleep(0.1)
    assert held() <= before and spark.conf.get(CLEANUP) == setting
    assert out.count() == 50_003  # the table doesn't need them


def test_copies_of_candidates(spark):
    """Sets that share a common shingle alone are candidates of each other; their shingles are not copied for it."""
    rng = np.random.default_rng(5)
    sets = {n: np.unique(rng.integers(1, 1 << 63, n).astype(np.uint64)) for n in range(300, 420)}
    rows = [(n, len(h), bytearray(ngramjoin.counts(h).tobytes())) for n, h in sets.items()]
    rows += [(1000 + n, len(h) - 3, bytearray(ngramjoin.counts(h[3:]).tobytes())) for n, h in sets.items() if n % 10 == 0]
    nodes = spark.createDataFrame(rows, "node long, n_shingles long, counts binary")
    groups = nodes.select(F.lit(7).cast("long").alias("gid"), "node", F.lit(300).cast("long").alias("least"))
    found = ngramjoin.possible(groups, nodes, 80, 100)
    assert {frozenset(r) for r in found.collect()} == {frozenset((n, 1000 + n)) for n in sets if n % 10 == 0}
    assert ngramjoin.units(ngramjoin.clustered(groups, found)).count() == 24


def test_counts_differ_by_no_more_than_sets():
    rng = np.random.default_rng(6)
    for n in [*range(1, 40), 300, 511, 512, 513, 1100, 5000, 40_000]:
        a = np.unique(rng.integers(1, 1 << 63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[: n - n // 10], rng.integers(1, 1 << 63, n // 9).astype(np.uint64)]))
        k = len(np.intersect1d(a, b))
        held = [ngramjoin.counts(x).tobytes() for x in (a, b)]
        for num in (60, 80, 90):
            if 100 * k >= num * (len(a) + len(b) - k):
                assert ngramjoin.may_link([1, 2], np.array([len(a), len(b)]), held, num, 100) == [(1, 2)], (n, num)
