"""Toxic passages by maximum-scoring segments (operator 10).

Words, and the first letters that words share, get log-odds of toxic against clean documents with a Dirichlet prior
that follows their frequency in the whole corpus.  Those whose share among toxic documents is significantly raised
keep their log-odds as score; every other word costs ``DRIFT``.  A linear scan finds all maximal segments of a
document, each of which no extension or shortening improves.  The best score of n random words follows an
extreme-value law, P(best >= s) = 1 - exp(-K n exp(-L s)): L comes from the scores' frequencies in clean documents,
K from the segments found there.  All segments that count for more than chance are combined by the laws of the r-th
best and of the sum of the r best ones (Karlin and Altschul), at the r that is least likely.  A logistic curve over that and the number
of significant passages gives the document's score.

All counts are Spark aggregates over all documents.  The driver sees the lexicon (every feature that qualifies) and a
histogram.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from math import exp, lgamma, log, log2
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dotloom.llm.common import fresh, probably_in, written

STEM_LETTERS = 4
PRIOR = 500.0  # documents' words that the Dirichlet prior weighs
SIGNIFICANCE = 20.0  # likelihood ratio statistic from which a word counts
LEAST_LOG_ODDS = log(2)  # and by how much, which significance alone doesn't bound in a large corpus
DRIFT = 0.7
SEED_SCORE = 2.0  # segments of clean documents from this score determine K
PASSAGE_EXPECTATION = 0.05
CACHE_TOKENS = 500_000
RUN = re.compile(r"[^\W\d_]+")


def features(token: str) -> list[tuple[str, str | None]]:
    """The words of a lower-case token, each with its stem (marked by a hyphen) if it is longer than that."""
    return [(w, f"{w[:STEM_LETTERS]}-" if len(w) > STEM_LETTERS else None) for w in RUN.findall(token)]


def document_frequencies(docs: DataFrame) -> DataFrame:
    """(feature, n, toxic, clean): documents with a feature, and how many of these are labelled so.

    ``docs`` has text and y (1 toxic, 0 clean, null unlabelled).  Whole texts are counted.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, set[str]] = {}
        for batch in batches:
            if len(known) > CACHE_TOKENS:
                known.clear()
            found = {None: Counter(), 0: Counter(), 1: Counter()}
            for y, text in zip(batch.column("y").to_pylist(), batch.column("text").to_pylist()):
                tokens = set((text or "").lower().split())
                for t in tokens:
                    if t not in known:
                        known[t] = {f for pair in features(t) for f in pair if f}
                found[y].update(set().union(*map(known.__getitem__, tokens)))
            every = list(set().union(*found.values()))
            columns = [[c[f] for f in every] for c in (found[None], found[1], found[0])]
            yield pa.RecordBatch.from_arrays(
                [pa.array(every, pa.string()), *(pa.array(c, pa.int64()) for c in columns)], ["feature", "n", "toxic", "clean"]
            )

    counted = docs.select("text", "y").mapInArrow(count, "feature string, n long, toxic long, clean long")
    return counted.groupBy("feature").agg(*(F.sum(c).alias(c) for c in ("n", "toxic", "clean")))


def lexicon(frequencies: DataFrame) -> tuple[dict[str, float], float]:
    """Scores of the significant features, and the rate L of the extreme-value law."""
    total = frequencies.agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).first()
    if not total.toxic or not total.clean:
        return {}, 1.0
    share = total.toxic / (total.toxic + total.clean)
    seen = F.col("toxic") + F.col("clean")

    def term(k: Column, expected: Column) -> Column:
        return F.when(k > 0, k * F.log(k / expected)).otherwise(0.0)

    g = 2 * (term(F.col("toxic"), seen * share) + term(F.col("clean"), seen * (1 - share)))
    # n counts all documents with the feature, the labelled ones among them
    prior = PRIOR * F.greatest(F.col("n"), F.lit(1)) / max(total.n, 1)
    rate = {y: (F.col(y) + prior) / (total[y] + PRIOR) for y in ("toxic", "clean")}
    raised = frequencies.where(F.col("toxic") > seen * share).where(g >= SIGNIFICANCE)
    rows = raised.select("feature", F.log(rate["toxic"] / rate["clean"]).alias("score"), rate["clean"].alias("rate")).where(F.col("score") >= LEAST_LOG_ODDS).collect()
    scores, clean_rate = {r.feature: r.score for r in rows}, {r.feature: r.rate for r in rows}
    rest = max(1e-9, 1 - sum(clean_rate.values()))
    rates, values = np.array([*clean_rate.values(), rest]), np.array([*scores.values(), -DRIFT])
    low, high = 1e-3, 50.0
    for _ in range(60):  # the positive root of E exp(L s) = 1
        mid = (low + high) / 2
        low, high = (low, mid) if np.log(rates @ np.exp(np.minimum(mid * values, 700))) > 0 else (mid, high)
    return scores, max(0.05, low)


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """(start, end, score) of all maximal scoring segments, in order, in linear time.

    Every candidate keeps the running total before its start and at its end, and the last candidate before it with
    a lower total before its start.  A candidate that a later one can be joined with, to the gain of both, takes it.
    """
    before = np.concatenate([[0.0], np.cumsum(scores)])
    kept: list[tuple[int, int, float, float, int]] = []  # start, end, total before, total at end, lower one
    for i in np.flatnonzero(scores > 0).tolist():
        start, end, left, right = i, i + 1, float(before[i]), float(before[i + 1])
        j = len(kept) - 1
        while True:
            while j >= 0 and kept[j][2] >= left:
                j = kept[j][4]
            if j < 0 or kept[j][3] >= right:
                kept.append((start, end, left, right, j))
                break
            start, left = kept[j][0], kept[j][2]
            lower = kept[j][4]
            del kept[j:]
            j = lower
    return [(a, b, right - left) for a, b, left, right, _ in kept]


class Model:
    def __init__(self, scores: dict[str, float], rate: float):
        self.scores, self.rate, self.key = scores, rate, uuid4().hex
        self.k, self.slopes, self.offset = 1.0, (1.0, 0.0), -1.0

    def expectation(self, n: int, s: float) -> float:
        """How many segments of at least this score are expected in n words of clean text."""
        return self.k * n * exp(-self.rate * s)

    def evidence(self, n: int, found: list[float]) -> tuple[float, float]:
        """What the logistic curve runs over, from the scores of all segments of n words.

        First the decimal exponent, negated, of the chance that clean text has the r best segments: that so many reach
        the r-th, at most e^r / r! for its expectation e, or that they sum to that much, exp(-t) t^(r-1) / (r! (r-1)!)
        for a large normalised sum t.  r is the one of the least chance, which counts 2^(r-1) times since r was chosen.
        Segments of an expectation of 1 or more add nothing.  Second the binary logarithm of 1 + the number of passages.
        """
        each = [self.rate * s - log(self.k * n) for s in found]
        least, total = 0.0, 0.0
        for r, t in enumerate(sorted((t for t in each if t > 0), reverse=True), 1):
            total += t
            chosen = lgamma(r + 1) - (r - 1) * log(2)
            least = max(least, r * t + chosen)
            if total > r * (r - 1):
                least = max(least, total - (r - 1) * log(total) + lgamma(r) + chosen)
        return min(60.0, least / log(10)), log2(1 + sum(t >= -log(PASSAGE_EXPECTATION) for t in each))

    def probability(self, n: int, found: list[float]) -> float:
        x = sum(a * b for a, b in zip(self.slopes, self.evidence(n, found))) + self.offset
        return 1 / (1 + exp(-max(-700.0, min(700.0, x))))


class Scanner:
    """Scores of the tokens met so far, up to a bounded number."""

    def __init__(self, model: Model):
        self.model, self.index, self.values = model, {}, [0.0]

    def score_of(self, token: str) -> float:
        """The best of a token's features; a token without letters costs nothing."""
        known = self.model.scores
        found = features(token)
        best = max((known.get(f, 0.0) for pair in found for f in pair if f), default=0.0)
        return best if best > 0 else -DRIFT * len(found)

    def scan(self, text: str) -> tuple[int, list[tuple[int, int, float]]]:
        """Number of words, and the maximal segments as word positions with scores."""
        tokens = text.lower().split()
        if len(self.index) > CACHE_TOKENS:
            self.index.clear()
        for t in set(tokens).difference(self.index):
            self.index[t] = self.score_of(t)
        scores = np.fromiter(map(self.index.__getitem__, tokens), float, len(tokens))
        return len(tokens), maximal_segments(scores)


_scanners: dict[str, Scanner] = {}


def scanner(model: Model) -> Scanner:
    if model.key not in _scanners:
        _scanners.clear()
        _scanners[model.key] = Scanner(model)
    return _scanners[model.key]


def train(docs: DataFrame, labelled: DataFrame) -> Model:
    """Learns from ``labelled`` (text, y), with word frequencies of ``docs`` (text) as prior.

    Of equal labelled texts one counts (as toxic if any is), so a group of copies doesn't make its words significant.
    """
    spark = docs.sparkSession
    once = labelled.where("y is not null").groupBy(F.col("text")).agg(F.max("y").alias("y"))
    once = written(once)
    frequencies = document_frequencies(docs.select("text", F.lit(None).cast("int").alias("y")).unionByName(once))
    model = Model(*lexicon(written(frequencies)))
    shared = spark.sparkContext.broadcast(model)

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = found = 0
            for text in batch.column("text").to_pylist():
                length, segments = scanner(shared.value).scan(text or "")
                n, found = n + length, found + sum(s >= SEED_SCORE for *_, s in segments)
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([found], pa.int64())], ["n", "seeds"])

    clean = once.where("y = 0").select("text").mapInArrow(seeds, "n long, seeds long").agg(F.sum("n").alias("n"), F.sum("seeds").alias("seeds")).first()
    if clean.n:
        model.k = (1 + clean.seeds) / (clean.n * exp(-model.rate * SEED_SCORE))
    shared = spark.sparkContext.broadcast(model)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = []
            for text in batch.column("text").to_pylist():
                n, found = scanner(shared.value).scan(text or "")
                x.append(shared.value.evidence(n, [s for *_, s in found]))
            columns = [pa.array([e[i] for e in x], pa.float64()) for i in range(2)]
            yield pa.RecordBatch.from_arrays([batch.column("y").cast(pa.int32()), *columns], ["y", "sum", "passages"])

    measured = once.select("y", "text").mapInArrow(measure, "y int, sum double, passages double")
    # at most 601 steps of the sum for each of 125 of the number
    steps = F.round("sum", 1).alias("sum"), (F.round(4 * F.col("passages")) / 4).alias("passages")
    bins = measured.groupBy(*steps).agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("y")).collect()
    if bins:
        columns = np.array([[float(b[i]) for b in bins] for i in range(4)])
        model.slopes, model.offset = logistic(columns[:2].T, columns[2], columns[3])
    return model


def logistic(x: np.ndarray, n: np.ndarray, y: np.ndarray) -> tuple[tuple[float, ...], float]:
    """Slopes (not negative) and offset of P(y) over the columns of x, with one doubtful case of each kind at either end.

    Columns are weighed by their size, so none is preferred for its unit.
    """
    size = np.maximum(np.sqrt((x * x * n[:, None]).sum(0) / n.sum()), 1e-9)
    x = np.vstack([x, np.zeros(x.shape[1]), x.max(0)]) / size
    n, y = np.append(n, [1, 1]), np.append(y, [0.5, 0.5])
    used = np.ones(x.shape[1], bool)
    while True:
        z = np.column_stack([x[:, used], np.ones(len(x))])
        ridge = np.diag([1e-3] * used.sum() + [1e-9])
        a = np.zeros(z.shape[1])
        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(z @ a, -30, 30)))
            w = n * p * (1 - p) + 1e-9
            step = np.clip(np.linalg.solve((z.T * w) @ z + ridge, z.T @ (y - n * p) - ridge @ a), -2, 2)
            a = a + step
            if abs(step).max() < 1e-9:
                break
        if (a[:-1] >= 0).all():
            slopes = np.zeros(x.shape[1])
            slopes[used] = a[:-1]
            return tuple((slopes / size).tolist()), float(a[-1])
        used[np.flatnonzero(used)[a[:-1].argmin()]] = False


def scored(text: Column, model: Model, spark) -> Column:
    """Struct of score and passages (word positions from 0, end exclusive, score, expectation) of a text."""
    shared = spark.sparkContext.broadcast(model)
    passage = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("expectation", pa.float64())])

    @F.arrow_udf("score double, passages array<struct<start: int, end: int, score: double, expectation: double>>")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = shared.value
        for batch in batches:
            scores, passages = [], []
            for t in batch.to_pylist():
                n, found = scanner(model).scan(t or "")
                scores.append(model.probability(n, [s for *_, s in found]))
                each = [(a, b, s, model.expectation(n, s)) for a, b, s in found]
                passages.append([dict(zip(("start", "end", "score", "expectation"), p)) for p in each if p[3] <= PASSAGE_EXPECTATION])
            yield pa.StructArray.from_arrays([pa.array(scores, pa.float64()), pa.array(passages, pa.list_(passage))], ["score", "passages"])

    return score(text)


def labelled_texts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, y) of the documents (doc_id, text) with a label (doc_id, toxic); a document labelled both ways is toxic."""
    y = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y"))
    some = probably_in(docs.select("doc_id", "text"), "doc_id", y.select("doc_id"))
    return some.join(y, "doc_id").select("text", "y")


def detect(docs: DataFrame, labelled: DataFrame) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``passages`` (which replace columns of these names).

    Null or empty text has no passage and the score of a text without any.  Scores depend on the text alone.
    Repeated rows and extra columns stay; an empty table stays empty; without labels of both kinds no word counts.
    """
    model = train(docs, labelled)
    own = fresh(docs, "scored")
    got = docs.withColumn(own, scored(F.col("text"), model, docs.sparkSession))
    return got.withColumns({"score": F.col(f"{own}.score"), "passages": F.col(f"{own}.passages")}).drop(own)
