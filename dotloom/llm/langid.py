"""Language identification with segmentation-marginalised unigrams (operator 3).

Every language has a probability for each piece of a fixed public vocabulary.  The probability of a word is the sum
over all its segmentations into pieces, which the forward algorithm takes in one pass; that of a text is the
product over its words.  Piece probabilities come from expectation maximisation over the word counts of the
labelled documents: a step adds up, over all segmentations, how often each piece is expected in a language.

Word counts and expected counts are Spark aggregates.  What reaches the driver and is broadcast is one number for
each piece and language: at most vocabulary x ``MAX_LANGUAGES``.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from uuid import uuid4

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dotloom.llm.common import fresh, only, remembers, settle, written

MAX_LANGUAGES = 500
#: Longer runs of letters are cut into consecutive words of this many.
MAX_LETTERS = 24
EM_STEPS = 2
#: Expected count that every piece has in every language beforehand.
PRIOR = 0.05
LEAST = 1e-9  # probability of a letter that is no piece, and of the least likely piece
CACHE_TOKENS = 400_000
BASE = np.uint64(0x9E3779B97F4A7C15)
WORD = re.compile(r"[^\W\d_]+")
BEGIN = "▁"


def default_vocabulary() -> str:
    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """Pieces that lower-case words can hold, found by hash in many words at once."""

    def __init__(self, path: str):
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        texts = {sp.id_to_piece(i) for i in range(sp.get_piece_size())}
        own = sorted(t for t in texts if t.removeprefix(BEGIN).isalpha() and t == t.lower() or t == BEGIN)
        self.n, self.longest = len(own), max(map(len, own))
        hashes = np.array([self._hash(t) for t in own], np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.ids = hashes[order], order
        self.power = [np.uint64(pow(int(BASE), k, 2**64)) for k in range(self.longest + 1)]

    @staticmethod
    def _hash(t: str) -> int:
        h = 0
        for c in t:
            h = (h * int(BASE) + ord(c)) % 2**64
        return h

    def spans(self, words: list[str]) -> list[list[tuple[int, np.ndarray, np.ndarray]]]:
        """For words of one length: by end, (start, rows, pieces) of the pieces that end there; -1 is no piece.

        Symbol 0 is the beginning of the word.
        """
        length = len(words[0]) + 1
        codes = np.frombuffer("".join(BEGIN + w for w in words).encode("utf-32-le"), np.uint32).reshape(-1, length)
        prefix = [np.zeros(len(words), np.uint64)]
        for j in range(length):
            prefix.append(prefix[-1] * BASE + codes[:, j])
        out = []
        for end in range(1, length + 1):
            here = []
            for start in range(max(0, end - self.longest), end):
                value = prefix[end] - prefix[start] * self.power[end - start]
                at = np.minimum(np.searchsorted(self.hashes, value), self.n - 1)
                hit = self.hashes[at] == value
                rows = np.flatnonzero(hit)
                if len(rows):
                    here.append((start, rows, self.ids[at[rows]]))
                if start == end - 1 and len(rows) < len(words):
                    rest = np.flatnonzero(~hit)
                    here.append((start, rest, np.full(len(rest), -1)))
            out.append(here)
        return out


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def by_length(words: list[str]) -> Iterator[tuple[np.ndarray, list[str]]]:
    groups: dict[int, list[int]] = defaultdict(list)
    for i, w in enumerate(words):
        groups[len(w)].append(i)
    for own in groups.values():
        for a in range(0, len(own), 50_000):
            part = own[a : a + 50_000]
            yield np.array(part), [words[i] for i in part]


def log_probabilities(words: list[str], path: str, p: np.ndarray) -> np.ndarray:
    """Log probability of each word in each language; ``p`` has a row for each piece."""
    out = np.zeros((len(words), p.shape[1]))
    p = np.vstack([p, np.full(p.shape[1], LEAST)])  # piece -1
    for own, group in by_length(words):
        alpha = [np.ones((len(group), p.shape[1]))]
        for here in pieces(path).spans(group):
            total = np.zeros_like(alpha[0])
            for start, rows, ids in here:
                total[rows] += alpha[start][rows] * p[ids]
            alpha.append(total)
        out[own] = np.log(alpha[-1])
    return out


def expected_counts(words: list[str], n: np.ndarray, path: str, p: np.ndarray) -> np.ndarray:
    """How often each piece is expected in words that occur ``n`` times, over all segmentations."""
    out = np.zeros(len(p))
    p = np.append(p, LEAST)
    for own, group in by_length(words):
        spans = pieces(path).spans(group)
        alpha = [np.ones(len(group))]
        for here in spans:
            total = np.zeros(len(group))
            for start, rows, ids in here:
                total[rows] += alpha[start][rows] * p[ids]
            alpha.append(total)
        beta = [np.zeros(len(group)) for _ in alpha]
        beta[-1] = n[own] / alpha[-1]
        for end in range(len(spans), 0, -1):
            for start, rows, ids in spans[end - 1]:
                flow = p[ids] * beta[end][rows]
                beta[start][rows] += flow
                known = ids >= 0
                out += np.bincount(ids[known], (alpha[start][rows] * flow)[known], len(out))
    return out


def words_of(token: str) -> list[str]:
    """Runs of letters of a lower-case token without white space."""
    return [w[i : i + MAX_LETTERS] for w in WORD.findall(token) for i in range(0, len(w), MAX_LETTERS)]


def word_counts(labelled: DataFrame) -> DataFrame:
    """(lang, word, n) over the whole texts of ``labelled`` (lang, text)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens: dict[str, Counter] = defaultdict(Counter)
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                tokens[lang].update((text or "").lower().split())
            for lang, found in tokens.items():
                words: Counter = Counter()
                for t, n in found.items():
                    for w in words_of(t):
                        words[w] += n
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(words)), pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64())],
                    ["lang", "word", "n"],
                )

    counted = labelled.select("lang", "text").mapInArrow(count, "lang string, word string, n long")
    return counted.groupBy("lang", "word").agg(F.sum("n").alias("n"))


class Model:
    def __init__(self, languages: list[str], p: np.ndarray, path: str):
        self.languages, self.p, self.path, self.key = languages, p, path, uuid4().hex


def train(labelled: DataFrame, path: str | None = None, steps: int = EM_STEPS) -> Model:
    """Piece probabilities of every language of ``labelled`` (lang, text), from all its rows; null languages are left out."""
    path = path or default_vocabulary()
    spark = labelled.sparkSession
    counts = written(word_counts(labelled.where("lang is not null")))
    languages = [r.lang for r in counts.select("lang").distinct().sort("lang").limit(MAX_LANGUAGES + 1).collect()]
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    n = pieces(path).n
    p = np.full((n, len(languages)), 1 / n)
    for _ in range(steps if languages else 0):
        shared = spark.sparkContext.broadcast(p)

        def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[str, np.ndarray] = {}
            for batch in batches:
                of: dict[str, list[int]] = defaultdict(list)
                for i, lang in enumerate(batch.column("lang").to_pylist()):
                    of[lang].append(i)
                words, counts = batch.column("word").to_pylist(), batch.column("n").to_numpy()
                for lang, rows in of.items():
                    column = shared.value[:, languages.index(lang)]
                    got = expected_counts([words[i] for i in rows], counts[rows].astype(float), path, column)
                    total[lang] = total[lang] + got if lang in total else got
            for lang, got in total.items():
                used = np.flatnonzero(got)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([languages.index(lang)] * len(used), pa.int32()), pa.array(used, pa.int32()), pa.array(got[used])],
                    ["language", "piece", "n"],
                )

        expected = counts.mapInArrow(expect, "language int, piece int, n double").groupBy("language", "piece").agg(F.sum("n").alias("n"))
        p = np.full((n, len(languages)), PRIOR)
        for r in expected.collect():  # at most one row for each piece and language
            p[r.piece, r.language] += r.n
        p = np.maximum(p / p.sum(axis=0), LEAST)
    return Model(languages, p, path)


class Scorer:
    """Log probabilities of the tokens met so far, up to a bounded number.

    Tokens are known by their 64-bit hashes, in order, so one takes some forty bytes.
    """

    def __init__(self, model: Model):
        self.model = model
        self.forget()

    def forget(self) -> None:
        self.hashes = np.zeros(0, np.int64)
        self.rows = np.zeros((0, len(self.model.languages)))
        self.letters = np.zeros(0, bool)

    def learn(self, hashes: np.ndarray, tokens: list[str]) -> None:
        cut = [words_of(t) for t in tokens]
        words = list({w for ws in cut for w in ws})
        place = {w: i for i, w in enumerate(words)}
        scores = log_probabilities(words, self.model.path, self.model.p)
        new = np.zeros((len(cut), scores.shape[1]))
        letters = np.zeros(len(cut), bool)
        for k, ws in enumerate(cut):
            letters[k] = any(w.isalpha() or any(map(str.isalpha, w)) for w in ws)
            for w in ws:
                new[k] += scores[place[w]]
        hashes = np.concatenate([self.hashes, hashes])
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.rows = hashes[order], np.vstack([self.rows, new])[order]
        self.letters = np.append(self.letters, letters)[order]

    def score(self, texts: list[str]) -> tuple[list[str], list[float]]:
        if len(self.hashes) > CACHE_TOKENS:
            self.forget()
        docs = [t.lower().split() for t in texts]
        tokens = list(chain.from_iterable(docs))
        hashes = np.fromiter(map(hash, tokens), np.int64, len(tokens))  # the same in all workers of an application
        distinct, first, where = np.unique(hashes, return_index=True, return_inverse=True)
        new = ~np.isin(distinct, self.hashes, assume_unique=True)
        if new.any():
            self.learn(distinct[new], [tokens[i] for i in first[new].tolist()])
        places = np.searchsorted(self.hashes, distinct)[where]
        ends = np.cumsum([0, *map(len, docs)])
        langs, scores = [], []
        for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
            at = places[a:b]
            if not self.model.languages or not self.letters[at].any():
                langs.append("und")
                scores.append(0.0)
                continue
            total = self.rows[at].sum(axis=0)
            odds = np.exp(total - total.max())
            best = int(odds.argmax())
            langs.append(self.model.languages[best])
            scores.append(float(odds[best] / odds.sum()))
        return langs, scores


_scorers: dict[str, Scorer] = {}


def _forget() -> None:
    _scorers.clear()
    pieces.cache_clear()


remembers("langid", _forget)


def scorer(model: Model) -> Scorer:
    if model.key not in _scorers:
        _scorers.clear()
        _scorers[model.key] = Scorer(model)
    return _scorers[model.key]


def predicted(text: Column, model: Model, spark) -> Column:
    """Struct of lang_pred and score (the posterior of that language, all being equally likely beforehand).

    Text that is null or has no letter is ``und`` with score 0, as is any text where no language was learned.
    Of equally likely languages the first in the alphabet is taken.
    """
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("lang_pred string, score double")
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        from dotloom.llm.bpe import blocks

        only("langid")
        for batch in batches:
            langs, scores = [], []
            for block in blocks([t or "" for t in batch.to_pylist()]):
                a, b = scorer(shared.value).score(block)
                langs += a
                scores += b
            yield pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"])
        settle()

    return predict(text)


def identify(docs: DataFrame, labelled: DataFrame, path: str | None = None) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (which replace columns of these names), learned from ``labelled``.

    Only the text is looked at.  Repeated rows and extra columns stay; an empty table stays empty.
    """
    own = fresh(docs, "predicted")
    got = docs.withColumn(own, predicted(F.col("text"), train(labelled, path), docs.sparkSession))
    return got.withColumns({"lang_pred": F.col(f"{own}.lang_pred"), "score": F.col(f"{own}.score")}).drop(own)


def held_out(doc_id: Column) -> Column:
    """A third of the ids, which no model learns from; a null id isn't held out."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 3 == 1
