"""Token counts without token ids (operator 2).

The pieces of a distinct pre-token are counted once in a block of documents.  The count joins the frequencies of
pre-tokens in each document, and the products are summed.  Only one number leaves a document.
"""

from __future__ import annotations

import base64
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dotloom.llm import pretokens as pre

CACHE_CHUNKS = 600_000


@lru_cache(maxsize=2)
def ranks(path: str) -> tiktoken.Encoding:
    """Merges of a rank file; a pre-token is encoded as it stands."""
    with open(path, "rb") as f:
        table = {base64.b64decode(t): int(r) for t, r in map(bytes.split, f)}
    return tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})


class PieceCounts:
    """Number of pieces of each distinct chunk seen, up to a bounded number of chunks."""

    def __init__(self, vocabulary: str, merges: str):
        self.vocabulary, self.merges = vocabulary, ranks(merges)
        self.special = list(pre.specials(vocabulary))
        self.first: dict[str, int] = {}
        self.later: dict[str, int] = {}

    def of_chunk(self, chunk: str) -> int:
        if pre.UNUSUAL.search(chunk):  # the library cuts these; each pre-token is then counted alone
            return sum(len(self.merges._encode_single_piece(p.encode())) for p in pre.pretokens(chunk, self.vocabulary))
        return len(self.merges.encode_ordinary(chunk))

    def learn(self, known: dict[str, int], chunks: set[str], lead: str) -> dict[str, int]:
        """Counts of chunks; those that are not remembered are returned."""
        if len(known) > CACHE_CHUNKS:
            known.clear()
        rare = {}
        for c in chunks:
            if c not in known:
                (known if len(c) <= pre.CACHED_CHARS else rare)[c] = self.of_chunk(lead + c) if lead + c else 0
        return rare

    def count(self, texts: list[str]) -> list[int]:
        split, n_special = [], []
        for text in texts:
            parts, n = [text], 0
            for s in self.special:
                parts = [q for p in parts for q in p.split(s)]
            n_special.append(len(parts) - 1)
            split.append([pre.chunks(p) for p in parts])
        begin = {cs[0] for doc in split for cs in doc}
        rare_first = self.learn(self.first, begin, "")
        frequencies = []
        for doc in split:
            f: Counter[str] = Counter()
            for cs in doc:
                f.update(cs[1:])
            frequencies.append(f)
        rare_later = self.learn(self.later, set().union(*frequencies) if frequencies else set(), " ")
        out = []
        for n, doc, f in zip(n_special, split, frequencies):
            n += sum(self.first[cs[0]] if cs[0] in self.first else rare_first[cs[0]] for cs in doc)
            if rare_later and not f.keys().isdisjoint(rare_later):
                n += sum(k * (self.later[c] if c in self.later else rare_later[c]) for c, k in f.items())
            else:
                n += sum(map(int.__mul__, map(self.later.__getitem__, f), f.values()))
            out.append(n)
        return out


@lru_cache(maxsize=2)
def piece_counts(vocabulary: str, merges: str) -> PieceCounts:
    return PieceCounts(vocabulary, merges)


def n_tokens(text: Column, vocabulary: str | None = None, merges: str | None = None) -> Column:
    """Tokens of a text as the library counts them; null and empty text have none.

    ``merges`` is the rank file of the same vocabulary.
    """
    where = vocabulary or pre.default_vocabulary(), merges or public_tokenizers.path("byte_bpe_50k.tiktoken")

    @F.arrow_udf("long")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        from dotloom.llm.bpe import blocks

        for batch in batches:
            texts = [t or "" for t in batch.to_pylist()]
            yield pa.array([n for b in blocks(texts) for n in piece_counts(*where).count(b)], pa.int64())

    return count(text)


def count_tokens(docs: DataFrame, limit: int = 512) -> DataFrame:
    """``docs`` with ``n_bytes``, ``n_tokens`` and ``over_limit`` (which replace columns of these names).

    Null text counts as empty; repeated rows and extra columns stay; an empty table stays empty.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.withColumns({"n_bytes": F.octet_length(text).cast("long"), "n_tokens": n_tokens(F.col("text"))}).withColumn(
        "over_limit", F.col("n_tokens") > limit
    )
