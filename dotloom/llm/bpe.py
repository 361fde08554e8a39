"""Byte-pair encoding and decoding by a prefix-sharing trie (operator 1).

Distinct pre-tokens of a block of documents, sorted, are a trie in depth-first order: what a word shares with the one
before it are its ancestors.  The walk gives every node the last token of the encoding of its prefix: the token ``t`` that
ends there and may follow the last token of the prefix without ``t``.  Exactly one such token exists, so one look at the
ancestors replaces the merges, and a prefix that many words share is encoded once.  The tokens that end at a node are
known from the longest end of its prefix that begins a token (an Aho-Corasick automaton of the vocabulary).  Following
last tokens back from a word's node lists its ids.

Documents are never shuffled: each task encodes its own rows block by block, with a bounded memory of chunks.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dotloom.llm import pretokens as pre
from dotloom.llm.common import only, remembers, settle

END = -1  # of a node at which no token ends
LONG_BYTES = 256  # longer pre-tokens are a path of their own, not part of the trie
BLOCK_CHARS = 2_000_000  # characters of text whose unknown pre-tokens share one trie
CACHE_CHUNKS = 300_000
CACHE_PAIRS = 500_000


def byte_alphabet() -> dict[str, int]:
    """Printable stand-ins of byte-level vocabularies: printable Latin-1 bytes stand for themselves."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        to_byte = byte_alphabet()
        self.path = path
        self.ids: dict[bytes, int] = {bytes(to_byte[c] for c in t): i for t, i in model["vocab"].items()}
        self.bytes: dict[int, bytes] = {i: b for b, i in self.ids.items()}
        self.special = pre.specials(path)
        self.bytes |= {i: s.encode() for s, i in self.special.items()}
        self._automaton()
        # a token's merge: its rank and its halves; single bytes have rank -1
        self.rank: dict[int, int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        self.merge: dict[tuple[int, int], int] = {}
        for r, m in enumerate(model["merges"]):
            left, right = (bytes(to_byte[c] for c in x) for x in (m.split(" ") if isinstance(m, str) else m))
            pair, t = (self.ids[left], self.ids[right]), self.ids[left + right]
            self.merge.setdefault(pair, r)
            if t not in self.rank:
                self.rank[t], self.halves[t] = r, pair
        self._follows: dict[tuple[int, int], bool] = {}
        self._whole: dict[int, bool] = {}
        # ids of chunks at the beginning of a text and after a space, of pre-tokens, and of their last generation
        self.first, self.later, self.pieces = {}, {}, {}
        self.old_later: dict[str, bytes] = {}

    def follows(self, a: int, b: int) -> bool:
        """Can ``b`` stand after ``a`` in an encoding?

        Undo the merges of both tokens, latest first.  At every moment the inner edges of the two touch; if they
        have a merge that comes before the edge's own next merge, it would have joined them.  Of equal merges the
        left one comes first.
        """
        known = self._follows.get((a, b))
        if known is not None:
            return known
        rank, never = self.rank, len(self.merge)
        x, y, next_x, next_y, ok = a, b, never, never, True
        while True:
            m = self.merge.get((x, y))
            if m is not None and m < next_x and m <= next_y:
                ok = False
                break
            rx, ry = rank.get(x, -1), rank.get(y, -1)
            if rx < 0 and ry < 0:
                break
            if ry >= rx:
                y, next_y = self.halves[y][0], ry
            else:
                x, next_x = self.halves[x][1], rx
        if len(self._follows) >= CACHE_PAIRS:
            self._follows.clear()
        self._follows[(a, b)] = ok
        return ok

    def whole(self, t: int) -> bool:
        """Is the encoding of the token's bytes the token itself?"""
        known = self._whole.get(t)
        if known is None:
            parts = [self.ids[bytes((b,))] for b in self.bytes[t]]
            while len(parts) > 1:
                r, i = min((self.merge.get(p, len(self.merge)), i) for i, p in enumerate(zip(parts, parts[1:])))
                if r == len(self.merge):
                    break
                parts[i : i + 2] = [self.ids[self.bytes[parts[i]] + self.bytes[parts[i + 1]]]]
            known = self._whole[t] = parts == [t]
        return known

    def _automaton(self) -> None:
        """The vocabulary as a trie, its node 0 the empty string; each node with its longest end that is a node."""
        self.moves: list[dict[int, int]] = [{}]
        own, above = [END], [(0, 0)]
        for token, i in self.ids.items():
            node = 0
            for b in token:
                to = self.moves[node].get(b)
                if to is None:
                    to = self.moves[node][b] = len(own)
                    self.moves.append({})
                    own.append(END)
                    above.append((node, b))
                node = to
            own[node] = i
        #: by node, the tokens that end there with their lengths, longest first
        self.ends: list[tuple[tuple[int, int], ...]] = [()] * len(own)
        self.back = [0] * len(own)
        row = list(self.moves[0].values())
        while row:
            for node in row:
                parent, b = above[node]
                self.back[node] = back = self._from(self.back[parent], b) if parent else 0
                t = own[node]
                self.ends[node] = self.ends[back] if t == END else ((t, len(self.bytes[t])), *self.ends[back])
            row = [to for node in row for to in self.moves[node].values()]

    def _from(self, node: int, b: int) -> int:
        """The node of the longest end of ``node`` prolonged by ``b``."""
        while (to := self.moves[node].get(b)) is None:
            if not node:
                return 0
            node = self.back[node]
        return to

    def walk(self, w: bytes, depth: int, nodes: list[int], last: list[int]) -> None:
        """Fills in nodes and last tokens of the prefixes of ``w`` that are longer than ``depth``."""
        moves, back, ends, follows = self.moves, self.back, self.ends, self._follows
        node = nodes[depth]
        for b in w[depth:]:
            while (to := moves[node].get(b)) is None and node:
                node = back[node]
            node = to or 0
            depth += 1
            for t, n in ends[node]:
                if n == depth:
                    ok = self.whole(t)
                elif (ok := follows.get((last[depth - n], t))) is None:
                    ok = self.follows(last[depth - n], t)
                if ok:
                    break
            else:
                raise ValueError("the vocabulary lacks a byte")
            nodes[depth], last[depth] = node, t

    def traced(self, end: int, last: list[int]) -> array:
        out, token = [], self.bytes
        while end:
            out.append(t := last[end])
            end -= len(token[t])
        return array("i", out[::-1])

    def encode_words(self, words: Iterable[bytes]) -> dict[bytes, array]:
        """Ids of distinct pre-tokens, shared prefixes encoded once."""
        out: dict[bytes, array] = {}
        # for the word at hand, the nodes and last tokens of its prefixes
        nodes, last, before = [0] * (LONG_BYTES + 1), [0] * (LONG_BYTES + 1), b""
        for w in sorted(words):
            if len(w) > LONG_BYTES:
                ends = [0] * (len(w) + 1)
                self.walk(w, 0, [0] * (len(w) + 1), ends)
                out[w] = self.traced(len(w), ends)
                continue
            depth = 0
            for x, y in zip(w, before):
                if x != y:
                    break
                depth += 1
            self.walk(w, depth, nodes, last)
            out[w], before = self.traced(len(w), last), w
        return out

    def segments(self, text: str) -> Iterator[tuple[str, int | None]]:
        """Text between special strings, and the id of the special string after it.

        At one place, the longest special string counts.
        """
        while True:
            found = [(at, -len(s), s) for s in self.special if (at := text.find(s)) >= 0]
            if not found:
                yield text, None
                return
            at, _, s = min(found)
            yield text[:at], self.special[s]
            text = text[at + len(s) :]

    def learn(self, chunks: set[str], lead: str, known: dict[str, bytes]) -> dict[str, bytes]:
        """Remembers the ids of new chunks that follow ``lead``; returns those of chunks too long to remember."""
        cut = pre.letters_cut if lead == " " and not pre.UNUSUAL.search("".join(chunks)) else lambda c: None
        pieces = {c: [p.encode() for p in cut(c) or pre.pretokens(lead + c, self.path)] for c in chunks if lead or c}
        ids = self.pieces
        ids |= self.encode_words({p for ps in pieces.values() for p in ps if p not in ids})
        rare = {"": b""} if "" in chunks and not lead else {}
        for c, ps in pieces.items():
            (known if len(c) <= pre.CACHED_CHARS else rare)[c] = b"".join([ids[p] for p in ps])
        if len(ids) > CACHE_CHUNKS or rare:
            ids.clear()
        return rare

    def encode(self, texts: list[str]) -> list[array]:
        """Ids of every text, in order."""
        if len(self.later) > CACHE_CHUNKS:
            self.old_later, self.later = self.later, {}
            self.first.clear()
        cut = [[(pre.chunks(t), s) for t, s in self.segments(text)] for text in texts]
        new = set().union(*(cs[1:] for doc in cut for cs, _ in doc)).difference(self.later)
        kept = {c: b for c in new if (b := self.old_later.get(c)) is not None}
        self.later |= kept
        rare = self.learn(new.difference(kept), " ", self.later)
        rare_first = self.learn({cs[0] for doc in cut for cs, _ in doc}.difference(self.first), "", self.first)
        out = []
        for doc in cut:
            parts = []
            for cs, s in doc:
                parts.append(self.first[cs[0]] if cs[0] in self.first else rare_first[cs[0]])
                if rare:
                    parts += [self.later[c] if c in self.later else rare[c] for c in cs[1:]]
                else:
                    parts += map(self.later.__getitem__, cs[1:])
                if s is not None:
                    parts.append(array("i", [s]).tobytes())
            out.append(array("i", b"".join(parts)))
        return out

    def decode(self, ids: Iterable[int]) -> str:
        """Text of ids, special tokens as their strings; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _forget() -> None:
    encoder.cache_clear()
    decimals.cache_clear()


remembers("bpe", _forget)


@lru_cache(maxsize=2)
def decimals(path: str) -> dict[int, str]:
    return {i: str(i) for i in encoder(path).bytes}


def blocks(texts: list[str]) -> Iterator[list[str]]:
    block, n = [], 0
    for t in texts:
        block.append(t)
        n += len(t)
        if n >= BLOCK_CHARS:
            yield block
            block, n = [], 0
    if block:
        yield block


def encoded(text: Column, path: str | None = None) -> Column:
    """Ids of a text (array of int); null and empty text give an empty array."""
    where = path or pre.default_vocabulary()

    @F.arrow_udf("array<int>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        only("bpe")
        for batch in batches:
            yield _lists([x for b in blocks([t or "" for t in batch.to_pylist()]) for x in encoder(where).encode(b)])

    return encode(text)


def _lists(ids: list[array]) -> pa.ListArray:
    ends = pa.array([0, *_running(len(x) for x in ids)], pa.int32())
    flat = pa.Array.from_buffers(pa.int32(), ends[-1].as_py(), [None, pa.py_buffer(b"".join(ids))])
    return pa.ListArray.from_arrays(ends, flat)


def checked(text: Column, path: str | None = None) -> Column:
    """Struct of ids and of decoded_sha256, the digest of the text that the ids decode to, in one pass."""
    where = path or pre.default_vocabulary()

    @F.arrow_udf("ids array<int>, decoded_sha256 string")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        only("bpe")
        enc = encoder(where)
        for batch in batches:
            ids = [x for b in blocks([t or "" for t in batch.to_pylist()]) for x in enc.encode(b)]
            digests = [sha256(enc.decode(x).encode()).hexdigest() for x in ids]
            yield pa.StructArray.from_arrays([_lists(ids), pa.array(digests, pa.string())], ["ids", "decoded_sha256"])
        settle()

    return encode(text)


def decoded(ids: Column, path: str | None = None) -> Column:
    """Text of ids; null gives the empty text."""
    where = path or pre.default_vocabulary()

    @F.arrow_udf("string")
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([encoder(where).decode(x or ()) for x in batch.to_pylist()], pa.string())

    return decode(ids)


def round_trip(text: Column, path: str | None = None) -> Column:
    """Encodes, decodes the ids, and keeps digests of both instead of the ids and the text.

    Struct of n_tokens, ids_sha256 (of the decimal ids joined by commas) and decoded_sha256 (of UTF-8).
    """
    where = path or pre.default_vocabulary()

    @F.arrow_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digest(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        only("bpe")
        enc, names = encoder(where), decimals(where)
        for batch in batches:
            n, a, b = [], [], []
            for block in blocks([t or "" for t in batch.to_pylist()]):
                for ids in enc.encode(block):
                    each = ids.tolist()
                    n.append(len(each))
                    a.append(sha256(",".join(map(names.__getitem__, each)).encode()).hexdigest())
                    b.append(sha256(enc.decode(each).encode()).hexdigest())
            yield pa.StructArray.from_arrays(
                [pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())],
                ["n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return digest(text)


def _running(sizes: Iterable[int]) -> Iterator[int]:
    total = 0
    for n in sizes:
        total += n
        yield total


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``docs`` with ``ids`` and ``n_tokens`` (which replace columns of these names).

    Null or empty text has no ids; repeated rows and extra columns stay as they are; an empty table stays empty.
    Whole texts are encoded, however long.
    """
    return docs.withColumn("ids", encoded(F.col("text"), path)).withColumn("n_tokens", F.size("ids").cast("long"))


def decode_documents(df: DataFrame, path: str | None = None) -> DataFrame:
    """``df`` with ``text`` decoded from ``ids``."""
    return df.withColumn("text", decoded(F.col("ids"), path))
