"""Finds and removes passages of test items in documents (operator 13).

Texts become words: A-Z is lower-cased and every ASCII character that is no letter or digit separates.  The items of a
block go into one generalised suffix automaton, and the words of a document stream through it.  The automaton always
knows the longest run of words, ending at the present one, that stands in some item; where that is as long as a window,
the run's words are hit, and the state of the last ``window`` words names the items that hold them.  An item shorter
than a window has to occur whole: its state is marked, and the marks along the suffix links are tried too.

Items are cut into blocks of bounded size (a long item into pieces that overlap by a window less one word, so no window
is lost), and each pass over the documents takes a bounded number of automata.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dotloom.llm.common import ship, written

WINDOW = 10
#: Words of test items in an automaton, about, and automata in one pass over the documents.
BLOCK_WORDS, AT_ONCE = 1 << 18, 8
#: Words of a piece of an item.
PIECE_WORDS = 4096
#: Bytes of a document that are words at a time.
CHUNK = 1 << 20

_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_WORD = re.compile(rb"[^ ]+")


def words(text: bytes) -> Iterator[bytes]:
    """Words of a UTF-8 text in order; every byte of a character beyond ASCII is part of a word."""
    start = 0
    while start < len(text):
        piece = text[start : start + CHUNK].translate(_LETTERS)
        cut = len(piece) if start + CHUNK >= len(text) else piece.rfind(b" ") + 1
        while not cut:  # a word longer than the chunk
            piece = text[start : start + len(piece) + CHUNK].translate(_LETTERS)
            cut = len(piece) if start + len(piece) >= len(text) else piece.rfind(b" ") + 1
        yield from piece[:cut].split()
        start += cut


@dataclass
class Automaton:
    """Generalised suffix automaton of items in word numbers.

    Most states lead on by a single word, so that word and its state lie in two arrays and only the others have a
    dictionary.
    """

    vocabulary: dict[bytes, int] = field(default_factory=dict)
    length: array = field(default_factory=lambda: array("i", [0]))
    link: array = field(default_factory=lambda: array("i", [-1]))
    only: array = field(default_factory=lambda: array("i", [-1]))
    then: array = field(default_factory=lambda: array("i", [0]))
    more: dict[int, dict[int, int]] = field(default_factory=dict)
    #: State of the last ``window`` words of a state at least that long, else -1.
    window_state: array = field(default_factory=lambda: array("i"))
    #: Nearest state among a state and those its links lead to at which a short item is whole, else -1.
    mark: array = field(default_factory=lambda: array("i"))
    #: Items whose windows a window state holds.
    holders: dict[int, tuple[str, ...]] = field(default_factory=dict)
    #: Length and items of the short items that are whole at a marked state.
    shorts: dict[int, list[tuple[int, tuple[str, ...]]]] = field(default_factory=dict)

    def step(self, state: int, word: int) -> int:
        if self.only[state] == word:
            return self.then[state]
        return self.more[state].get(word, -1) if state in self.more else -1

    def lead(self, state: int, word: int, target: int) -> None:
        if self.only[state] in (-1, word):
            self.only[state], self.then[state] = word, target
        else:
            self.more.setdefault(state, {})[word] = target

    def _state(self, length: int, like: int | None = None) -> int:
        self.length.append(length)
        self.link.append(-1 if like is None else self.link[like])
        self.only.append(-1 if like is None else self.only[like])
        self.then.append(0 if like is None else self.then[like])
        new = len(self.length) - 1
        if like in self.more:
            self.more[new] = dict(self.more[like])
        return new

    def _divide(self, state: int, target: int, word: int) -> int:
        """The state of the words of ``state`` and ``word`` alone, where ``target`` holds longer runs as well."""
        if self.length[state] + 1 == self.length[target]:
            return target
        copy = self._state(self.length[state] + 1, target)
        self.link[target] = copy
        while state != -1 and self.step(state, word) == target:
            self.lead(state, word, copy)
            state = self.link[state]
        return copy

    def append(self, last: int, word: int) -> int:
        """Add one word after ``last``, the state of the item so far."""
        target = self.step(last, word)
        if target != -1:
            return self._divide(last, target, word)
        new, state = self._state(self.length[last] + 1), last
        while state != -1 and self.step(state, word) == -1:
            self.lead(state, word, new)
            state = self.link[state]
        self.link[new] = 0 if state == -1 else self._divide(state, self.step(state, word), word)
        return new


def build(items: Iterable[tuple[str, list[bytes], bool]], window: int = WINDOW) -> Automaton:
    """Automaton of (item, its words, whether these are the whole item)."""
    a = Automaton()
    coded = [(name, array("i", [a.vocabulary.setdefault(w, len(a.vocabulary)) for w in ws]), whole) for name, ws, whole in items]
    for _, ws, _ in coded:
        last = 0
        for w in ws:
            last = a.append(last, w)
    n = len(a.length)
    a.window_state, a.mark = array("i", [-1]) * n, array("i", [-1]) * n
    by_length = sorted(range(1, n), key=a.length.__getitem__)
    for s in by_length:
        if a.length[s] >= window:
            a.window_state[s] = s if a.length[a.link[s]] < window else a.window_state[a.link[s]]
    holders: dict[int, set[str]] = {}
    shorts: dict[int, dict[int, set[str]]] = {}
    for name, ws, whole in coded:
        if len(ws) < window and not whole:
            continue
        state = run = 0
        for w in ws:
            state, run = a.step(state, w), run + 1
            if run >= window:
                holders.setdefault(a.window_state[state], set()).add(name)
        if whole and 0 < len(ws) < window:
            shorts.setdefault(state, {}).setdefault(len(ws), set()).add(name)
    for s in by_length:
        a.mark[s] = s if s in shorts else a.mark[a.link[s]]
    a.holders = {s: tuple(sorted(v)) for s, v in holders.items()}
    a.shorts = {s: sorted((m, tuple(sorted(v))) for m, v in own.items()) for s, own in shorts.items()}
    return a


def scan(a: Automaton, text: Iterable[bytes], window: int = WINDOW) -> tuple[int, list[list[int]], set[str]]:
    """Number of words, hit spans [first, end) in order without overlaps, and items of which a window occurs."""
    number, length, link, only, then, more = a.vocabulary.get, a.length, a.link, a.only, a.then, a.more
    spans: list[list[int]] = []
    seen: set[int] = set()
    items: set[str] = set()
    state = run = 0
    at = -1
    for at, w in enumerate(map(number, text)):
        if w is None:
            state = run = 0
            continue
        while True:
            if only[state] == w:
                state, run = then[state], run + 1
                break
            to = more[state].get(w) if state in more else None
            if to is not None:
                state, run = to, run + 1
                break
            if not state:
                run = 0
                break
            state = link[state]
            run = length[state]
        if not state:
            continue
        best = 0
        if run >= window:
            best, held = run, a.window_state[state]
            if held not in seen:
                seen.add(held)
                items.update(a.holders[held])
        marked = a.mark[state]
        while marked > 0:
            for m, names in a.shorts[marked]:
                if m <= run:
                    best = max(best, m)
                    items.update(names)
            marked = a.mark[link[marked]]
        if best:
            first = at + 1 - best
            while spans and spans[-1][1] >= first:
                first = min(first, spans.pop()[0])
            spans.append([first, at + 1])
    return at + 1, spans, items


def merged(spans: Iterable[Iterable[int]]) -> list[list[int]]:
    """Spans in order, those that touch or overlap as one."""
    out: list[list[int]] = []
    for first, end in sorted(map(tuple, spans)):
        if out and out[-1][1] >= first:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([first, end])
    return out


def pieces(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """item, text and ``whole``: distinct items, long ones in pieces of PIECE_WORDS words that share window - 1 words."""
    run = F.transform(
        F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("w") - window), F.lit(PIECE_WORDS - window + 1)),
        lambda i: F.array_join(F.slice("w", i + 1, PIECE_WORDS), " "),
    )
    separated = F.array_remove(F.split(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), _SEPARATORS), "")
    return (
        items.select(F.col("item_id").cast("string").alias("item"), "text").where("item is not null and text is not null").distinct()
        .withColumn("w", separated).where(F.size("w") > 0)
        .select("item", F.explode(run).alias("text"), (F.size("w") <= PIECE_WORDS).alias("whole"), F.size("w").alias("n"))
        .withColumn("n", F.least("n", F.lit(PIECE_WORDS)))
    )


_SEPARATORS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
_FOUND = "doc_id {0}, h long, n_words long, spans array<array<int>>, items array<string>"


def _pass(docs: DataFrame, automata: list[Automaton], window: int, every: bool) -> DataFrame:
    """Words, spans and items of every document, or of those with a hit."""
    shared = docs.sparkSession.sparkContext.broadcast(automata)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column("text"):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                found = [scan(a, words(raw), window) for a in shared.value]
                spans = found[0][1] if len(found) == 1 else merged(s for _, own, _ in found for s in own)
                rows.append((found[0][0], spans, sorted(set().union(*(i for _, _, i in found)))))
            kept = [i for i, r in enumerate(rows) if every or r[1]]
            columns = [pa.array([rows[i][k] for i in kept], t) for k, t in enumerate((pa.int64(), pa.list_(pa.list_(pa.int32())), pa.list_(pa.string())))]
            ids = [batch.column(c).take(pa.array(kept, pa.int64())) for c in ("doc_id", "h")]
            yield pa.RecordBatch.from_arrays([*ids, *columns], ["doc_id", "h", "n_words", "spans", "items"])

    given = docs.select("doc_id", F.xxhash64("text").alias("h"), F.col("text").cast("binary").alias("text"))
    return given.mapInArrow(run, _FOUND.format(docs.schema["doc_id"].dataType.simpleString()))


def find(docs: DataFrame, items: DataFrame, window: int = WINDOW, keep_hash: bool = False) -> DataFrame:
    """doc_id, n_words, spans (word numbers from 0, end exclusive) and items, sorted, of every row of ``docs``.

    ``items`` has item_id and text.  Null texts have no words, items without words are never found, nor are items
    without an id; repeated items count once, and texts under one id are all that id's.  Repeated documents each have
    a row.  Empty tables give no rows, or documents without hits.  Only doc_id and text of ``docs`` are looked at.

    The driver builds one block's automata at a time, at most AT_ONCE x about BLOCK_WORDS words; more blocks mean more passes.
    The passes after the first return hits only, which are added by doc_id and hash of the text.
    """
    ship(docs.sparkSession)
    parts = written(pieces(items, window))
    total = parts.agg(F.sum("n")).first()[0] or 0
    blocks = -(-total // BLOCK_WORDS) or 1
    number = F.pmod(F.xxhash64("item", "text"), F.lit(blocks))
    parts = parts.withColumn("block", number)
    out, more = None, []
    for start in range(0, blocks, AT_ONCE):
        automata = []
        for b in range(start, min(start + AT_ONCE, blocks)):
            own = parts.where(F.col("block") == b).orderBy("item", "text").select("item", "text", "whole").toLocalIterator()
            automata.append(build(((r.item, list(words(r.text.encode())), r.whole) for r in own), window))
        found = _pass(docs, automata, window, every=out is None)
        if out is None:
            out = found
        else:
            more.append(found)
    for found in more:
        out = _added(out, written(found))
    return out if keep_hash else out.drop("h")


def _union(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([x if y is None else merged([*x, *y]) for x, y in zip(a, b)])


def _added(out: DataFrame, found: DataFrame) -> DataFrame:
    """``out`` with the hits of another pass; rows with the same doc_id and text have the same hits."""
    by = found.dropDuplicates(["doc_id", "h"]).toDF("d2", "h2", "n2", "s2", "i2")
    met = out.join(by, F.col("doc_id").eqNullSafe(F.col("d2")) & F.col("h").eqNullSafe(F.col("h2")), "left")
    items = F.when(F.col("i2").isNull(), F.col("items")).otherwise(F.array_sort(F.array_union("items", "i2")))
    return met.select("doc_id", "h", "n_words", F.pandas_udf(_union, "array<array<int>>")("spans", "s2").alias("spans"), items.alias("items"))


def without_spans(text: bytes, spans: list[list[int]], longest: int) -> bytes:
    """The text without its hit spans of more than ``longest`` words; all else stays, so no two words become one."""
    gone = [s for s in spans if s[1] - s[0] > longest]
    out, kept, at = [], 0, 0
    for i, m in enumerate(_WORD.finditer(text.translate(_LETTERS))):
        if at == len(gone):
            break
        if i == gone[at][0]:
            out.append(text[kept : m.start()])
        if i == gone[at][1] - 1:
            kept, at = m.end(), at + 1
    return b"".join([*out, text[kept:]])


def hit_words(spans: str = "spans") -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda s, x: s + x[1] - x[0])


def clean(docs: DataFrame, items: DataFrame, window: int = WINDOW, longest: int = 0, coverage: float = 0.5) -> DataFrame:
    """``docs`` without the passages of ``items``.

    Hit spans of more than ``longest`` words leave the text; documents of whose words more than the share ``coverage``
    is hit leave the table.  All other columns and rows stay as they are, whatever their names; null texts stay null.
    """
    hits = find(docs, items, window, keep_hash=True).where(F.size("spans") > 0).dropDuplicates(["doc_id", "h"])
    hits = written(hits.select("doc_id", "h", F.struct((hit_words() / F.col("n_words")).alias("share"), "spans").alias("hit")))

    @F.pandas_udf("string")
    def cut(text: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([t if s is None else without_spans(t.encode(), s, longest).decode() for t, s in zip(text, spans)], dtype=object)

    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    same = F.col("row.doc_id").eqNullSafe(F.col("doc_id")) & F.xxhash64("row.text").eqNullSafe(F.col("h"))
    met = rows.join(hits, same, "left").where("hit is null or hit.share <= " + repr(float(coverage)))
    return met.select(F.col("row").withField("text", cut("row.text", "hit.spans")).alias("row")).select("row.*")
