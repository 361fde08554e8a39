"""Cuts text into chunks that can be tokenised on their own, and chunks into pre-tokens.

A single space between two characters that are no white space always begins a new pre-token of byte-level
BPE, so a text splits there without a regular expression; the pre-tokens of a distinct chunk are found once.
"""

from __future__ import annotations

import re
from functools import lru_cache

import public_tokenizers
import regex
from tokenizers import Tokenizer

#: Outside these, the library's own pre-tokeniser decides, whatever Unicode version it follows.
UNUSUAL = re.compile("[^\t-\r -~À-ÖØ-öø-ſ]")
IRREGULAR = re.compile(r"\s\s|^\s|\s$")
#: Longer chunks are rare and are not remembered.
CACHED_CHARS = 64


def default_vocabulary() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=4)
def library(path: str) -> Tokenizer:
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def specials(path: str) -> dict[str, int]:
    """Strings that the library takes out of a text before pre-tokenising, with their ids."""
    return {t.content: i for i, t in library(path).get_added_tokens_decoder().items()}


@lru_cache(maxsize=1)
def _pattern() -> regex.Pattern:
    return regex.compile(public_tokenizers.PATTERN)


def pretokens(chunk: str, path: str) -> list[str]:
    """Pre-tokens of a chunk, in order."""
    if UNUSUAL.search(chunk):
        return [chunk[a:b] for _, (a, b) in library(path).pre_tokenizer.pre_tokenize_str(chunk)]
    return _pattern().findall(chunk)


#: One of these after letters is a pre-token, whatever it is.
_SIGNS = frozenset("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")


def letters_cut(chunk: str) -> list[str] | None:
    """Pre-tokens, after a space, of a chunk of letters and at most one sign behind them; None for any other chunk.

    Only for chunks without a character of ``UNUSUAL``.
    """
    if chunk.isalpha():
        return [f" {chunk}"]
    word, sign = chunk[:-1], chunk[-1:]
    return [f" {word}", sign] if sign in _SIGNS and word.isalpha() else None


def chunks(text: str) -> list[str]:
    """Chunks of a text without special strings; all but the first leave out the space they begin with.

    White space next to white space stays inside one chunk.
    """
    parts = text.split(" ")
    if not IRREGULAR.search(text):
        return parts
    out = [parts[0]]
    for p in parts[1:]:
        if p and not p[0].isspace() and out[-1] and not out[-1][-1].isspace():
            out.append(p)
        else:
            out[-1] = f"{out[-1]} {p}"
    return out
