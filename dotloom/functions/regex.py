"""Regular expressions shared by the scalar functions.

Patterns are written in the subset that means the same everywhere: ``\\b`` is
the ASCII word boundary and ``$`` is the very end of the value.  Java differs
on both, so :func:`java` rewrites those two before a pattern reaches Spark.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, functions as F

_ASCII_BOUNDARY = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"
# what always takes a word character: a letter, a digit or a plain class of them, not repeated or optional
_WORD_NEXT = re.compile(r"(?:[A-Za-z0-9_]|\\[dw]|\[[A-Za-z0-9]+(?:-[A-Za-z0-9]+)*\])(?![*?{])")
_WORD_LAST = re.compile(r"(?:^|[^\\])[A-Za-z0-9_]\Z")
# one of several words that all begin with a letter; what may begin them is a class, which is tested first
_WORDS_NEXT = re.compile(r"\((?:\?:)?((?:[A-Za-z][A-Za-z0-9 ]*\|)*[A-Za-z][A-Za-z0-9 ]*)\)(?![*?{])")
#: What the engine's ``\\s`` takes.
SPACES = " \t\n\x0b\f\r"


def _boundary(pattern: str, i: int) -> str:
    """The word boundary at ``i``; beside a word character only the other side is looked at."""
    if _WORD_NEXT.match(pattern, i + 2):
        return r"(?<!\w)"
    if several := _WORDS_NEXT.match(pattern, i + 2):
        first = sorted({c for word in several[1].split("|") for c in (word[0].lower(), word[0].upper())})
        return rf"(?=[{''.join(first)}])(?<!\w)"
    return r"(?!\w)" if _WORD_LAST.search(pattern[:i]) else _ASCII_BOUNDARY


def _symbols(pattern: str, i: int) -> str | None:
    """The class at ``i`` if it is of signs, many of them beyond Latin-1, and taken once: a range first, then the class itself.

    The engine asks for such signs one by one, before all others, at every character of a text.
    """
    m = re.match(r"\[((?:[^\]\[\\^&-]|(?<!\[)\^|\\-|-(?=\]))+)\](?![*+?{])", pattern[i:])
    far = sorted(c for c in m[1] if c > "\xff") if m else []
    if len(far) < 3 or re.search(r"[A-Za-z0-9]", m[1]):
        return None
    near = "".join(c for c in m[1] if c <= "\xff" and c not in "\\-")
    return f"[{far[0]}-{far[-1]}{near}{'-' if '-' in m[1] else ''}](?<={m[0]})"


def java(pattern: str) -> str:
    """Spell ``\\b`` and ``$`` the way java.util.regex must see them."""
    out, i, in_class = [], 0, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            nxt = pattern[i : i + 2]
            out.append(_boundary(pattern, i) if nxt == r"\b" and not in_class else nxt)
            i += 2
            continue
        if c == "[" and not in_class and (signs := _symbols(pattern, i)):
            out.append(signs)
            i = pattern.index("]", i) + 1
            continue
        if c == "[":
            # a literal '[' inside a class opens a nested class in Java
            out.append(r"\[" if in_class else "[")
            in_class = 1
        elif c == "]" and in_class:
            in_class = 0
            out.append(c)
        elif c == "$" and not in_class:
            out.append(r"\z")
        elif c == "&" and in_class:
            out.append(r"\&")
        else:
            out.append(c)
        i += 1
    return "".join(out)


def matches(col: Column, pattern: str) -> Column:
    return col.rlike(java(pattern))


def sub(col: Column, pattern: str, replacement: str) -> Column:
    return F.regexp_replace(col, java(pattern), replacement)


def sub_all(col: Column, rules: list[tuple[str, str]]) -> Column:
    """Apply (pattern, replacement) rules in order; one pass each, no shuffle."""
    return reduce(lambda c, rule: sub(c, *rule), rules, col)


def extract(col: Column, pattern: str, group: int = 1) -> Column:
    """Group of the first match, '' when there is none."""
    return F.regexp_extract(col, java(pattern), group)


def extract_all(col: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(col, F.lit(java(pattern)), group)


def count(col: Column, pattern: str) -> Column:
    return F.regexp_count(col, F.lit(java(pattern)))


def replace_all(col: Column, pairs: list[tuple[str, str]]) -> Column:
    """Literal replacements in order."""
    return reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), pairs, col)


def strip(col: Column) -> Column:
    """Trim ASCII white space of every kind at both ends."""
    return F.trim(col, F.lit(SPACES))


def rstrip(col: Column) -> Column:
    """Trim ASCII white space of every kind at the end."""
    return F.rtrim(col, F.lit(SPACES))


#: Runs of white space that are more or other than one space; to make each run one space, the others need no change.
UNEVEN_SPACE = r"\s(?:(?<! )\s*+|\s++)"


def words(col: Column) -> Column:
    """Non-empty white-space separated words."""
    return F.filter(F.split(col, r"\s+"), lambda w: w != "")


def text(col: Column | str) -> Column:
    """Null becomes the empty string at every text entry point."""
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(c, F.lit(""))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once however often it is used.

    The end of a fold over nothing: unlike an element of an array that is mapped, its result is not copied.
    """
    return F.aggregate(F.array().cast("array<int>"), value, lambda v, _: v, body)
