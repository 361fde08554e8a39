"""Text helpers for writing the DuckDB statements of the oracle."""

from __future__ import annotations

import re
from functools import reduce


def q(value: str) -> str:
    """SQL string literal."""
    body = value.replace("'", "''")
    if any(ord(c) < 32 for c in body):
        parts = re.split(r"([\x00-\x1f])", body)
        return "concat(" + ", ".join(
            f"chr({ord(p)})" if len(p) == 1 and ord(p) < 32 else f"'{p}'" for p in parts if p
        ) + ")"
    return f"'{body}'"


def sub(x: str, pattern: str, replacement: str) -> str:
    rep = re.sub(r"\$(\d)", r"\\\1", replacement.replace("\\", "\\\\"))
    return f"regexp_replace({x}, {q(pattern)}, {q(rep)}, 'g')"


def sub_all(x: str, rules: list[tuple[str, str]]) -> str:
    return reduce(lambda acc, rule: sub(acc, *rule), rules, x)


def replace_all(x: str, pairs: list[tuple[str, str]]) -> str:
    return reduce(lambda acc, p: f"replace({acc}, {q(p[0])}, {q(p[1])})", pairs, x)


def matches(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {q(pattern)})"


def extract(x: str, pattern: str, group: int = 1) -> str:
    return f"regexp_extract({x}, {q(pattern)}, {group})"


def extract_all(x: str, pattern: str, group: int = 0) -> str:
    return f"regexp_extract_all({x}, {q(pattern)}, {group})"


def count(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, {q(pattern)}))"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '\\s+'), lambda w: w <> '')"


def map_characters(x: str, table: dict[str, str]) -> str:
    """The cell of every character by look-up, unknown characters kept."""
    single = {k: v for k, v in table.items() if len(v) == 1}
    erased = [k for k, v in table.items() if v == ""]
    out = f"translate({x}, {q(''.join(single) + ''.join(erased))}, {q(''.join(single.values()))})"
    return replace_all(out, [(k, v) for k, v in table.items() if len(v) > 1])
