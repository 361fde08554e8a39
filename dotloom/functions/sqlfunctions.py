"""The rules as SQL functions of a session.

A rule is a column expression of its arguments, and a column writes itself as an expression over named functions.
Registered as a temporary SQL function, that expression is what Catalyst puts in place of a call: no Python runs, and
filters over a rule are pushed and folded as if it had been written out.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, SparkSession, functions as F

from . import equations as E
from . import graphs as G
from . import language as L
from . import mathcode as M
from . import predicates as P
from . import quality as Q
from . import text as B
from . import transcode as X
from . import wordrepair as WR

#: Name, rule and arguments (strings, unless their type is given).
RULES: dict[str, tuple[Callable[..., Column], tuple[str, ...]]] = {
    # text repair
    "fix_encoding": (B.fix_encoding, ("text",)),
    "normalize_math_input": (B.normalize_math_input, ("text",)),
    "normalize_pdf_math": (B.normalize_pdf_math, ("text",)),
    "repair_formula_tokens": (B.repair_formula_tokens, ("text",)),
    "normalize_structured_math": (B.normalize_structured_math, ("text",)),
    "improve_text": (B.improve_text, ("text",)),
    "normalize_line": (B.normalize_line, ("text",)),
    "clean_optional": (B.clean_optional, ("text",)),
    "extraction_shape": (B.structure_mode, ("text", "source")),
    "repair_text": (WR.repair_text, ("text",)),
    # transcoding
    "to_braille_strict": (X.to_braille_strict, ("text",)),
    "to_braille_lenient": (X.to_braille_lenient, ("text",)),
    "cells_to_brf": (X.cells_to_brf, ("cells",)),
    "linear_math_to_cells": (M.linear_math_to_cells, ("text",)),
    "is_math_line": (P.is_math_line, ("text",)),
    # predicates of lines
    "is_formula_like": (P.is_formula_like, ("text",)),
    "is_list_like": (P.is_list_like, ("text",)),
    "is_heading": (P.is_heading, ("text",)),
    "is_sentence_terminal": (P.is_sentence_terminal, ("text",)),
    "can_merge": (P.can_merge, ("current", "following")),
    "is_layout_math": (P.is_layout_math, ("text",)),
    "is_equation_step": (P.is_equation_step, ("text",)),
    "is_prose": (P.is_prose, ("text",)),
    "is_short_explanation": (P.is_short_explanation, ("text",)),
    "starts_explanatory": (P.starts_explanatory, ("text",)),
    "is_caption": (P.is_caption, ("text",)),
    "is_layout_heading": (P.is_layout_heading, ("text",)),
    "is_rule_item": (P.is_rule_item, ("text",)),
    "keyword_block_type": (P.keyword_block_type, ("text",)),
    "is_theorem_boundary": (P.is_theorem_boundary, ("text",)),
    "is_example_boundary": (P.is_example_boundary, ("text",)),
    "is_equation_continuation": (P.is_equation_continuation, ("text",)),
    "conversion_mode": (P.conversion_mode, ("text", "source")),
    "accepted_file": (P.accepted_file, ("name",)),
    "file_source_type": (P.source_type, ("name",)),
    "page_lookup": (P.page_lookup, ("raw", "total bigint")),
    # quality, language and tags
    "is_math_heavy": (Q.is_math_heavy, ("text",)),
    "math_quality_score": (Q.math_quality_score, ("text",)),
    "is_severely_corrupted": (Q.is_severely_corrupted, ("text",)),
    "readability": (Q.readability, ("text", "source")),
    "has_enough_text": (Q.has_enough_text, ("text",)),
    "detect_language": (lambda t: L.detect_language(L.language_scores(t)), ("text",)),
    "normalize_tag": (L.normalize_tag, ("tag",)),
    "normalize_tags": (L.normalize_tags, ("tags array<string>",)),
    # equations and charts
    "equation_type": (E.equation_type, ("equation",)),
    "chart_kind": (G.chart_kind, ("text",)),
    "extract_equation": (G.extract_equation, ("text",)),
}

_LITERAL = re.compile(r"'(?:[^'\\]|\\.)*'", re.S)
#: Operators that a column writes as functions; as names of functions they need quotes.
_OPERATOR = re.compile(r"(?<![\w`.])(and|or|not|in|div|when|between|like|rlike|<=>|<=|>=|<>|!=|==|=|<|>|\+|-|\*|/|%|!|~|&|\||\^)\(")

#: Doubles, which without their suffix would be decimals.
_DOUBLE = re.compile(r"(?<![\w.`])\d+\.\d+(?:E[-+]?\d+)?(?![\w.])")


def expression(column: Column) -> str:
    """SQL of a column: its own text, with operators called by their quoted names and doubles marked as such."""
    own = str(column).removeprefix("Column<'").removesuffix("'>")
    spelled = lambda t: _DOUBLE.sub(r"\g<0>D", _OPERATOR.sub(r"`\1`(", t))
    out, at = [], 0
    for m in _LITERAL.finditer(own):
        out += [spelled(own[at : m.start()]), m.group()]
        at = m.end()
    return "".join([*out, spelled(own[at:])])


def register_sql_functions(spark: SparkSession, prefix: str = "") -> list[str]:
    """Make every rule a temporary SQL function ``<prefix><name>`` of the session; gives their names."""
    empty = spark.range(0)
    for name, (rule, arguments) in RULES.items():
        typed = [a if " " in a else f"{a} string" for a in arguments]
        names = [a.split(" ")[0] for a in arguments]
        row = empty.selectExpr(*[f"cast(null as {t.split(' ', 1)[1]}) as {n}" for n, t in zip(names, typed)])
        result = rule(*map(F.col, names))
        kind = row.select(result.alias("x")).schema["x"].dataType.simpleString()
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({', '.join(typed)}) RETURNS {kind} RETURN {expression(result)}")
    return [f"{prefix}{n}" for n in RULES]
