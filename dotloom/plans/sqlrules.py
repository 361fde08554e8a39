"""The line predicates and text rules as DuckDB expressions."""

from __future__ import annotations

from ..functions import predicates as P
from ..functions import text as B
from . import duck as D


def trim(x: str) -> str:
    return D.strip(x)


def n_words(x: str) -> str:
    return f"len(regexp_extract_all({x}, '\\S+'))"


def n_capital(x: str) -> str:
    return f"len(list_filter(regexp_extract_all({x}, '\\S+'), lambda w: regexp_matches(w, '^\\p{{Lu}}')))"


def any_of(x: str, *patterns: str) -> str:
    return "(" + " OR ".join(D.matches(x, p) for p in patterns) + ")"


def is_math_line(x: str) -> str:
    t = trim(x)
    n = n_words(t)
    return f"""({t} <> '' AND NOT ({n} >= 4 AND {D.count(t, P.MATH_LETTERS)} / length({t}) > 0.4) AND
 ({any_of(t, P.MATH_FUNCTIONS, P.MATH_DIGIT_OPERATION, P.MATH_RATIO)} OR ({any_of(t, P.MATH_SHORT_OPERATORS, P.MATH_LETTER_OPERATION)} AND {n} <= 3)))"""


def is_formula(x: str) -> str:
    return any_of(x, P.FORMULA_SYMBOL, P.FORMULA_CALL, P.FORMULA_OPERATION)


def is_list(x: str) -> str:
    return D.matches(trim(x), P.LIST_ITEM)


def is_heading(x: str) -> str:
    t = trim(x)
    n = n_words(t)
    return f"""({t} <> '' AND length({t}) <= 80 AND NOT {D.matches(t, P.HEADING_END)} AND NOT {is_list(t)} AND NOT {is_formula(t)}
 AND {n} <= 8 AND ({n_capital(t)} >= greatest(1, {n} - 1) OR NOT regexp_matches({t}, '\\p{{Ll}}')))"""


def is_terminal(x: str) -> str:
    return D.matches(trim(x), P.SENTENCE_END)


def plain_line(x: str) -> str:
    """A line that may be part of a paragraph."""
    return f"({trim(x)} <> '' AND NOT {is_formula(trim(x))} AND NOT {is_list(x)} AND NOT {is_heading(x)})"


def is_rule_item(x: str) -> str:
    return D.matches(trim(x), P.RULE_ITEM)


def is_layout_math(x: str) -> str:
    t = trim(x)
    return f"(NOT {D.matches(t, P.RULE_ITEM)} AND {any_of(t, P.LAYOUT_MATH_SYMBOL, P.LAYOUT_MATH_NAME, P.LAYOUT_MATH_CALL)})"


def is_equation_step(x: str) -> str:
    t = trim(x)
    return f"({D.matches(t, '^=')} OR ({D.matches(t, '^[+\\-−]')} AND contains({t}, '=')) OR {is_layout_math(x)})"


def is_prose(x: str) -> str:
    t = trim(x)
    return f"(NOT {is_layout_math(x)} AND ({n_words(t)} >= 7 OR ({D.matches(t, '[.!?…]$')} AND {n_words(t)} >= 4)))"


def is_caption(x: str) -> str:
    return f"(length({trim(x)}) <= 110 AND {D.matches(trim(x), P.CAPTION)})"


def keyword_type(x: str) -> str:
    word = f"lower({D.extract(trim(x), P.KEYWORD, 2)})"
    whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in P.KEYWORD_TYPES.items())
    return f"(CASE {word} {whens} ELSE NULL END)"


def is_short_explanation(x: str) -> str:
    t = trim(x)
    return f"""({D.matches(t, P.SHORT_EXPLANATION)} AND {n_words(t)} BETWEEN 2 AND 7 AND NOT {is_layout_math(x)}
 AND NOT {is_caption(x)} AND {keyword_type(x)} IS NULL)"""


def starts_explanatory(x: str) -> str:
    return D.matches(trim(x), P.EXPLANATORY_LEAD)


def is_layout_heading(x: str) -> str:
    t = trim(x)
    n = n_words(t)
    return f"""({t} <> '' AND length({t}) <= 80 AND NOT {D.matches(t, P.HEADING_END)} AND NOT {is_layout_math(x)} AND {n} <= 10
 AND ((NOT regexp_matches({t}, '\\p{{Ll}}') AND regexp_matches({t}, '[A-Z]')) OR {n_capital(t)} >= greatest(1, {n} - 1)))"""


def is_theorem_math(x: str) -> str:
    return f"({trim(x)} <> '' AND ({D.matches(trim(x), P.THEOREM_MATH)} OR {is_equation_step(x)} OR {is_layout_math(x)}))"


def is_continuation(x: str) -> str:
    return f"({trim(x)} <> '' AND ({is_theorem_math(x)} OR {any_of(trim(x), *P.CONTINUATION)}))"


def is_theorem_boundary(x: str) -> str:
    t, k = trim(x), keyword_type(x)
    return f"""(CASE WHEN {t} = '' THEN false WHEN {k} IS NOT NULL AND {k} <> 'theorem' THEN true WHEN {is_caption(x)} THEN true
 WHEN {is_rule_item(x)} THEN false WHEN {D.matches(t, P.NUMBERED_SECTION)} THEN true
 ELSE {is_layout_heading(x)} AND NOT {D.matches(t, P.THEOREM_START)} END)"""


def is_example_boundary(x: str) -> str:
    t, k = trim(x), keyword_type(x)
    return f"""(CASE WHEN {t} = '' THEN false WHEN {k} IS NOT NULL AND {k} <> 'example' THEN true WHEN {is_caption(x)} THEN true
 WHEN {D.matches(t, P.NUMBERED_SECTION)} THEN true ELSE {is_layout_heading(x)} AND NOT {D.matches(t, P.EXAMPLE_START)} END)"""


def fix_encoding(x: str) -> str:
    t = D.replace_all(x, B.FLORIN)
    for _ in range(2):  # neighbours may share a separator
        t = D.sub(t, r"(^|[^\p{L}\p{N}_])q([^\p{L}\p{N}_]|$)", "$1∞$2")
    t = D.replace_all(t, B.QUOTES_AND_DASHES)
    keep, safe = "̧̆̈", ""
    t = f"translate({t}, '{keep}', '{safe}')"
    t = f"translate({D.sub(t, r'\p{Mn}', '')}, '{safe}', '{keep}')"
    return D.replace_all(t, B.marker_pairs())


def normalize_math_input(x: str) -> str:
    t = D.replace_all(f"replace({x}, '−', '-')", B.RAISED_DIGITS)
    return D.sub_all(t, B.MATH_INPUT)


def normalize_pdf_math(x: str) -> str:
    return trim(D.sub_all(x, B.PDF_MATH))


def normalize_structured_math(x: str) -> str:
    """A limit that its subscript follows at once is marked, so that the rule for late subscripts passes it by."""
    squeeze = lambda t: trim(D.sub(t, r"\s+", " "))
    t = trim(D.sub_all(x, B.STRUCTURED_MATH))
    marked = f"regexp_replace({t}, '(?i)\\b(lim)(\\s+x→)', '\\1' || chr(1) || '\\2', 'g')"
    late = D.sub(marked, B.LIMIT_ORDER[0].replace("(?!x→)", ""), B.LIMIT_ORDER[1])
    t = squeeze(f"replace({late}, chr(1), '')")
    t = squeeze(D.sub(t, *B.ROOT_RADICAND))
    return squeeze(D.sub_all(t, B.NTH_ROOTS))


def formula_tokens(x: str) -> str:
    rules = [
        (r"(^|[^\p{L}]):nt\(", "$1int("), (r"(^|[^\p{L}]):nf([^A-Za-z0-9_]|$)", "$1inf$2"),
        (r"(^|[^\p{L}]):nf([^A-Za-z0-9_]|$)", "$1inf$2"),
        (r"(^|[^\p{L}])l:m\(", "$1lim("), (r"(^|[^\p{L}])s:nh\(", "$1sinh("),
        (r"(^|[^\p{L}])arcs:n\(", "$1arcsin("), (r"\bp:([A-Za-z0-9_\s)\],*+/=-])", "pi$1"),
    ]
    return D.sub_all(x, rules)


def improve_spacing(x: str) -> str:
    return D.sub_all(
        f"replace({x}, chr(13) || chr(10), chr(10))",
        [(r"\t", " "), (r" {2,}", " "), (r"\n{3,}", "\n\n"), (r"[•●▪◦]\s*", "- ")],
    )


def normalize_line(x: str) -> str:
    t = f"replace(replace({x}, chr(13) || chr(10), chr(10)), ' ', ' ')"
    return D.sub(D.sub(t, r"[ \t]+", " "), r"\s+$", "")


def clean_optional(x: str) -> str:
    t = trim(D.sub(x, r"\s+", " "))
    words = ", ".join(D.q(w) for w in B.NOTHING_WORDS)
    return f"CASE WHEN lower({t}) IN ({words}) THEN '' ELSE {t} END"
