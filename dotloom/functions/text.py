"""Text repair and normalisation: Column -> Column, no lambdas unless noted."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import regex as R

# --- fixed values: encoding repair ------------------------------------------
FLORIN = [("ƒ", "f"), ("\U0001d453", "f"), ("Ƙ", "K"), ("¨", "∩")]
QUOTES_AND_DASHES = [
    ("‘", "'"), ("’", "'"), ("“", '"'), ("”", '"'), ("–", "-"), ("—", "-"), ("×", "*"), ("÷", "/"),
]
BREVE, CEDILLA = ("˘", "̆"), ("¸", "̧")
MARKED_LETTERS = [
    ("g", "ğ", BREVE), ("G", "Ğ", BREVE), ("u", "ü", ("̈",)), ("U", "Ü", ("̈",)),
    ("s", "ş", CEDILLA), ("S", "Ş", CEDILLA), ("c", "ç", CEDILLA), ("C", "Ç", CEDILLA),
    ("o", "ö", ("̈",)), ("O", "Ö", ("̈",)),
]
SPACED_MARKS = [
    ("˘ g", "ğ"), ("˘ G", "Ğ"), ("¸ s", "ş"), ("¸ S", "Ş"), ("¸ c", "ç"), ("¸ C", "Ç"),
]
# --- fixed values: mathematics input -----------------------------------------
RAISED_DIGITS = list(zip("⁰¹²³⁴⁵⁶⁷⁸⁹", ["^" + d for d in "0123456789"]))
MATH_INPUT = [
    (r"∫\s*_\{([^}]+)\}\s*\^\{([^}]+)\}\s+(.+?)\s+d([a-zA-Z])\b", "int($3, $4, $1, $2)"),
    (r"∫\s*_([^\s^]+)\s*\^\s*([^\s]+)\s+(.+?)\s+d([a-zA-Z])\b", "int($3, $4, $1, $2)"),
    (r"∫\s+(.+?)\s+d([a-zA-Z])\b", "int($1, $2)"),
    (r"d\s*/\s*d([a-zA-Z])\s*\((.+)\)\s*$", "diff($2, $1)"),
    (r"d\^([0-9]+)\s*/\s*d([a-zA-Z])\^[0-9]+\s*\((.+)\)\s*$", "diff($3, $2, $1)"),
    (r"∂\s*(.+?)\s*/\s*∂([a-zA-Z])", "diff($1, $2)"),
]
PDF_MATH = [
    (r"\r\n", "\n"), (r"ƒ", "f"), (r"∕", "/"), (r"[–—]", "−"),
    (r"\b([A-Za-z])\s*S\s*c\b", "$1→c"), (r"\b([A-Za-z])Sc\b", "$1→c"),
    (r"\b([A-Za-z])\s*->\s*([^\s]+)", "$1→$2"),
    (r"\s*→\s*", "→"), (r"\s*≠\s*", " ≠ "), (r"\s*≤\s*", " ≤ "), (r"\s*≥\s*", " ≥ "),
    (r"\s*=\s*", " = "), (r"\s*/\s*", "/"), (r"[ \t]+", " "), (r"\n{3,}", "\n\n"),
]
# What the rules of broken arrows ask for; the rules before them don't make it.
ARROWS = slice(4, 7)
ARROW_HINT = r"S\s*c"
PDF_SIGNS = r"[\n/=ƒ–—→≠-≥∕]"
# Runs of blanks that are more or other than one space.
BLANKS = r"\t[ \t]*+| [ \t]++"
STRUCTURED_MATH = [
    (r"(?i)\blim\s*x\s*S\s*c\b", "lim x→c"), (r"(?i)\blimxSc\b", "lim x→c"),
    (r"(?i)\blim\s*x\s*S\s*-\s*([0-9]+)", "lim x→-$1"), (r"(?i)\blimxS-([0-9]+)", "lim x→-$1"),
    (r"(?i)\bx\s*S\s*c\b", "x→c"), (r"(?i)\bxSc\b", "x→c"),
    (r"(?i)\bx\s*S\s*-\s*([0-9]+)", "x→-$1"), (r"(?i)\bxS-([0-9]+)", "x→-$1"),
    (r"[ \t]+", " "),
]
LIMIT_ORDER = (r"(?i)\blim\s+(?!x→)(.+?)\s+(x→(?:c|-?\d+))\b", "lim $2 $1")
ROOT_RADICAND = (
    r"√\s*([0-9a-zA-Z^]+(?:\s*[*/·]\s*[0-9a-zA-Z^]+)*\s*[+-]\s*[0-9a-zA-Z^]+)", "√($1)",
)
NTH_ROOTS = [
    (r"√\s*n\s+([A-Za-z]\(x\))", "ⁿ√$1"), (r"√\s*n\s+([A-Z])\b", "ⁿ√$1"),
    (r"√n\s+([A-Za-z]\(x\))", "ⁿ√$1"), (r"√n([A-Z])\b", "ⁿ√$1"),
]
LIMIT_LINE = r"^(.*?\blim)\s+([A-Za-z0-9]+→[A-Za-z0-9+\-−∞]+)\s+(.+)$"
FORMULA_TOKENS = [
    (r"(^|[^\p{L}]):nt(?=\()", "$1int"), (r"(^|[^\p{L}]):nf(?=[^A-Za-z0-9_]|$)", "$1inf"),
    (r"(^|[^\p{L}])l:m(?=\()", "$1lim"), (r"(^|[^\p{L}])s:nh(?=\()", "$1sinh"),
    (r"(^|[^\p{L}])arcs:n(?=\()", "$1arcsin"), (r"\bp:(?=[A-Za-z0-9_]|[\s)\],*+/=-])", "pi"),
]
NOTHING_WORDS = ["null", "none", "unknown", "unclear", "n/a"]
TRUE_WORDS = ["true", "1", "yes"]
# -----------------------------------------------------------------------------


def marker_pairs() -> list[tuple[str, str]]:
    """Letter with a detached mark on either side -> composed letter, in order.

    The diaeresis glyph is absent: it has already become an intersection sign.
    """
    pairs = []
    for letter, composed, marks in MARKED_LETTERS:
        for mark in marks:
            pairs += [(letter + mark, composed), (mark + letter, composed)]
    return pairs + SPACED_MARKS


def fix_encoding(col: Column, q_as_infinity: bool = True) -> Column:
    """Repair of the broken glyph encodings that typeset PDFs carry."""
    t = R.replace_all(R.text(col), FLORIN)
    if q_as_infinity:
        t = F.regexp_replace(t, r"(?<![\p{L}\p{N}_])q(?![\p{L}\p{N}_])", "∞")
    single = {a: b for a, b in QUOTES_AND_DASHES}
    t = F.translate(t, "".join(single), "".join(single.values()))
    t = F.regexp_replace(t, r"[\p{Mn}&&[^̧̆̈]]", "")
    return F.when(
        t.rlike("[˘¸̧̆̈]"), R.replace_all(t, marker_pairs())
    ).otherwise(t)


def normalize_math_input(col: Column) -> Column:
    """Notation -> canonical ``int(...)``, ``diff(...)`` and ``^n`` forms."""
    t = R.replace_all(F.replace(R.text(col), F.lit("−"), F.lit("-")), RAISED_DIGITS)
    return F.when(t.rlike(r"[∫∂]|d\s*/|/\s*d"), R.sub_all(t, MATH_INPUT)).otherwise(t)


def normalize_pdf_math(col: Column) -> Column:
    def repaired(t: Column) -> Column:
        rest = [r for r in PDF_MATH if r not in PDF_MATH[ARROWS]]
        arrows = t.contains("->") | R.matches(t, ARROW_HINT)
        # without any of their signs all rules but that of blanks leave a text as it is
        plain = F.regexp_replace(t, BLANKS, " ")
        return R.strip(F.when(arrows, R.sub_all(t, PDF_MATH)).when(t.rlike(PDF_SIGNS), R.sub_all(t, rest)).otherwise(plain))

    return R.let(R.text(col), repaired)


def repair_formula_tokens(col: Column) -> Column:
    return R.sub_all(R.text(col), FORMULA_TOKENS)


def _squeeze(col: Column) -> Column:
    return R.strip(F.regexp_replace(col, R.UNEVEN_SPACE, " "))


def normalize_structured_math(col: Column) -> Column:
    """Limits before bodies, radicands in parentheses, n-th root signs."""
    t = R.strip(R.sub_all(R.text(col), STRUCTURED_MATH))
    t = _squeeze(R.sub(t, *LIMIT_ORDER))
    t = _squeeze(R.sub(t, *ROOT_RADICAND))
    return _squeeze(R.sub_all(t, NTH_ROOTS))


def limit_display_rows(col: Column) -> Column:
    """A limit line as two display lines (the subscript under ``lim``), else itself."""
    t = F.replace(R.text(col), F.lit("->"), F.lit("→"))
    head, under, rest = (R.extract(t, LIMIT_LINE, g) for g in (1, 2, 3))
    return F.when(
        R.matches(t, LIMIT_LINE),
        F.array(
            F.rtrim(F.concat_ws(" ", head, rest)),
            F.concat(F.repeat(F.lit(" "), F.length(head) - 3), under),
        ),
    ).otherwise(F.array(R.text(col)))


def improve_spacing(col: Column) -> Column:
    """Spacing, blank gaps and bullets, before the final trim."""
    t = F.replace(R.text(col), F.lit("\r\n"), F.lit("\n"))
    return R.sub_all(t, [(r"\t", " "), (r" {2,}", " "), (r"\n{3,}", "\n\n"), (r"[•●▪◦]\s*", "- ")])


def improve_text(col: Column) -> Column:
    return R.strip(improve_spacing(col))


def normalize_line(col: Column) -> Column:
    t = R.replace_all(R.text(col), [("\r\n", "\n"), (" ", " ")])
    return R.rstrip(F.regexp_replace(t, BLANKS, " "))


def clean_optional(col: Column) -> Column:
    """Words that mean nothing become the empty string."""
    t = _squeeze(R.text(col))
    return F.when(F.lower(t).isin(NOTHING_WORDS), "").otherwise(t)


def boolean_word(col: Column) -> Column:
    return F.lower(R.strip(R.text(col))).isin(TRUE_WORDS)


def structure_mode(col: Column, source_type: Column) -> Column:
    """'line-preserved' or 'paragraph' for extracted text."""
    x = F.replace(R.text(col), F.lit("\r\n"), F.lit("\n"))
    lines = F.regexp_count(x, F.lit(r"(?m)^[^\S\n]*\S[^\n]*"))
    # lines whose trimmed length is at most sixty characters
    short = F.regexp_count(x, F.lit(r"(?m)^[^\S\n]*+\S(?:[^\n]{0,58}\S)?[^\S\n]*$"))
    formula = R.matches(x, r"[=∫√π∞≤≥⇔⇒⊂∈]")
    return (
        F.when(source_type == "pdf", "line-preserved")
        .when(lines <= 1, "paragraph")
        .when((short / lines >= 0.55) | formula, "line-preserved")
        .otherwise("paragraph")
    )


def collapse_paragraphs(col: Column) -> Column:
    """Single line breaks become spaces, blank lines stay."""
    t = F.regexp_replace(R.text(col), r"[^\S\n]*\n[^\S\n]*", "\n")
    t = F.regexp_replace(t, r"(?<!\n)\n(?!\n)", " ")
    t = F.regexp_replace(t, r"[^\S\n](?:(?<! )[^\S\n]*+|[^\S\n]++)", " ")
    return R.strip(F.regexp_replace(t, r"\n{3,}", "\n\n"))
