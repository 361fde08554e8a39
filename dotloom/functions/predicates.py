"""Predicates on single lines of text: Column -> boolean (or label) Column."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import regex as R

# --- fixed values: patterns ------------------------------------------------
MATH_LETTERS = "[a-zA-ZçğışıöüÇĞIŞİÖÜ]"
MATH_FUNCTIONS = (
    r"(?i)(sqrt|cbrt|log2|log10|log|ln|sin|cos|tan|asin|acos|atan|sinh|cosh|tanh|abs|ceil|floor"
    r"|exp|lim|sum|prod|gcd|lcm|mod|fact|factorial)\s*\(?"
)
MATH_SHORT_OPERATORS = r"[=^_<>≤≥|]"
MATH_DIGIT_OPERATION = r"\d\s*[+\-*/:·.]\s*\d"
MATH_LETTER_OPERATION = r"[a-zA-Z]\s*[+\-*/=^_]\s*[a-zA-Z0-9]"
MATH_RATIO = r"^\(?\s*[a-zA-Z0-9]+\s*/\s*[a-zA-Z0-9]+\s*\)?$"

FORMULA_SYMBOL = r"[=∫√π∞≤≥⇔⇒⊂∈^_]"
FORMULA_CALL = r"(?i)\b(?:sqrt|log|ln|sin|cos|tan|int)\s*\("
FORMULA_OPERATION = r"(?i)(?:\d|[a-z])\s*[+/*=]\s*(?:\d|[a-z])"
LIST_ITEM = r"(?i)^(\(?\d+[.)]|[a-zçğıöşüÇĞÖŞÜ]\)|[-*•▪◦])"
HEADING_END = r"[.!?;:]$"
SENTENCE_END = r"[.!?…][\"')\]]*$"

LAYOUT_MATH_SYMBOL = r"[=≠≤≥∞∫√±×÷→←↔⇔∈∉^/_]"
LAYOUT_MATH_NAME = r"(?i)\b(?:lim|sin|cos|tan|log|ln|sqrt|int|diff)\b"
LAYOUT_MATH_CALL = r"\b[fgh]\(x\)\b"
RULE_ITEM = r"^\d+\.\s+\S"
CAPTION = r"(?i)^(?:figure|fig\.|table)\s*\d+"
SHORT_EXPLANATION = r"(?i)^(?:by|so|thus|therefore|hence|since|because|using|where|then|now)\b"
EXPLANATORY_LEAD = r"(?i)^(?:in words|that is|this means|note that|in particular|therefore|thus|so)\b"
KEYWORD = (
    r"(?i)^(?:\d+[\s.)-]*)?(?:(worked)\s+)?"
    r"(definition|theorem|example|solution|proof|remark|note|exercise)s?\b[:.\-]?"
)
KEYWORD_TYPES = {
    "definition": "definition_box", "theorem": "theorem", "example": "example",
    "solution": "solution", "proof": "solution", "exercise": "exercise_list",
    "remark": "sidebar_note", "note": "sidebar_note",
}
THEOREM_START = r"^(?:THEOREM|Theorem)\s+\d+"
NOTE_START = r"^\((?:If|Suppose|Let|Assume|For|When|Provided)\b"
NUMBERED_SECTION = r"^\d+(?:\.\d+)+\s+\S"
EXAMPLE_START = r"^(?:(Worked)\s+)?(EXAMPLE|Example)\s+(\d+(?:\.\d+)?)(?:\s*[:.\-]?\s*)?(.*)$"
THEOREM_MATH = r"(?i)lim|ƒ|f\(x\)|g\(x\)|xSc|x→c|=|≠|#|·|\+|-|/|\^|√|[∑∫]"
# The same in two looks: a class of signs, and names behind a class of what begins them.
THEOREM_SIGN = r"[ƒ=≠#·+\-/^√∑∫]"
THEOREM_NAME = r"(?i)(?=[lfgx])(?:lim|f\(x\)|g\(x\)|xSc|x→c)"
CONTINUATION = [
    r"(?i)^x\s*(?:Sc|→c|->c)", r"^[a-zA-Z]\(x\)", r"^[()]", r"^[+\-*/=]",
]
TEXT_BLOCK_TYPES = [
    "chapter_header", "section_header", "paragraph", "definition_box", "theorem", "example",
    "solution", "rule_item", "figure_caption", "sidebar_note", "exercise_list",
]
NEMETH_HINT = r"(?i)[=+\-*/^_()\[\]{}<>]|sqrt|log|ln|sin|cos|tan"
ACCEPTED_EXTENSIONS = ["pdf", "txt", "jpg", "jpeg", "png"]
# -----------------------------------------------------------------------------


#: No rule asks for more words than this.
MOST_WORDS = 11


def _word_count(trimmed: Column) -> Column:
    """Words of a trimmed value, counted up to MOST_WORDS; an empty value has none."""
    # a long line is read as far as its words count
    first = F.when(F.length(trimmed) > 80, F.regexp_extract(trimmed, rf"^(?:\S++\s*+){{1,{MOST_WORDS}}}", 0)).otherwise(trimmed)
    return F.when(trimmed == "", 0).otherwise(F.regexp_count(first, F.lit(r"\S+")))


def _capitalised(trimmed: Column) -> Column:
    """Words that start with a capital letter."""
    return F.regexp_count(trimmed, F.lit(r"(?<!\S)\p{Lu}"))


def is_math_line(col: Column) -> Column:
    """Should this line go to the mathematics code rather than the text code?"""

    # counted by what is left without them: a count of matches makes each letter a value
    letters = lambda t: F.length(t) - F.length(F.regexp_replace(t, MATH_LETTERS + "++", ""))

    def decide(t: Column, n: Column) -> Column:
        prose = (n >= 4) & (letters(t) / F.greatest(F.length(t), F.lit(1)) > 0.4)
        math = (
            R.matches(t, MATH_FUNCTIONS)
            | ((n <= 3) & (R.matches(t, MATH_SHORT_OPERATORS) | R.matches(t, MATH_LETTER_OPERATION)))
            | R.matches(t, MATH_DIGIT_OPERATION)
            | R.matches(t, MATH_RATIO)
        )
        return (t != "") & ~prose & math

    return R.let(R.strip(R.text(col)), lambda t: R.let(_word_count(t), lambda n: decide(t, n)))


def _ends(t: Column, signs: str) -> Column:
    """Does a value end in one of the signs?  Only its end is read."""
    out = t.endswith(signs[0])
    for s in signs[1:]:
        out = out | t.endswith(s)
    return out


def _sentence_end(t: Column) -> Column:
    """SENTENCE_END, from the end."""
    return _ends(F.rtrim(t, F.lit("\"')]")), ".!?…")


def is_formula_like(col: Column) -> Column:
    t = R.text(col)
    # what the longer patterns can't do without is looked for first
    called = t.contains("(") & R.matches(t, FORMULA_CALL)
    return R.matches(t, FORMULA_SYMBOL) | called | (R.matches(t, "[+/*=]") & R.matches(t, FORMULA_OPERATION))


def is_list_like(col: Column) -> Column:
    return R.matches(R.strip(R.text(col)), LIST_ITEM)


def _heading(t: Column) -> Column:
    n = _word_count(t)
    return (
        (F.length(t).between(1, 80)) & ~R.matches(t, HEADING_END)
        & ~R.matches(t, LIST_ITEM) & ~is_formula_like(t) & (n <= 8)
        & ((_capitalised(t) >= F.greatest(F.lit(1), n - 1)) | ~t.rlike(r"\p{Ll}"))
    )


def is_heading(col: Column) -> Column:
    return R.let(R.strip(R.text(col)), _heading)


def is_sentence_terminal(col: Column) -> Column:
    return _sentence_end(R.strip(R.text(col)))


def is_plain_line(col: Column) -> Column:
    """A line that may be part of a paragraph: no formula, list item or heading."""
    return R.let(
        R.strip(R.text(col)),
        lambda t: (t != "") & ~is_formula_like(t) & ~R.matches(t, LIST_ITEM) & ~_heading(t),
    )


def structure_facts(trimmed: Column) -> Column:
    """struct(len, list, formula, head, end, plain) of a trimmed line; the shared tests run once."""

    def derived(v: Column) -> Column:
        t, n, item, formula = (v[k] for k in ("t", "n", "item", "formula"))
        head = (
            F.length(t).between(1, 80) & ~item & ~formula & (n <= 8) & ~R.matches(t, HEADING_END)
            & ((_capitalised(t) >= F.greatest(F.lit(1), n - 1)) | ~t.rlike(r"\p{Ll}"))
        )
        return R.let(
            head,
            lambda h: F.struct(
                F.length(t).alias("len"), item.alias("list"), formula.alias("formula"), h.alias("head"),
                _sentence_end(t).alias("end"), (~item & ~formula & ~h).alias("plain"),
            ),
        )

    return R.let(
        trimmed,
        lambda t: R.let(
            F.struct(t.alias("t"), _word_count(t).alias("n"), R.matches(t, LIST_ITEM).alias("item"), is_formula_like(t).alias("formula")),
            derived,
        ),
    )


def can_merge(current: Column, following: Column) -> Column:
    """Two neighbouring lines that may belong to one paragraph."""
    return is_plain_line(following) & is_plain_line(current)


def is_rule_item(col: Column) -> Column:
    return R.matches(R.strip(R.text(col)), RULE_ITEM)


def _layout_call(t: Column) -> Column:
    return t.contains("(x)") & R.matches(t, LAYOUT_MATH_CALL)


def is_layout_math(col: Column) -> Column:
    t = R.strip(R.text(col))
    return ~R.matches(t, RULE_ITEM) & (
        R.matches(t, LAYOUT_MATH_SYMBOL) | R.matches(t, LAYOUT_MATH_NAME) | _layout_call(t)
    )


def is_equation_step(col: Column) -> Column:
    t = R.strip(R.text(col))
    return R.matches(t, r"^=") | (R.matches(t, r"^[+\-−]") & t.contains("=")) | is_layout_math(t)


def is_prose(col: Column) -> Column:
    t = R.strip(R.text(col))
    n = _word_count(t)
    return ~is_layout_math(t) & ((n >= 7) | (R.matches(t, r"[.!?…]$") & (n >= 4)))


def is_caption(col: Column) -> Column:
    t = R.strip(R.text(col))
    return (F.length(t) <= 110) & R.matches(t, CAPTION)


def keyword_block_type(col: Column) -> Column:
    """Block type announced by the first word of a line, else null."""

    def kind(word: Column) -> Column:
        out = F.lit(None).cast("string")
        for key, value in reversed(list(KEYWORD_TYPES.items())):
            out = F.when(word == key, value).otherwise(out)
        return F.when(word != "", out)

    return R.let(F.lower(R.extract(R.strip(R.text(col)), KEYWORD, 2)), kind)


def is_short_explanation(col: Column) -> Column:
    t = R.strip(R.text(col))
    n = _word_count(t)
    return (
        R.matches(t, SHORT_EXPLANATION) & n.between(2, 7)
        & ~is_layout_math(t) & ~is_caption(t) & keyword_block_type(t).isNull()
    )


def starts_explanatory(col: Column) -> Column:
    return R.matches(R.strip(R.text(col)), EXPLANATORY_LEAD)


def is_layout_heading(col: Column) -> Column:
    t = R.strip(R.text(col))
    n = _word_count(t)
    all_caps = ~t.rlike(r"\p{Ll}") & t.rlike("[A-Z]")
    return (
        (t != "") & (F.length(t) <= 80) & ~R.matches(t, HEADING_END) & ~is_layout_math(t)
        & (n <= 10) & (all_caps | (_capitalised(t) >= F.greatest(F.lit(1), n - 1)))
    )


def is_theorem_start(col: Column) -> Column:
    return R.matches(R.strip(R.text(col)), THEOREM_START)


def is_note_start(col: Column) -> Column:
    return R.matches(R.strip(R.text(col)), NOTE_START)


def is_theorem_math(col: Column) -> Column:
    """Line of a theorem body that reads as mathematics."""
    t = R.strip(R.text(col))
    return (t != "") & (R.matches(t, THEOREM_SIGN) | R.matches(t, THEOREM_NAME) | is_equation_step(t) | is_layout_math(t))


def is_equation_continuation(col: Column) -> Column:
    t = R.strip(R.text(col))
    out = is_theorem_math(t)
    for p in CONTINUATION:
        out = out | R.matches(t, p)
    return (t != "") & out


def is_theorem_boundary(col: Column) -> Column:
    """A line that must end a running theorem."""
    t = R.strip(R.text(col))
    kind = keyword_block_type(t)
    return (
        F.when(t == "", False)
        .when(kind.isNotNull() & (kind != "theorem"), True)
        .when(is_caption(t), True)
        .when(R.matches(t, RULE_ITEM), False)
        .when(R.matches(t, NUMBERED_SECTION), True)
        .otherwise(is_layout_heading(t) & ~R.matches(t, THEOREM_START))
    )


def is_example_boundary(col: Column) -> Column:
    """A line that must end a running example."""
    t = R.strip(R.text(col))
    kind = keyword_block_type(t)
    return (
        F.when(t == "", False)
        .when(kind.isNotNull() & (kind != "example"), True)
        .when(is_caption(t), True)
        .when(R.matches(t, NUMBERED_SECTION), True)
        .otherwise(is_layout_heading(t) & ~R.matches(t, EXAMPLE_START))
    )


def layout_facts(col: Column) -> Column:
    """All layout predicates of a line as one struct.

    Fields: math, any_math, step, prose, short, lead, caption, kw, heading,
    theorem_end, example_end.  The shared parts are computed once per line.
    """

    def derived(v: Column) -> Column:
        t, n, math, caption, kw, rule = (v[k] for k in ("t", "n", "math", "caption", "kw", "rule"))
        full_stop = _ends(t, ".!?…")
        prose = ~math & ((n >= 7) | (full_stop & (n >= 4)))
        short = (
            n.between(2, 7) & ~math & ~caption & kw.isNull() & R.matches(t, SHORT_EXPLANATION)
        )
        shape = (n <= 10) & (F.length(t) <= 80) & (t != "") & ~math
        heading = shape & ~R.matches(t, HEADING_END) & (
            (_capitalised(t) >= F.greatest(F.lit(1), n - 1)) | (~t.rlike(r"\p{Ll}") & t.rlike("[A-Z]"))
        )
        numbered = R.matches(t, NUMBERED_SECTION)
        return R.let(
            heading,
            lambda h: F.struct(
                math.alias("math"), v["any_math"].alias("any_math"),
                (math | t.startswith("=") | (R.matches(t, r"^[+\-−]") & t.contains("="))).alias("step"),
                prose.alias("prose"), short.alias("short"), R.matches(t, EXPLANATORY_LEAD).alias("lead"),
                caption.alias("caption"), kw.alias("kw"), h.alias("heading"), rule.alias("rule"),
                F.when(t == "", False).when(kw.isNotNull() & (kw != "theorem"), True).when(caption, True).when(rule, False)
                .when(numbered, True).otherwise(h & ~R.matches(t, THEOREM_START)).alias("theorem_end"),
                F.when(t == "", False).when(kw.isNotNull() & (kw != "example"), True).when(caption, True)
                .when(numbered, True).otherwise(h & ~R.matches(t, EXAMPLE_START)).alias("example_end"),
            ),
        )

    def shared(t: Column) -> Column:
        found = R.matches(t, LAYOUT_MATH_SYMBOL) | R.matches(t, LAYOUT_MATH_NAME) | _layout_call(t)
        return R.let(
            F.struct(found.alias("m"), R.matches(t, RULE_ITEM).alias("r")),
            lambda f: R.let(
                F.struct(
                    t.alias("t"), _word_count(t).alias("n"), f["m"].alias("any_math"), (f["m"] & ~f["r"]).alias("math"),
                    f["r"].alias("rule"), is_caption(t).alias("caption"), keyword_block_type(t).alias("kw"),
                ),
                derived,
            ),
        )

    return R.let(R.strip(R.text(col)), shared)


def is_math_block_type(col: Column) -> Column:
    return col == "equation_group"


def is_text_block_type(col: Column) -> Column:
    return col.isin(TEXT_BLOCK_TYPES)


def conversion_mode(text: Column, source_type: Column) -> Column:
    return (
        F.when(source_type.isin("image", "camera"), "ocr")
        .when(R.matches(R.text(text), NEMETH_HINT), "nemeth")
        .otherwise("text")
    )


def file_extension(name: Column) -> Column:
    return F.lower(F.element_at(F.split(R.text(name), r"\."), -1))


def accepted_file(name: Column, mime: Column | None = None) -> Column:
    image = F.lit(False) if mime is None else F.coalesce(mime.startswith("image/"), F.lit(False))
    return file_extension(name).isin(ACCEPTED_EXTENSIONS) | image


def source_type(name: Column, mime: Column | None = None) -> Column:
    """Kind of an accepted file, null for a rejected one."""
    image = file_extension(name).isin("jpg", "jpeg", "png")
    if mime is not None:
        image = image | F.coalesce(mime.startswith("image/"), F.lit(False))
    return (
        F.when(image, "image")
        .when(file_extension(name) == "pdf", "pdf")
        .when(file_extension(name) == "txt", "manual")
    )


def page_lookup(raw: Column, total: Column) -> Column:
    """Typed page number -> struct(ok, error, page_index)."""
    t = R.strip(R.text(raw))
    digits = R.matches(t, r"^\d+$")
    # a number too long for a long is certainly out of range
    n = F.when(digits, F.try_to_number(F.substring(F.regexp_replace(t, "^0+", ""), 1, 18), F.lit("9" * 18)).cast("long"))
    n = F.when(t.rlike("^0+\\z"), F.lit(0).cast("long")).otherwise(n)
    too_long = F.length(F.regexp_replace(t, "^0+", "")) > 18
    error = (
        F.when(t == "", "empty")
        .when(~digits, "invalid")
        .when(too_long | (n < 1) | (n > F.greatest(F.lit(0), F.coalesce(total, F.lit(0)))), "out_of_range")
    )
    return F.struct(
        error.isNull().alias("ok"), error.alias("error"),
        F.when(error.isNull(), n - 1).alias("page_index"),
    )
