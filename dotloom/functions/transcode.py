"""Text and linear mathematics to Braille cells, as plain column expressions.

The text profiles are written without lambdas: a handful of regular-expression
passes put the capital and number signs in place, then ``translate`` maps the
characters.  Nothing here shuffles, and whole documents go through one
projection.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import cells as C
from . import regex as R

# Word characters of the strict profile and their upper-case part; texts without
# Greek use the shorter classes, which the regex engine tests much faster.
LATIN_WORD = "a-zA-ZçğışıöüÇĞIŞİÖÜ"
LATIN_UPPER = "A-ZÇĞŞİÖÜ"
WORD = "a-zA-ZçğışıöüÇĞIŞİÖÜ\u0370-\u03ff"
UPPER = "A-ZÇĞŞİÖÜ\u0386\u0388-\u038f\u0391-\u03ab\u03d2-\u03d4\u03f4\u03f7\u03f9\u03fa\u03fd-\u03ff"
# Spaces that the strict tokenizer does not know.
_ODD_SPACES = "\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# What the strict profile drops: letters, numbers and spaces outside its classes.
# The first set lets plain ASCII fail at once.
DROPPED = (
    rf"[[_\x1c-\x1f\x80-\x{{10ffff}}]&&[\p{{L}}\p{{N}}_{_ODD_SPACES}]&&[^{WORD}\p{{Nd}}]]+"
)
# White space of the lenient profile.
LENIENT_SPACE = "\\s\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"


# Some character outside ASCII and the Latin letters: one class, no alternation,
# which is what makes the test cheap.
_ODD = "[\\x80-\\xbf×÷\\u0250-\\uffff]"


def _is_ascii(col: Column) -> Column:
    """As many bytes as characters: decides without scanning the characters."""
    return F.octet_length(col) == F.length(col)


def _map_characters(col: Column, table: dict[str, str], probe: Column | None = None) -> Column:
    """Character -> cells: one ``translate`` for the single-cell entries, one
    ``replace`` each for the multi-cell entries.  Rare multi-cell symbols sit
    behind one test of ``probe`` (the text before any rewriting), so ordinary
    prose never scans for them."""
    single = {k: v for k, v in table.items() if len(v) == 1}
    erased = [k for k, v in table.items() if v == ""]
    multi = {k: v for k, v in table.items() if len(v) > 1}
    common = {k: v for k, v in multi.items() if k.isascii()}
    rare = {k: v for k, v in multi.items() if not k.isascii()}
    seen = col if probe is None else probe
    some = lambda signs: seen.rlike("[" + "".join(f"\\{k}" for k in signs) + "]")
    if rare and max(rare) <= "\xff":
        common, rare = multi, {}
    # cells are in no table, so the order is free: replace while the text is short
    out = F.when(some(common), R.replace_all(col, list(common.items()))).otherwise(col) if common else col
    if rare:
        odd = ~_is_ascii(seen) & seen.rlike(_ODD)
        out = F.when(odd, R.replace_all(out, list(rare.items()))).otherwise(out)
    return F.translate(out, "".join(single) + "".join(erased), "".join(single.values()))


def _strict_by_token(col: Column) -> Column:
    """Token-by-token form of the strict profile, for values in which an
    all-capital word holds Greek letters (those letters keep their own form)."""
    tokens = F.regexp_extract_all(
        col, F.lit(rf"[{WORD}]+|\p{{Nd}}+|[ \n\r\t\x0B\f]|[^\s\p{{L}}\p{{N}}_{_ODD_SPACES}]"), 0
    )
    letters = {**C.letter_cells("strict"), **C.DIGITS}
    plain = {**C.LATIN, **C.TURKISH}
    caps_source = "".join(plain) + "".join(k.upper() for k in plain if k not in "iı") + "Iİ"
    caps_target = (
        "".join(plain.values())
        + "".join(v for k, v in plain.items() if k not in "iı")
        + C.TURKISH["ı"] + C.LATIN["i"]
    )

    def one(tokens: Column, tok: Column, i: Column) -> Column:
        before = F.when(i >= 1, F.get(tokens, i - 1)).otherwise("")
        before2 = F.when(i >= 2, F.get(tokens, i - 2)).otherwise("")
        script = before == "^"
        mapped = _map_characters(tok, letters)
        digits = (~script) & (~before.rlike(r"^\p{Nd}") | (before2 == "^"))
        return (
            F.when(
                tok.rlike(rf"^[{WORD}]*[{UPPER}][{WORD}]*\z")
                & ~tok.rlike(r"\p{Ll}") & (F.length(tok) > 1),
                F.concat(F.lit(C.CAPITAL * 2), F.lower(F.translate(tok, caps_source, caps_target))),
            )
            .when(
                tok.rlike(rf"^[{WORD}]"),
                F.when(script, mapped).otherwise(
                    _map_characters(F.regexp_replace(tok, f"[{UPPER}]", C.CAPITAL + "$0"), letters)
                ),
            )
            .when(tok.rlike(r"^\p{Nd}"), F.concat(F.when(digits, C.NUMBER).otherwise(""), mapped))
            .otherwise(_map_characters(tok, C.STRICT_SYMBOLS))
        )

    return F.array_join(R.let(tokens, lambda ts: F.transform(ts, lambda t, i: one(ts, t, i))), "")


def _strict_by_passes(x: Column, word: str, upper: str, letters: dict[str, str]) -> Column:
    # '_' is itself dropped, so it can stand for any dropped run until the end;
    # plain ASCII text has nothing else to drop
    t = F.when(_is_ascii(x) & ~x.contains("__") & ~x.rlike("[\\x1c-\\x1f]"), x).otherwise(
        F.regexp_replace(x, DROPPED, "_")
    )
    # one number sign per digit run, none right after '^'
    t = F.regexp_replace(t, r"\p{Nd}(?<!\p{Nd}.)(?<!\^_?.)\p{Nd}*+(?:_\p{Nd}+)*", C.NUMBER + "$0")
    # all-capital words get one sign in a first pass and the second one with the others
    signed = F.regexp_replace(t, rf"(?=[{upper}]{{2}})(?<![{word}])(?=[{upper}]{{2,}}(?![{word}]))", C.CAPITAL)
    signed = F.regexp_replace(signed, rf"[{upper}](?:(?<![{word}].)[{upper}]+(?![{word}]))?", C.CAPITAL + "$0")
    t = F.when(x.rlike(rf"[{upper}]{{2}}"), signed).otherwise(F.regexp_replace(t, rf"[{upper}]", C.CAPITAL + "$0"))
    # a raised mixed-case word carries no capital signs at all
    raised = F.regexp_replace(t, rf"((?:\^_?|\G(?!\A))[{word}]*?){C.CAPITAL}(?=[{upper}])", "$1")
    t = F.when(x.contains("^"), raised).otherwise(t)
    return _map_characters(t, {**letters, **C.DIGITS, **C.STRICT_SYMBOLS, "_": ""}, probe=x)


def to_braille_strict(col: Column) -> Column:
    """Grade-1 cells; characters outside the code's word class are dropped."""
    x = R.text(col)
    letters = C.letter_cells("strict")
    latin = {k: v for k, v in letters.items() if not "\u0370" <= k <= "\u03ff"}
    greek_caps = x.rlike(
        rf"(?<![{WORD}])(?=[{UPPER}]*[\u0386-\u03ab\u03d2-\u03ff])[{UPPER}]{{2,}}(?![{WORD}])"
    )
    return (
        F.when(_is_ascii(x) | ~x.rlike("[\u0370-\u03ff]"), _strict_by_passes(x, LATIN_WORD, LATIN_UPPER, latin))
        .when(greek_caps, _strict_by_token(x))
        .otherwise(_strict_by_passes(x, WORD, UPPER, letters))
    )


SCRIPT_END = "\ufffe\uffff"
# Latin-1: letters that are no small ones, small letters, white space.  The engine has a bit for each listed character of
# a class, but asks for ranges one after the other.
_LATIN_1_CAPITAL = "".join(map(chr, (*range(0x41, 0x5B), *range(0xC0, 0xD7), *range(0xD8, 0xDF))))
_LATIN_1_SMALL = "".join(map(chr, (*range(0x61, 0x7B), 0xB5, *range(0xDF, 0xF7), *range(0xF8, 0x100))))
_LATIN_1_SPACE = R.SPACES + "\xa0"
# Signs put in before the characters are mapped: as controls, so that the text stays in Latin-1, which is read much faster.
_STAND_INS = {"\x01": C.CAPITAL, "\x02": C.NUMBER, "\x03": C.CAPITAL}


def _lenient_latin_1(x: Column) -> Column:
    """The lenient profile of texts in Latin-1 without script signs and stand-ins."""
    capital, number, word = _STAND_INS
    ns, upper, letter = f"[^{_LATIN_1_SPACE}]", f"[^{_LATIN_1_SPACE}{_LATIN_1_SMALL}]", f"{_LATIN_1_CAPITAL}ªº"
    other = f"[^{_LATIN_1_SPACE}{_LATIN_1_SMALL}{letter}]"
    t = F.regexp_replace(x, r"[0-9](?<![0-9].)[0-9]*+", number + "$0")
    single = f"[{_LATIN_1_CAPITAL}]"
    # a word of capitals is marked at its first character, then passed over as one
    caps_word = rf"(?={upper}++(?!{ns}))(?={other}*+[{letter}]{other}*+[{letter}])(?={ns}*?{single})"
    marked = F.regexp_replace(t, rf"{upper}(?<!{ns}{upper})(?<=(?={caps_word}){upper})", word + "$0")
    words = F.regexp_replace(marked, rf"[{word}{_LATIN_1_CAPITAL}](?:(?<={word}){ns}++)?", capital + "$0")
    may_have_words = x.rlike(rf"[{letter}]{other}*+[{letter}]")
    t = F.when(may_have_words, words).otherwise(F.regexp_replace(t, single, capital + "$0"))
    table = {**C.letter_cells("lenient"), **C.DIGITS, **C.LENIENT_SYMBOLS}
    return _map_characters(t, {k: v for k, v in table.items() if k <= "\xff"} | _STAND_INS, probe=x)


def to_braille_lenient(col: Column) -> Column:
    """Grade-1 cells; unmapped characters pass through and white space stays."""
    x = R.text(col)
    other = x.rlike(rf"[\^_{''.join(_STAND_INS)}\x{{100}}-\x{{10ffff}}]")
    return F.when(other, _lenient_any(x)).otherwise(_lenient_latin_1(x))


def _lenient_any(x: Column) -> Column:
    ns = f"[^{LENIENT_SPACE}]"
    # white-space words whose letters are all capital, at least two of them
    upper = rf"[^{LENIENT_SPACE}\p{{Ll}}\p{{Lt}}]"
    caps_word = (
        rf"(?={upper}{{2}})(?<!{ns})(?={upper}*+(?!{ns}))"
        rf"(?=[^{LENIENT_SPACE}\p{{L}}]*\p{{L}}[^{LENIENT_SPACE}\p{{L}}]*\p{{L}})(?={ns}*?\p{{Lu}})"
    )
    t = F.regexp_replace(x, r"[0-9](?<![0-9^_].)[0-9]*+", C.NUMBER + "$0")
    # a capital right after a script's digits, however many, carries no sign: two noncharacters mark it meanwhile
    scripts = x.rlike(r"[\^_]")
    t = F.when(scripts, F.regexp_replace(t, r"[\^_][0-9]*+(?=\p{Lu})", "$0" + SCRIPT_END)).otherwise(t)
    single = rf"\p{{Lu}}(?<!{SCRIPT_END}.)"
    words = F.regexp_replace(
        F.regexp_replace(t, rf"{caps_word}{upper}++|{single}", C.CAPITAL + "$0"), caps_word, C.CAPITAL
    )
    # a capital and another letter with no small letter between: only then can a
    # whole word be capital, and only then are the word passes worth their scans
    may_have_words = F.when(_is_ascii(x), x.rlike(r"[A-Z][^a-z\s]*[A-Z]")).otherwise(
        x.rlike(r"[\p{L}&&[^\p{Ll}\p{Lt}]][^\p{Ll}\p{Lt}\s]*[\p{L}&&[^\p{Ll}\p{Lt}]]")
    )
    t = F.when(may_have_words, words).otherwise(F.regexp_replace(t, single, C.CAPITAL + "$0"))
    t = F.when(scripts, F.replace(t, F.lit(SCRIPT_END), F.lit(""))).otherwise(t)
    return _map_characters(
        t, {**C.letter_cells("lenient"), **C.DIGITS, **C.LENIENT_SYMBOLS}, probe=x
    )


def to_braille(col: Column, mode: str = "strict") -> Column:
    if mode not in ("strict", "lenient"):
        raise ValueError(f"mode must be 'strict' or 'lenient', not {mode!r}")
    return to_braille_strict(col) if mode == "strict" else to_braille_lenient(col)


def cells_to_brf(col: Column) -> Column:
    """Unicode cells -> embosser ASCII; every other character is kept."""
    cells = "".join(chr(0x2800 + i) for i in range(64))
    return F.translate(R.text(col), cells, C.NABCC)
