"""Fixed Braille cell tables.

Everything in this file is a fixed value: the code charts that decide which
Unicode Braille cells (U+2800..U+28FF) stand for a character.  They are data,
not logic, and must agree with the published charts cell for cell.
"""

from __future__ import annotations

CAPITAL = "⠠"
NUMBER = "⠼"

# --- fixed values: letters -------------------------------------------------
LATIN = dict(zip("abcdefghijklmnopqrstuvwxyz", "⠁⠃⠉⠙⠑⠋⠛⠓⠊⠚⠅⠇⠍⠝⠕⠏⠟⠗⠎⠞⠥⠧⠺⠭⠽⠵"))
TURKISH = dict(zip("çğıöşü", "⠡⠣⠔⠪⠩⠳"))
LONG_VOWELS = dict(zip("âîû", "⠁⠊⠥"))
GREEK_LOWER = {
    "α": "⠁", "β": "⠃", "γ": "⠛", "δ": "⠙", "ε": "⠑", "ζ": "⠵", "η": "⠓", "θ": "⠹",
    "ι": "⠊", "κ": "⠅", "λ": "⠇", "μ": "⠍", "ν": "⠝", "ξ": "⠭", "π": "⠨⠏", "ρ": "⠗",
    "σ": "⠎", "τ": "⠞", "φ": "⠋", "χ": "⠡", "ψ": "⠽", "ω": "⠺",
}
GREEK_UPPER = {
    "Α": "⠁", "Β": "⠃", "Γ": "⠛", "Δ": "⠙", "Ε": "⠑", "Θ": "⠹", "Λ": "⠇", "Ξ": "⠭",
    "Π": "⠨⠏", "Σ": "⠨⠎", "Φ": "⠋", "Ψ": "⠽", "Ω": "⠺",
}

# --- fixed values: digits --------------------------------------------------
DIGITS = dict(zip("1234567890", "⠁⠃⠉⠙⠑⠋⠛⠓⠊⠚"))

# --- fixed values: punctuation and mathematical symbols --------------------
PUNCTUATION = {
    ".": "⠲", ",": "⠂", "?": "⠦", "!": "⠖", ":": "⠒", ";": "⠆",
    "-": "⠤", "−": "⠤", "–": "⠤⠤", "—": "⠤⠤⠤", '"': "⠐⠦", "\u201c": "⠦", "\u201d": "⠴",
    "\u2018": "⠦", "\u2019": "⠴", "'": "⠄", "(": "⠐⠣", ")": "⠐⠜",
    "[": "⠨⠣", "]": "⠨⠜", "{": "⠸⠣", "}": "⠸⠜",
}
OPERATORS = {
    "+": "⠬", "=": "⠨⠅", "<": "⠐⠅", ">": "⠈⠅", "*": "⠈⠡", "/": "⠌",
    "^": "⠘", "_": "⠰", "|": "⠳", "~": "⠈⠔",
    "×": "⠈⠡", "÷": "⠌", "±": "⠬⠤", "∓": "⠤⠬",
}
RELATIONS = {
    "≤": "⠐⠅⠨", "≥": "⠈⠅⠨", "≠": "⠌⠅", "≈": "⠈⠔", "≡": "⠸⠅",
    "∼": "⠈⠔", "≅": "⠸⠔", "≪": "⠐⠅⠐⠅", "≫": "⠈⠅⠈⠅",
}
CALCULUS = {
    "∞": "⠿", "∑": "⠨⠎", "∏": "⠨⠏", "∫": "⠮", "∬": "⠮⠮", "∭": "⠮⠮⠮", "∮": "⠮⠖",
    "∂": "⠨⠙", "∇": "⠨⠝", "∆": "⠨⠙", "√": "⠜", "∛": "⠘⠉⠜", "∜": "⠘⠙⠜",
    "∝": "⠳⠏", "°": "⠘⠴", "′": "⠄", "″": "⠄⠄", "‴": "⠄⠄⠄",
}
SETS_AND_LOGIC = {
    "∅": "⠈⠚", "∪": "⠨⠩", "∩": "⠨⠫", "∈": "⠈⠑", "∉": "⠈⠠⠑",
    "⊂": "⠘⠣", "⊃": "⠘⠜", "⊆": "⠘⠣⠐", "⊇": "⠘⠜⠐",
    "∧": "⠈⠯", "∨": "⠈⠿", "¬": "⠈⠹", "∀": "⠈⠁", "∃": "⠈⠑⠭", "∄": "⠈⠠⠑⠭",
}
ARROWS = {
    "→": "⠳⠕", "←": "⠳⠣", "↔": "⠳⠕⠣", "↑": "⠳⠥", "↓": "⠳⠙",
    "⟹": "⠳⠕", "⟺": "⠳⠪", "⇒": "⠳⠕", "⇐": "⠳⠣", "⇔": "⠳⠪",
}
GEOMETRY = {"⊥": "⠸⠂", "∥": "⠸⠇", "∟": "⠸⠣"}
WEB_SYMBOLS = {"@": "⠈⠁", "#": "⠼", "%": "⠨⠴", "&": "⠠⠯"}
VULGAR_FRACTIONS = {"½": "⠹⠁⠌⠃⠼", "⅓": "⠹⠁⠌⠉⠼", "¼": "⠹⠁⠌⠙⠼", "¾": "⠹⠉⠌⠙⠼", "⅔": "⠹⠃⠌⠉⠼"}

# Raised and lowered digits are the script indicator followed by the digit cell.
SUPERSCRIPT_DIGITS = {s: "⠘" + DIGITS[d] for d, s in zip("0123456789", "⁰¹²³⁴⁵⁶⁷⁸⁹")}
SUBSCRIPT_DIGITS = {s: "⠰" + DIGITS[d] for d, s in zip("0123456789", "₀₁₂₃₄₅₆₇₈₉")}

_SYMBOLS = {
    **PUNCTUATION, **OPERATORS, **RELATIONS, **CALCULUS, **SETS_AND_LOGIC, **ARROWS,
    **GEOMETRY, **WEB_SYMBOLS,
}

# Characters of the strict profile (letters and digits outside the word class
# never reach a table there, so raised digits and fractions are absent).
STRICT_SYMBOLS = {
    **_SYMBOLS, "\\": "⠸⠡", "¸": "", "¨": "", "˘": "",
    "\r": "", "\t": " ", "\v": "\n", "\f": "\n", "\x07": " ",
}
# Characters of the lenient profile.
LENIENT_SYMBOLS = {
    **_SYMBOLS, "∖": "⠸⠡", **SUPERSCRIPT_DIGITS, **SUBSCRIPT_DIGITS, **VULGAR_FRACTIONS,
}

# Nemeth (mathematics) code.
NEMETH_OPERATORS = {
    "+": "⠬", "-": "⠤", "*": "⠈⠡", "=": "⠨⠅", "<": "⠐⠅", ">": "⠈⠅", "≤": "⠐⠅⠨", "≥": "⠈⠅⠨",
    ",": "⠂", "&": "⠠⠯", "∪": "⠨⠩", "∩": "⠨⠫", "∈": "⠈⠑", "∉": "⠈⠠⠑", "⊂": "⠘⠣", "⊃": "⠘⠜",
    "⇔": "⠳⠪", "⇐": "⠳⠣", "⇒": "⠳⠕", "≡": "⠸⠅", "\\": "⠸⠡",
}
NEMETH_FUNCTIONS = {
    "sin": "⠎⠊⠝", "cos": "⠉⠕⠎", "tan": "⠞⠁⠝",
    "arcsin": "⠁⠗⠉⠎⠊⠝", "arccos": "⠁⠗⠉⠉⠕⠎", "arctan": "⠁⠗⠉⠞⠁⠝",
    "asin": "⠁⠗⠉⠎⠊⠝", "acos": "⠁⠗⠉⠉⠕⠎", "atan": "⠁⠗⠉⠞⠁⠝",
    "sinh": "⠎⠊⠝⠓", "cosh": "⠉⠕⠎⠓", "tanh": "⠞⠁⠝⠓",
    "log": "⠇⠕⠛", "log2": "⠇⠕⠛⠼⠃", "log10": "⠇⠕⠛⠼⠁⠚", "ln": "⠇⠝", "exp": "⠑⠭⠏",
    "ceil": "⠈⠉⠑⠊⠇", "floor": "⠈⠋⠇⠕⠕⠗", "max": "⠍⠁⠭", "min": "⠍⠊⠝", "lim": "⠇⠊⠍",
    "sum": "⠨⠎", "prod": "⠨⠏", "gcd": "⠛⠉⠙", "lcm": "⠇⠉⠍", "det": "⠙⠑⠞", "mod": "⠍⠕⠙",
    "sign": "⠎⠛⠝", "sgn": "⠎⠛⠝",
}
NEMETH_CONSTANTS = {"pi": "⠨⠏", "inf": "⠿", "infinity": "⠿", "∅": "⠈⠚"}
NEMETH_VARIABLE_LETTERS = {**LATIN, **TURKISH}
MATH_FUNCTION_NAMES = [
    "sin", "cos", "tan", "log", "log2", "log10", "ln", "sqrt", "cbrt", "abs", "ceil", "floor",
    "exp", "arcsin", "arccos", "arctan", "asin", "acos", "atan", "sinh", "cosh", "tanh",
    "lim", "sum", "prod", "max", "min", "det", "mod", "factorial", "fact", "pi", "inf",
    "infinity", "gcd", "lcm", "sign", "sgn", "int", "integral", "diff", "deriv",
    "derivative", "partial",
]
MATH_OPERATORS = "+-*/=^_().·:,|~≤≥<>∪∩∈∉⊂⊃⇔⇐⇒≡\\'∫∂&′’‘"

# North American Braille computer code: the ASCII character of cells U+2800..U+283F
# in code-point order.
NABCC = " a1b'k2l@cif/msp\"e3h9o6r^djg>ntq,*5<-u8v.%[$+x!&;:4\\0z7(_?w]#y)="


def letter_cells(profile: str) -> dict[str, str]:
    """Every letter with a cell in a profile, both cases, as one mapping."""
    lower = {**LATIN, **TURKISH, **GREEK_LOWER}
    if profile == "lenient":
        lower.update(LONG_VOWELS)
    upper = {c.upper(): cell for c, cell in lower.items() if c not in "iı"}
    return {**lower, **upper, **GREEK_UPPER, "I": "⠔", "İ": "⠊"}


def symbol_cells(profile: str) -> dict[str, str]:
    return STRICT_SYMBOLS if profile == "strict" else LENIENT_SYMBOLS


def all_cells(profile: str) -> dict[str, str]:
    return {**letter_cells(profile), **DIGITS, **symbol_cells(profile)}
