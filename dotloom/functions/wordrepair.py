"""Repair of Turkish words whose letters were corrupted by text extraction."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import regex as R
from .text import repair_formula_tokens

# --- fixed values: repair dictionary ----------------------------------------
CORRUPTED_WORDS = {
    '"usler': "üsler", '"ust': "üst", '"uzerine': "üzerine", '"uzerinde': "üzerinde",
    '"ozellikleri': "özellikleri", '"ozellikler': "özellikler", '"ogrenci': "öğrenci",
    '"ogretmen': "öğretmen", "ozellikleri": "özellikleri", "ozellikler": "özellikler",
    '"ornek': "örnek", 'k"okler': "kökler", 'k"ok': "kök", 'b"oyle': "böyle",
    'k"umeleri': "kümeleri", 't"urkce': "türkçe", 's"ozetme': "sözetme",
    "i¸slemleri": "işlemleri", "i¸slem": "işlem", "i¸cin": "için",
    "tanımlanmı¸s": "tanımlanmış", "¸carpma": "çarpma", "¸carpım": "çarpım",
    "¸cözüm": "çözüm", "do˘gal": "doğal", "a¸sa˘gıda": "aşağıda", "a¸sa˘ıdaki": "aşağıdaki",
    "hi¸c": "hiç", "kısm:": "kısmi", "bel:rl:": "belirli", "ikinc:": "ikinci",
    "iler:": "ileri", "l:m:t": "limit", "l:m:t:": "limiti", "teoris:": "teorisi",
    "trigonometr:": "trigonometri", ":ntegral": "integral", ":ntegrasyon": "integrasyon",
}
WHOLE_WORDS = [
    "kısmi", "belirli", "ikinci", "ileri", "limit", "limiti", "trigonometri", "teorisi",
    "özellikleri", "işlemleri", "işlem", "tanımlanmış", "çarpma", "çarpım", "çözüm", "doğal",
    "aşağıda", "aşağıdaki", "hiç", "kümeleri", "kökler", "kök", "üsler", "integrasyon",
    "integral", "üzerine", "üzerinde", "böyle", "örnek", "özellikler", "öğrenci", "öğretmen",
    "üst", "türkçe", "için",
]
HINT_WORDS = [
    "hiperbolik", "trigonometri", "trigonometrik", "ters", "integral", "integrali",
    "integrasyon", "matematik", "fonksiyon", "fonksiyonu", "fonksiyonlar", "kesirli",
    "özdeşlik", "özdeşlikler", "özellik", "özellikler", "özellikleri", "tanımlı",
    "tanımlanmış", "işlem", "işlemler", "işlemleri", "sayılar", "sayı", "sayısı", "birim",
    "birimler", "birinci", "ikinci", "üçüncü", "dördüncü", "kısmi", "belirli", "limit",
    "limiti", "teorisi", "teorem", "teoremi", "sinir", "siniri",
]
HINT_SUFFIXES = [
    "lik", "lık", "luk", "lük", "li", "lı", "lu", "lü", "si", "sı", "leri", "ları", "nin",
    "nın", "in", "ın", "de", "da", "den", "dan", "mi", "mı", "mu", "mü", "tir", "tır", "tur",
    "tür",
]
MARKER_PAIRS = [
    ('"u', "ü"), ('"U', "Ü"), ('"o', "ö"), ('"O', "Ö"), ('u"', "ü"), ('U"', "Ü"),
    ('o"', "ö"), ('O"', "Ö"), ("¨u", "ü"), ("¨U", "Ü"), ("¨o", "ö"), ("¨O", "Ö"),
    ("u¨", "ü"), ("U¨", "Ü"), ("o¨", "ö"), ("O¨", "Ö"), ('"i', "i"), ('"I', "I"),
    ("¸c", "ç"), ("¸C", "Ç"), ("¸s", "ş"), ("¸S", "Ş"), ("c¸", "ç"), ("C¸", "Ç"),
    ("s¸", "ş"), ("S¸", "Ş"), ("˘g", "ğ"), ("˘G", "Ğ"), ("g˘", "ğ"), ("G˘", "Ğ"),
]
WORD_CHARS = 'A-Za-zÇĞİÖŞÜçğıöşüÂÎÛâîûÉÈËÊéèëê:"˘¸¨'
WORD_LETTERS = 'A-Za-zÇĞİÖŞÜçğıöşüÂÎÛâîûÉÈËÊéèëê"˘¸¨'
ACCEPT = 0.85
# -----------------------------------------------------------------------------

SEGMENTS = rf"[{WORD_CHARS}]+|\s+|[^{WORD_CHARS}\s]+"
DICTIONARY = {**{w: w for w in WHOLE_WORDS}, **CORRUPTED_WORDS}


def tr_lower(col: Column) -> Column:
    """Lower case with Turkish i rules (I -> ı, İ -> i)."""
    return F.lower(R.replace_all(col, [("I", "ı"), ("İ", "i")]))


def tr_upper(col: Column) -> Column:
    return F.upper(F.translate(col, "iı", "İI"))


def _lookup(key: Column) -> Column:
    # a map look-up scans the map; the set test in front of it is a hash probe
    flat = [F.lit(x) for kv in DICTIONARY.items() for x in kv]
    return F.when(key.isin(list(DICTIONARY)), F.try_element_at(F.create_map(*flat), key))


def preserve_case(original: Column, repaired: Column) -> Column:
    """Give a lower-case repair the capitals of the word it replaces."""
    first = F.regexp_extract(original, r"\p{L}", 0)
    capital = F.concat(tr_upper(F.substring(repaired, 1, 1)), F.substring(repaired, F.lit(2), F.length(repaired)))
    return (
        F.when(original.startswith(":") | (first == ""), repaired)
        .when(~original.rlike(r"\p{Ll}"), tr_upper(repaired))
        .when(first == tr_upper(first), capital)
        .otherwise(repaired)
    )


def dictionary_repair(word: Column) -> Column:
    """Repaired word with its case, null when the dictionary has no entry."""
    return R.let(_lookup(tr_lower(word)), lambda hit: F.when(hit.isNotNull(), preserve_case(word, hit)))


def repair_markers(col: Column) -> Column:
    """Detached marks joined to their letters; unchanged if a mark survives."""
    repaired = R.replace_all(R.text(col), MARKER_PAIRS)
    return F.when(repaired.rlike('["˘¸¨]'), R.text(col)).otherwise(repaired)


def colon_candidates(word: Column) -> Column:
    """Readings of a word in which ':' stands for i or ı, most likely first."""

    def readings(core: Column, suffix: Column) -> Column:
        parts = F.split(core, ":")
        k = F.size(parts) - 1
        masks = F.when(k > 3, F.array(F.lit(0), F.lit(-1))).otherwise(
            F.concat(
                F.array(F.lit(0), F.lit(-1)),
                F.sequence(F.lit(0), F.expr("cast(1 as int)") * F.pow(F.lit(2), F.least(k, F.lit(3))).cast("int") - 1),
            )
        )

        def one(mask: Column) -> Column:
            letter = lambda i: F.when(i == 0, "").when(
                (mask / F.pow(F.lit(2), i - 1)).cast("int").bitwiseAND(F.lit(1)) == 1, "ı"
            ).otherwise("i")
            mixed = F.array_join(F.transform(parts, lambda p, i: F.concat(letter(i), p)), "")
            return F.concat(
                F.when(mask == -1, F.replace(core, F.lit(":"), F.lit("ı"))).otherwise(mixed), suffix
            )

        return F.when(k == 0, F.array(F.concat(core, suffix))).otherwise(F.transform(masks, one))

    whole = readings(word, F.lit(""))
    shorter = readings(F.regexp_replace(word, r":\z", ""), F.lit(":"))
    return F.array_distinct(F.when(word.endswith(":"), F.concat(whole, shorter)).otherwise(whole))


def has_turkish_shape(word: Column) -> Column:
    """At least two vowels and a known word, or a known stem with a known suffix."""
    low = tr_lower(word)
    hints = F.array(*map(F.lit, HINT_WORDS))
    suffixes = F.array(*map(F.lit, HINT_SUFFIXES))
    stem_known = F.exists(
        suffixes,
        lambda s: low.endswith(s)
        & (F.length(low) > F.length(s) + 2)
        & F.array_contains(hints, F.substring(low, F.lit(1), F.greatest(F.length(low) - F.length(s), F.lit(0)))),
    )
    return (F.regexp_count(low, F.lit("[aeıioöuü]")) >= 2) & (F.array_contains(hints, low) | stem_known)


def is_colon_word(word: Column) -> Column:
    stripped = F.regexp_replace(word, r":+\z", "")
    return (
        word.contains(":")
        & (F.length(F.replace(stripped, F.lit(":"), F.lit(""))) >= 4)
        & stripped.rlike("[A-Za-zÇĞİÖŞÜçğıöşü]{2,}")
        & word.rlike(r"^[:A-Za-zÇĞİÖŞÜçğıöşü]+\z")
    )


def _outcome(text: Column, confidence: Column, original: Column) -> Column:
    return F.struct(
        text.alias("text"), confidence.cast("double").alias("confidence"), (text != original).alias("changed")
    )


def _bare(c: Column) -> Column:
    return F.regexp_replace(c, r":+\z", "")


def repair_colon_word(word: Column) -> Column:
    """struct(text, confidence, changed) of the best reading, else null.

    A reading in the dictionary wins at once (0.99); otherwise the first
    reading with the shape of a Turkish word does (0.93, or 0.88 with a colon).
    """
    tail = lambda c: F.substring(c, F.length(_bare(c)) + 1, F.length(c))

    def rate(c: Column) -> Column:
        exact = F.concat(dictionary_repair(_bare(c)), tail(c))
        shape = F.when(has_turkish_shape(_bare(c)), F.when(c.contains(":"), 0.88).otherwise(0.93))
        return F.when(
            exact.isNotNull(), F.struct(F.lit(0.99).alias("score"), exact.alias("text"), c.alias("from"))
        ).otherwise(F.struct(shape.alias("score"), c.alias("text"), c.alias("from")))

    start = F.struct(
        F.lit(0.0).alias("score"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("from")
    )
    better = lambda best, c: R.let(
        rate(c), lambda r: F.when((best["score"] < 0.99) & (r["score"] > best["score"]), r).otherwise(best)
    )

    def finish(b: Column) -> Column:
        cased = F.concat(preserve_case(_bare(word), tr_lower(_bare(b["text"]))), tail(b["text"]))
        return F.when(
            b["text"].isNotNull(),
            F.struct(
                cased.alias("text"), b["score"].alias("confidence"),
                ((b["score"] == 0.99) | (b["from"] != word)).alias("changed"),
            ),
        )

    return F.aggregate(colon_candidates(word), start, better, finish)


def _unrepaired(tok: Column, confidence: float) -> Column:
    return F.struct(tok.alias("text"), F.lit(confidence).alias("confidence"), F.lit(False).alias("changed"))


def repair_token(tok: Column) -> Column:
    """struct(text, confidence, changed) for one token."""

    def by_marker(marked: Column) -> Column:
        again = F.coalesce(
            dictionary_repair(F.replace(marked, F.lit(":"), F.lit("i"))), dictionary_repair(marked), marked
        )
        return F.when(marked.rlike('["˘¸¨]'), _unrepaired(tok, 0.2)).otherwise(
            R.let(again, lambda a: _outcome(a, F.when(a != tok, 0.98).otherwise(0.55), tok))
        )

    marked = F.when(tok.rlike('[":˘¸¨]'), R.let(R.replace_all(tok, MARKER_PAIRS), by_marker)).otherwise(
        _unrepaired(tok, 0.0)
    )
    return R.let(
        dictionary_repair(tok),
        lambda direct: F.when(direct.isNotNull(), _outcome(direct, F.lit(0.99), tok)).otherwise(
            F.coalesce(F.when(is_colon_word(tok), repair_colon_word(tok)), marked)
        ),
    )


def needs_repair(tok: Column) -> Column:
    """Cheap test in front of the token work: a marker or a dictionary word."""
    return tok.rlike('[":˘¸¨]') | tr_lower(tok).isin(list(DICTIONARY))


def _beginnings() -> str:
    """The first three letters of the dictionary's words in either case, not behind a small letter: a class first, few words are left behind it."""
    either = {"i": "iİ", "ı": "ıI"}
    spelled = lambda c: f"[{either.get(c, c + c.upper())}]"
    by_first: dict[str, list[str]] = {}
    for w in sorted({w[:3] for w in DICTIONARY if not set(w) & set('":˘¸¨')}):
        by_first.setdefault(w[0], []).append("".join(map(spelled, w[1:])))
    branches = "|".join(f"{spelled(c)}(?:{'|'.join(ends)})" for c, ends in by_first.items())
    return rf"(?=[{''.join(spelled(c)[1:-1] for c in by_first)}])(?<![a-z])(?:{branches})"


def may_need_repair(line: Column) -> Column:
    """False only where ``repair_text`` leaves a line as it is: no marker, no "ƒ" and no word that begins as one of the dictionary."""
    return line.rlike('[":¨¸\r\u0192-\u02d8]') | line.rlike(_beginnings())


def repairable_segments(col: Column) -> Column:
    """Text -> array of struct(text, confidence, changed) over the segments that repair looks at; all others stay as they are."""
    words = F.regexp_extract_all(col, F.lit(rf"[{WORD_CHARS}]+"), 0)
    return F.transform(F.filter(words, lambda t: needs_repair(t) & t.rlike(rf"[{WORD_LETTERS}]")), repair_token)


def repair_segments(col: Column) -> Column:
    """Text -> array of struct(text, confidence, changed) over all segments."""
    return F.transform(
        F.regexp_extract_all(col, F.lit(SEGMENTS), 0),
        lambda t: F.when(needs_repair(t) & t.rlike(rf"[{WORD_LETTERS}]"), repair_token(t)).otherwise(_unrepaired(t, 0.0)),
    )


def repair_text(col: Column) -> Column:
    """Every line repaired; line breaks and spacing are kept."""
    x = R.replace_all(R.text(col), [("\r\n", "\n"), ("ƒ", "f")])
    mapped = F.when(R.text(col).contains(":"), repair_formula_tokens(x)).otherwise(x)
    accepted = lambda t: R.let(repair_token(t), lambda r: F.when(r["confidence"] >= ACCEPT, r["text"]).otherwise(t))
    repaired = lambda line: F.array_join(
        F.transform(
            F.regexp_extract_all(line, F.lit(SEGMENTS), 0),
            lambda t: F.when(needs_repair(t) & t.rlike(rf"[{WORD_LETTERS}]"), accepted(t)).otherwise(t),
        ),
        "",
    )
    # no word goes over a line end; lines that need no repair are not cut into words
    return F.array_join(F.transform(F.split(mapped, "\n"), lambda l: F.when(may_need_repair(l), repaired(l)).otherwise(l)), "\n")
