"""Word repair as DuckDB common table expressions over distinct words."""

from __future__ import annotations

from ..functions import wordrepair as WR
from . import duck as D, sqlrules as S


def _low(x: str) -> str:
    return f"lower(translate({x}, 'Iİ', 'ıi'))"


def _up(x: str) -> str:
    return f"upper(translate({x}, 'iı', 'İI'))"


def _cased(o: str, r: str) -> str:
    first = D.extract(o, r"\p{L}", 0)
    return (
        f"CASE WHEN starts_with({o}, ':') OR {first} = '' THEN {r} WHEN NOT regexp_matches({o}, '\\p{{Ll}}') THEN {_up(r)} "
        f"WHEN {first} = {_up(first)} THEN concat({_up(f'substr({r}, 1, 1)')}, substr({r}, 2)) ELSE {r} END"
    )


def _list(words: list[str]) -> str:
    return "[" + ", ".join(D.q(w) for w in words) + "]"


_BARE = "regexp_replace({0}, ':+$', '')"
_FORMULA = f"CASE WHEN contains(text, ':') THEN {S.formula_tokens('x')} ELSE x END"
_DICT = ", ".join(f"({D.q(k)}, {D.q(v)})" for k, v in WR.DICTIONARY.items())
_MARKS = '["˘¸¨]'


def segments_sql(source: str, keys: str) -> str:
    """CTEs from ``source(keys, text)`` to sg(keys, pos, seg, fixed, confidence, changed)."""
    hints, suffixes = _list(WR.HINT_WORDS), _list(WR.HINT_SUFFIXES)
    low = _low("bare")
    shape = (
        f"(len(regexp_extract_all({low}, '[aeıioöuü]')) >= 2 AND (list_contains({hints}, {low}) OR len(list_filter({suffixes}, lambda f: "
        f"ends_with({low}, f) AND length({low}) > length(f) + 2 AND list_contains({hints}, substr({low}, 1, length({low}) - length(f))))) > 0))"
    )
    letter = "CASE WHEN (mask // CAST(pow(2, i - 2) AS INT)) % 2 = 1 THEN 'ı' ELSE 'i' END"
    mixed = f"array_to_string(list_transform(string_split(core, ':'), lambda p, i: concat(CASE WHEN i = 1 THEN '' ELSE {letter} END, p)), '')"
    return f"""rd(k, v) AS (VALUES {_DICT}),
 rm AS (SELECT *, {_FORMULA} AS m FROM (SELECT {keys}, text, replace(replace(text, chr(13) || chr(10), chr(10)), 'ƒ', 'f') AS x FROM {source})),
 rs AS (SELECT {keys}, m <> x AS formula, CAST(generate_subscripts(l, 1) AS INT) AS pos, unnest(l) AS seg FROM (SELECT {keys}, m, x, {D.extract_all('m', WR.SEGMENTS)} AS l FROM rm)),
 rw AS (SELECT DISTINCT seg AS word FROM rs WHERE regexp_matches(seg, '[{WR.WORD_LETTERS}]') AND (regexp_matches(seg, '[":˘¸¨]') OR {_low('seg')} IN (SELECT k FROM rd))),
 r1 AS (SELECT word, {_cased('word', 'v')} AS fixed FROM rw JOIN rd ON k = {_low('word')}),
 cw AS (SELECT word FROM rw WHERE contains(word, ':') AND length(replace({_BARE.format('word')}, ':', '')) >= 4 AND regexp_matches({_BARE.format('word')}, '[A-Za-zÇĞİÖŞÜçğıöşü]{{2,}}') AND regexp_matches(word, '^[:A-Za-zÇĞİÖŞÜçğıöşü]+$')),
 co AS (SELECT word, word AS core, '' AS suffix, 0 AS o FROM cw UNION ALL SELECT word, substr(word, 1, length(word) - 1), ':', 1 FROM cw WHERE ends_with(word, ':')),
 ck AS (SELECT *, length(core) - length(replace(core, ':', '')) AS k FROM co),
 cm AS (SELECT word, core, suffix, o, unnest(CASE WHEN k = 0 THEN [0] WHEN k > 3 THEN [0, -1] ELSE list_concat([0, -1], range(CAST(pow(2, k) AS BIGINT))) END) AS mask, generate_subscripts(CASE WHEN k = 0 THEN [0] WHEN k > 3 THEN [0, -1] ELSE list_concat([0, -1], range(CAST(pow(2, k) AS BIGINT))) END, 1) AS p FROM ck),
 cc AS (SELECT word, o, p, concat(CASE WHEN mask = -1 THEN replace(core, ':', 'ı') ELSE {mixed} END, suffix) AS cand FROM cm),
 cb AS (SELECT *, {_BARE.format('cand')} AS bare FROM cc),
 cs AS (SELECT cb.*, CASE WHEN v IS NOT NULL THEN 0.99 WHEN {shape} THEN CASE WHEN contains(cand, ':') THEN 0.88 ELSE 0.93 END END AS score, CASE WHEN v IS NOT NULL THEN concat({_cased('bare', 'v')}, substr(cand, length(bare) + 1)) ELSE cand END AS txt FROM cb LEFT JOIN rd ON k = {_low('bare')}),
 cx AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY score DESC, o, p) AS rn FROM cs WHERE score IS NOT NULL) WHERE rn = 1),
 r2 AS (SELECT word, concat({_cased(_BARE.format('word'), _low(_BARE.format('txt')))}, substr(txt, length({_BARE.format('txt')}) + 1)) AS fixed, score, score = 0.99 OR cand <> word AS changed FROM cx),
 m1 AS (SELECT word, {D.replace_all('word', WR.MARKER_PAIRS)} AS mk FROM rw),
 m2 AS (SELECT word, mk, CASE WHEN d1.v IS NOT NULL THEN {_cased("replace(mk, ':', 'i')", 'd1.v')} WHEN d2.v IS NOT NULL THEN {_cased('mk', 'd2.v')} ELSE mk END AS ag FROM m1 LEFT JOIN rd d1 ON d1.k = {_low("replace(mk, ':', 'i')")} LEFT JOIN rd d2 ON d2.k = {_low('mk')}),
 rf AS (SELECT w.word, CASE WHEN r1.fixed IS NOT NULL THEN r1.fixed WHEN r2.fixed IS NOT NULL THEN r2.fixed WHEN regexp_matches(mk, '{_MARKS}') THEN w.word ELSE ag END AS fixed,
   CAST(CASE WHEN r1.fixed IS NOT NULL THEN 0.99 WHEN r2.fixed IS NOT NULL THEN r2.score WHEN regexp_matches(mk, '{_MARKS}') THEN 0.2 WHEN ag <> w.word THEN 0.98 ELSE 0.55 END AS DOUBLE) AS confidence,
   CASE WHEN r1.fixed IS NOT NULL THEN r1.fixed <> w.word WHEN r2.fixed IS NOT NULL THEN r2.changed WHEN regexp_matches(mk, '{_MARKS}') THEN false ELSE ag <> w.word END AS changed
   FROM rw w LEFT JOIN r1 USING (word) LEFT JOIN r2 USING (word) LEFT JOIN m2 USING (word)),
 sg AS (SELECT rs.*, coalesce(fixed, seg) AS fixed, coalesce(confidence, 0.0) AS confidence, coalesce(changed, false) AS changed FROM rs LEFT JOIN rf ON rf.word = rs.seg)"""
