"""Structure, pagination and typed blocks as DuckDB common table expressions: the rules as walks over rows."""

from __future__ import annotations

import re

from . import sqlrules as Q


def recursive(sql: str) -> str:
    """Let the statement's tables refer to themselves."""
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


def renamed(ctes: str, p: str) -> str:
    """Language scores (tables w, wc, sc) under names of their own."""
    for name in ("sc", "wc", "w"):
        ctes = re.sub(rf"\b{name}(?= AS \()|(?<=FROM ){name}\b|(?<=JOIN ){name}\b", p + name, ctes)
    return ctes


def plain_blocks_sql(src: str, p: str = "pb") -> str:
    """``src(doc_id, page_no, line_no, text)`` -> ``p`` with block_no of every line with text."""
    return f"""{p}1 AS (SELECT doc_id, page_no, line_no, {Q.normalize_line('text')} AS text FROM {src}),
 {p}2 AS (SELECT *, coalesce(lag(text) OVER (PARTITION BY doc_id, page_no ORDER BY line_no), '') = '' AS fresh FROM {p}1),
 {p}3 AS MATERIALIZED (SELECT doc_id, page_no, line_no, text, fresh, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY line_no) AS i, {Q.keyword_type('text')} AS kw, {Q.is_theorem_boundary('text')} AS te, {Q.is_example_boundary('text')} AS ee,
   {Q.is_caption('text')} AS cap, {Q.is_prose('text')} AS prose, {Q.is_short_explanation('text')} AS short, {Q.is_layout_math('text')} AS math, {Q.is_equation_step('text')} AS step FROM {p}2 WHERE text <> ''),
 {p} AS (SELECT doc_id, page_no, line_no, text, i, 0 AS block_no, kw AS skw, step AS eq FROM {p}3 WHERE i = 1
  UNION ALL SELECT doc_id, page_no, line_no, text, i, pno + CASE WHEN cut THEN 1 ELSE 0 END, CASE WHEN cut THEN kw ELSE pkw END, (cut OR peq) AND step FROM (
   SELECT n.*, p.block_no AS pno, p.skw AS pkw, p.eq AS peq, n.fresh OR (NOT (coalesce(p.skw = 'theorem' AND NOT n.te, false) OR coalesce(p.skw = 'example' AND NOT n.ee AND n.kw IS NULL AND NOT n.cap AND (n.prose OR n.short OR n.math OR n.step), false)) AND p.eq AND n.prose) AS cut
   FROM {p} p JOIN {p}3 n ON n.doc_id = p.doc_id AND n.page_no = p.page_no AND n.i = p.i + 1))"""


def _same(keys: str, a: str = "n", b: str = "p") -> str:
    return " AND ".join(f"{a}.{k} = {b}.{k}" for k in keys.split(", "))


def merged_sql(src: str, keys: str, p: str) -> str:
    """Lines of groups, ``src(keys, grp, i, n, text)``, joined where they wrap: ``{p}o(keys, grp, seg, line)`` and
    ``{p}x(keys, grp, fix, ofs)``.  A group's line i of n joins what has been merged before it."""
    first, last = r"'^\p{L}+', 0", r"'(\p{L}+)-?$', 1"
    token = "concat(last, first)"
    for end in "zmn":
        token = f"regexp_replace({token}, '(aca|ece)g([ıiuü]){end}$', '\\1ğ\\2{end}')"
    return f"""{p}1 AS MATERIALIZED (SELECT {keys}, grp, i, n, text, {Q.plain_line('text')} AS plain FROM {src}),
 {p}2 AS (SELECT {keys}, grp, i, n, text AS cur, 0 AS seg, CAST(NULL AS VARCHAR) AS fix FROM {p}1 WHERE i = 1
  UNION ALL SELECT {keys}, grp, i, n, CASE WHEN can THEN {Q.trim("regexp_replace(CASE WHEN tight THEN concat(substr(a, 1, length(regexp_replace(a, '" + chr(92) + "p{L}+-?$', ''))), " + token + ", substr(b, length(first) + 1)) ELSE concat(a, ' ', b) END, '" + chr(92) + "s+', ' ', 'g')")} ELSE text END,
   seg + CASE WHEN can THEN 0 ELSE 1 END, CASE WHEN can THEN CASE WHEN NOT tight THEN 'merged wrapped line' WHEN ends_with(a, '-') THEN 'merged hyphenated word' ELSE 'merged broken word' END END FROM (
   SELECT *, last <> '' AND first <> '' AND (ends_with(a, '-') OR (NOT regexp_matches(last, '\\p{{Lu}}') AND NOT regexp_matches(first, '\\p{{Lu}}') AND regexp_matches(last, '(aca|ece)$') AND regexp_matches(first, '^g[ıiuü]z$'))) AS tight FROM (
    SELECT *, regexp_extract(a, {last}) AS last, regexp_extract(b, {first}) AS first FROM (
     SELECT n.*, p.seg, {Q.trim('p.cur')} AS a, regexp_replace({Q.trim('n.text')}, '^[-–—]+', '') AS b, n.plain AND {Q.plain_line('p.cur')} AS can
     FROM {p}2 p JOIN {p}1 n ON {_same(keys)} AND n.grp = p.grp AND n.i = p.i + 1)))),
 {p}o AS (SELECT * FROM (SELECT {keys}, grp, seg, CASE WHEN any_value(n) > 1 THEN {Q.trim('arg_max(cur, i)')} ELSE arg_max(cur, i) END AS line FROM {p}2 GROUP BY {keys}, grp, seg) WHERE line <> ''),
 {p}x AS (SELECT {keys}, grp, fix, min(i) AS ofs FROM {p}2 WHERE fix IS NOT NULL GROUP BY {keys}, grp, fix)"""


def structure_sql(src: str, keys: str, p: str) -> str:
    """``src(keys, source_type, text)`` -> lines ``{p}l``, blocks ``{p}b`` and ``{p}g(keys, source_type, text, classification, mode)``."""
    unix = "replace(replace(text, chr(13) || chr(10), chr(10)), chr(160), ' ')"
    w = f"PARTITION BY {keys} ORDER BY line_no"
    return f"""{p}s AS MATERIALIZED (SELECT {keys}, source_type, {unix} AS text FROM {src}),
 {p}f1 AS (SELECT {keys}, source_type, CAST(generate_subscripts(l, 1) - 1 AS INT) AS line_no, unnest(l) AS text FROM (SELECT {keys}, source_type, string_split(text, chr(10)) AS l FROM {p}s)),
 {p}f2 AS (SELECT *, {Q.trim('text')} = '' AS b FROM {p}f1),
 {p}f3 AS (SELECT *, coalesce(lag(b) OVER ({w}), true) AS pb, coalesce(lead(b) OVER ({w}), false) AS nb FROM {p}f2),
 {p}f4 AS (SELECT *, CAST(sum(CASE WHEN NOT b AND pb THEN 1 ELSE 0 END) OVER ({w}) AS INT) AS block_no FROM {p}f3),
 {p}l AS MATERIALIZED (SELECT {keys}, source_type, line_no, regexp_replace(text, '\\s+$', '') AS text, block_no, nb AS break_after FROM {p}f4 WHERE NOT b),
 {p}c1 AS (SELECT {keys}, source_type, block_no, line_no, break_after, length({Q.trim('text')}) AS len, {Q.is_list('text')} AS li, {Q.is_formula(Q.trim('text'))} AS fo, {Q.is_heading('text')} AS he, {Q.is_terminal('text')} AS te FROM {p}l),
 {p}c2 AS (SELECT *, NOT li AND NOT fo AND NOT he AS plain FROM {p}c1),
 {p}c3 AS (SELECT *, lead(plain) OVER w AS np, lead(len) OVER w AS nl FROM {p}c2 WINDOW w AS (PARTITION BY {keys}, block_no ORDER BY line_no)),
 {p}c4 AS (SELECT *, coalesce(plain AND np, false) AS co, coalesce(plain AND np AND NOT te AND (len >= 18 OR nl >= 18), false) AS wr FROM {p}c3),
 {p}c5 AS (SELECT {keys}, source_type, block_no, count(*) AS n, avg(len) AS av, count(*) FILTER (WHERE co) AS c, count(*) FILTER (WHERE wr) AS w, count(*) FILTER (WHERE len <= 44) AS s,
   bool_or(li) AS l, bool_or(fo) AS f, bool_or(he) AS h, arg_max(break_after, line_no) AS break_after FROM {p}c4 GROUP BY {keys}, source_type, block_no),
 {p}b AS MATERIALIZED (SELECT {keys}, block_no, break_after, CASE WHEN n = 1 AND h THEN 'LINE_BASED' WHEN l OR f THEN CASE WHEN c > 0 THEN 'MIXED' ELSE 'LINE_BASED' END
   WHEN c >= greatest(1, floor((n - 1) * 0.6)) AND av >= 26 THEN 'REAL_PARAGRAPH' WHEN source_type = 'pdf' AND w >= greatest(1, floor((n - 1) * 0.6)) THEN 'REAL_PARAGRAPH'
   WHEN s >= greatest(2, ceil(n * 0.7)) THEN 'LINE_BASED' WHEN av >= 58 THEN 'REAL_PARAGRAPH' WHEN c > 0 THEN 'MIXED' ELSE 'LINE_BASED' END AS type FROM {p}c5),
 {p}k AS (SELECT {keys}, CASE WHEN min(type) = max(type) THEN min(type) ELSE 'MIXED' END AS classification, bool_or(break_after) AS bk, max(block_no) AS last_block FROM {p}b GROUP BY {keys}),
 {p}g AS MATERIALIZED (SELECT s.*, coalesce(classification, 'REAL_PARAGRAPH') AS classification, last_block,
   CASE coalesce(classification, 'REAL_PARAGRAPH') WHEN 'LINE_BASED' THEN 'line_preserved' WHEN 'REAL_PARAGRAPH' THEN CASE WHEN bk THEN 'paragraph_preserved' ELSE 'plain_prose' END ELSE 'mixed_structured' END AS mode FROM {p}s s LEFT JOIN {p}k USING ({keys}))"""


def rebuilt_sql(src: str, keys: str, p: str) -> str:
    """``structure_sql`` and the text again: ``{p}r(keys, source_type, classification, mode, text, fixes)``."""
    lf = "chr(10)"
    return f"""{structure_sql(src, keys, p)},
 {p}i1 AS (SELECT l.*, b.type, g.classification, b.break_after AND l.block_no < g.last_block AS gap, CASE WHEN g.classification = 'REAL_PARAGRAPH' THEN 0 ELSE l.block_no END AS grp FROM {p}l l JOIN {p}b b USING ({keys}, block_no) JOIN (SELECT {keys}, classification, last_block FROM {p}g) g USING ({keys})),
 {p}i2 AS (SELECT {keys}, grp, row_number() OVER (PARTITION BY {keys}, grp ORDER BY line_no) AS i, count(*) OVER (PARTITION BY {keys}, grp) AS n, text FROM {p}i1 WHERE classification = 'REAL_PARAGRAPH' OR (classification = 'MIXED' AND type = 'REAL_PARAGRAPH')),
 {merged_sql(f'{p}i2', keys, p + 'm')},
 {p}o1 AS (SELECT {keys}, grp, seg AS ofs, line FROM {p}mo UNION ALL SELECT {keys}, grp, line_no, text FROM {p}i1 WHERE classification = 'MIXED' AND type <> 'REAL_PARAGRAPH' UNION ALL SELECT DISTINCT {keys}, grp, 1000000000, '' FROM {p}i1 WHERE classification = 'MIXED' AND gap),
 {p}o2 AS (SELECT {keys}, string_agg(line, {lf} ORDER BY grp, ofs) AS mixed, string_agg(line, {lf} || {lf} ORDER BY grp, ofs) AS whole FROM {p}o1 GROUP BY {keys}),
 {p}o3 AS (SELECT {keys}, string_agg(fix, ',' ORDER BY ofs) AS fixes FROM (SELECT {keys}, fix, min(grp * 1000000 + ofs) AS ofs FROM {p}mx GROUP BY {keys}, fix) GROUP BY {keys}),
 {p}r AS MATERIALIZED (SELECT {keys}, source_type, classification, mode, {Q.trim(f"regexp_replace(CASE WHEN last_block IS NULL THEN '' WHEN classification = 'REAL_PARAGRAPH' THEN whole WHEN classification = 'LINE_BASED' THEN text ELSE mixed END, '" + chr(92) + "n{3,}', chr(10) || chr(10), 'g')")} AS text, coalesce(fixes, '') AS fixes
   FROM {p}g LEFT JOIN {p}o2 USING ({keys}) LEFT JOIN {p}o3 USING ({keys}))"""


def paginated_sql(src: str, keys: str, p: str, target: int = 1600) -> str:
    """``src(keys, mode, text)`` -> ``{p}p(keys, page_no, page)``: whole lines, or whole paragraphs with long ones cut."""
    lf, part = "chr(10)", f"substr(block, ofs + 1, {target})"
    space = f"length({part}) - strpos(reverse({part}), ' ')"
    size = f"CASE WHEN contains({part}, ' ') AND {space} > {target * 0.45} THEN {space} + 1 ELSE length({part}) END"
    return f"""{p}a AS MATERIALIZED (SELECT {keys}, CAST(generate_subscripts(x, 1) AS INT) AS i, unnest(x) AS line FROM (SELECT {keys}, string_split({Q.trim('text')}, {lf}) AS x FROM {src} WHERE mode = 'line_preserved')),
 {p}b AS (SELECT {keys}, i, line, 1 AS page, length(line) AS n FROM {p}a WHERE i = 1
  UNION ALL SELECT {', '.join('n.' + k for k in keys.split(', '))}, n.i, n.line, CASE WHEN p.n + length(n.line) + 1 > {target} THEN p.page + 1 ELSE p.page END, CASE WHEN p.n + length(n.line) + 1 > {target} THEN length(n.line) ELSE p.n + length(n.line) + 1 END FROM {p}b p JOIN {p}a n ON {_same(keys)} AND n.i = p.i + 1),
 {p}c AS (SELECT {keys}, page, {Q.trim(f'string_agg(line, {lf} ORDER BY i)')} AS text FROM {p}b GROUP BY {keys}, page),
 {p}d AS MATERIALIZED (SELECT {keys}, CAST(generate_subscripts(x, 1) AS INT) AS bi, unnest(x) AS block FROM (SELECT {keys}, list_filter(list_transform(regexp_split_to_array({Q.trim('text')}, '\\n{{2,}}'), lambda b: {Q.trim('b')}), lambda b: b <> '') AS x FROM {src} WHERE mode <> 'line_preserved')),
 {p}e AS (SELECT {keys}, bi, block, 0 AS pi, CAST(0 AS BIGINT) AS ofs FROM {p}d WHERE length(block) > {target}
  UNION ALL SELECT {keys}, bi, block, pi + 1, ofs + {size} FROM {p}e WHERE ofs + {target} < length(block)),
 {p}u AS (SELECT {keys}, bi, 0 AS pi, block AS text, false AS long FROM {p}d WHERE length(block) <= {target}
  UNION ALL SELECT {keys}, bi, pi, {Q.trim(f'CASE WHEN ofs + {target} >= length(block) THEN {part} ELSE substr({part}, 1, {size}) END')}, true FROM {p}e),
 {p}v AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY bi, pi) AS i FROM {p}u),
 {p}w AS (SELECT {keys}, i, text, 1 AS page, CASE WHEN long THEN -1 ELSE length(text) END AS n FROM {p}v WHERE i = 1
  UNION ALL SELECT {', '.join('n.' + k for k in keys.split(', '))}, n.i, n.text, CASE WHEN NOT n.long AND p.n >= 0 AND p.n + 2 + length(n.text) <= {target} THEN p.page ELSE p.page + 1 END,
   CASE WHEN n.long THEN -1 WHEN p.n >= 0 AND p.n + 2 + length(n.text) <= {target} THEN p.n + 2 + length(n.text) ELSE length(n.text) END FROM {p}w p JOIN {p}v n ON {_same(keys)} AND n.i = p.i + 1),
 {p}x AS (SELECT {keys}, page, string_agg(text, {lf} || {lf} ORDER BY i) AS text FROM {p}w GROUP BY {keys}, page),
 {p}p AS MATERIALIZED (SELECT {keys}, row_number() OVER (PARTITION BY {keys} ORDER BY page) AS page_no, text AS page FROM (SELECT * FROM {p}c UNION ALL SELECT * FROM {p}x) WHERE text <> '')"""


def completed_sql(src: str, p: str) -> str:
    """Hyphenated words completed over page ends: ``src(doc_id, page_no, page)`` -> ``{p}z`` of the same columns."""
    return f"""{p}h1 AS (SELECT *, regexp_replace(page, '\\s+$', '') AS x FROM {src}),
 {p}h2 AS MATERIALIZED (SELECT *, regexp_matches(x, '\\p{{L}}{{2,}}-$') AS ends, regexp_matches(x, '^\\s*\\p{{L}}+-$') AS only, coalesce(lead(regexp_extract(x, '^\\s*(\\p{{L}}+)', 1)) OVER (PARTITION BY doc_id ORDER BY page_no), '') AS nxt FROM {p}h1),
 {p}h3 AS (SELECT doc_id, page_no, page, nxt, ends AND nxt <> '' AS joined, false AS lost FROM {p}h2 WHERE page_no = 1
  UNION ALL SELECT n.doc_id, n.page_no, n.page, n.nxt, n.ends AND n.nxt <> '' AND NOT (n.only AND p.joined), p.joined FROM {p}h3 p JOIN {p}h2 n ON n.doc_id = p.doc_id AND n.page_no = p.page_no + 1),
 {p}h4 AS (SELECT *, CASE WHEN lost THEN regexp_replace(page, '^\\s*\\p{{L}}+[^\\S\\n]*', '') ELSE page END AS cut FROM {p}h3),
 {p}h5 AS (SELECT *, CASE WHEN joined THEN concat(regexp_replace(cut, '-?\\s*$', ''), nxt) ELSE cut END AS out FROM {p}h4),
 {p}z AS (SELECT doc_id, page_no, CASE WHEN joined OR lost THEN {Q.trim("regexp_replace(out, '" + chr(92) + "n{3,}', chr(10) || chr(10), 'g')")} ELSE out END AS page FROM {p}h5)"""


def stored_pages_sql(src: str, p: str, marker: str) -> str:
    """Stored texts, ``src(doc_id, source_type, text)`` -> ``{p}q(doc_id, page_no, page)``."""
    return f"""{p}t AS MATERIALIZED (SELECT doc_id, source_type, {Q.trim("replace(text, chr(13) || chr(10), chr(10))")} AS text FROM {src}),
 {structure_sql(f'{p}t', 'doc_id', p)},
 {p}n AS (SELECT t.doc_id, mode, t.text FROM {p}t t JOIN {p}g g USING (doc_id) WHERE t.text <> '' AND NOT contains(t.text, '{marker}') AND t.source_type <> 'pdf'),
 {paginated_sql(f'{p}n', 'doc_id', p + 'n')},
 {p}y AS (SELECT doc_id, source_type, CAST(generate_subscripts(x, 1) AS INT) AS page_no, unnest(x) AS page FROM (SELECT doc_id, source_type, list_filter(list_transform(string_split(text, '{marker}'), lambda s: {Q.trim('s')}), lambda s: s <> '') AS x FROM {p}t WHERE text <> '' AND (contains(text, '{marker}') OR source_type = 'pdf'))),
 {completed_sql(f"(SELECT doc_id, page_no, page FROM {p}y WHERE source_type = 'pdf')", p)},
 {p}q AS MATERIALIZED (SELECT doc_id, page_no, page FROM {p}np UNION ALL SELECT doc_id, page_no, page FROM {p}y WHERE source_type <> 'pdf' UNION ALL SELECT doc_id, page_no, page FROM {p}z)"""


def shared_sql(pages: str, braille: str, p: str) -> str:
    """Braille paragraphs shared out to pages: ``pages(doc_id, page_no, page)``, ``braille(doc_id, text)`` -> ``{p}s(doc_id, page_no, cells)``."""
    lf2 = "chr(10) || chr(10)"
    units = lambda x: f"list_filter(list_transform(regexp_split_to_array({Q.trim(x)}, '\\n{{2,}}'), lambda s: {Q.trim('s')}), lambda s: s <> '')"
    return f"""{p}c AS MATERIALIZED (SELECT doc_id, {Q.trim('text')} AS whole, {units('text')} AS cs FROM {braille}),
 {p}d AS MATERIALIZED (SELECT doc_id, page_no, len({units('page')}) AS want, count(*) OVER (PARTITION BY doc_id) AS n, sum(len({units('page')})) OVER (PARTITION BY doc_id) AS total, count(*) FILTER (WHERE len({units('page')}) > 0) OVER (PARTITION BY doc_id ORDER BY page_no ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS later FROM {pages}),
 {p}e AS (SELECT doc_id, CAST(0 AS BIGINT) AS page_no, CAST(0 AS BIGINT) AS ofs, CAST(0 AS BIGINT) AS take FROM {p}c
  UNION ALL SELECT doc_id, page_no, ofs, CAST(CASE WHEN page_no = n THEN greatest(l, 0) WHEN want = 0 THEN 0 ELSE greatest(1, least(floor(len(cs) * want / total + 0.5), greatest(l - least(later, greatest(l - 1, 0)), 1))) END AS BIGINT) FROM (
   SELECT n.doc_id, n.page_no, p.ofs + p.take AS ofs, n.n, n.want, n.total, n.later, c.cs, len(c.cs) - p.ofs - p.take AS l FROM {p}e p JOIN {p}d n ON n.doc_id = p.doc_id AND n.page_no = p.page_no + 1 JOIN {p}c c ON c.doc_id = n.doc_id)),
 {p}s AS (SELECT d.doc_id, d.page_no, CASE WHEN n <= 1 THEN whole WHEN len(cs) = 0 THEN '' WHEN total = 0 THEN CASE WHEN d.page_no = 1 THEN array_to_string(cs, {lf2}) ELSE '' END ELSE {Q.trim(f"array_to_string(cs[e.ofs + 1 : e.ofs + e.take], {lf2})")} END AS cells
   FROM {p}d d JOIN {p}c USING (doc_id) JOIN {p}e e ON e.doc_id = d.doc_id AND e.page_no = d.page_no)"""
