"""Blocks of a text, as arrays of its own row.

Blank lines are where a text is split, so block numbers need no running sum; a block is classified from the facts of
its lines by position; the walk inside a run of lines carries a state of fixed size and only notes where blocks begin.
Nothing here explodes, joins, windows or exchanges.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import language as L
from . import predicates as P
from . import regex as R
from . import text as B

REAL, LINES, MIXED = "REAL_PARAGRAPH", "LINE_BASED", "MIXED"
_STRINGS = "array<string>"


def unix(text: Column) -> Column:
    """Line feeds alone, no-break spaces as spaces; null is empty."""
    return F.replace(F.replace(R.text(text), F.lit("\r\n"), F.lit("\n")), F.lit("\xa0"), F.lit(" "))


def right_trimmed(text: Column) -> Column:
    """White space before every line end removed, so that a blank line is an empty one."""
    return F.regexp_replace(text, r"[ \t\x0B\f\r]+(?=\n|\z)", "")


def runs(trimmed: Column) -> Column:
    """Runs of lines between blank ones: array of arrays of lines."""
    whole = F.regexp_replace(trimmed, r"^\n+|\n+\z", "")
    return F.transform(F.filter(F.split(whole, "\n{2,}"), lambda b: b != ""), lambda b: F.split(b, "\n"))


def _count(items: Column, test) -> Column:
    return F.size(F.filter(items, test))


def block_type(lines: Column, source_type: Column) -> Column:
    """Structure type of a block from its lines."""

    def kind(v: Column) -> Column:
        c, w, n, avg, s = (v[k] for k in ("c", "w", "n", "avg", "s"))
        most = F.greatest(F.lit(1), F.floor((n - 1) * 0.6))
        return (
            F.when((n == 1) & v["head"], LINES)
            .when(v["list"] | v["formula"], F.when(c > 0, MIXED).otherwise(LINES))
            .when((c >= most) & (avg >= 26), REAL)
            .when(F.coalesce(source_type == "pdf", F.lit(False)) & (w >= most), REAL)
            .when(s >= F.greatest(F.lit(2), F.ceil(n * 0.7)), LINES)
            .when(avg >= 58, REAL)
            .otherwise(F.when(c > 0, MIXED).otherwise(LINES))
        )

    def shape(fs: Column) -> Column:
        joined = F.filter(fs, lambda f, i: F.coalesce(f["plain"] & F.get(fs, i + 1)["plain"], F.lit(False)))
        wraps = F.filter(
            fs,
            lambda f, i: F.coalesce(
                f["plain"] & F.get(fs, i + 1)["plain"] & ~f["end"] & ((f["len"] >= 18) | (F.get(fs, i + 1)["len"] >= 18)), F.lit(False)
            ),
        )
        return R.let(
            F.struct(
                F.size(joined).alias("c"), F.size(wraps).alias("w"), F.size(fs).alias("n"), _count(fs, lambda f: f["len"] <= 44).alias("s"),
                (F.aggregate(fs, F.lit(0), lambda a, f: a + f["len"]) / F.size(fs)).alias("avg"),
                F.get(fs, F.lit(0))["head"].alias("head"), F.exists(fs, lambda f: f["list"]).alias("list"),
                F.exists(fs, lambda f: f["formula"]).alias("formula"),
            ),
            kind,
        )

    return R.let(F.transform(lines, lambda l: P.structure_facts(R.strip(l))), shape)


def mode_of(kind: Column, had_blank: Column) -> Column:
    return (
        F.when(kind == LINES, "line_preserved")
        .when(kind == REAL, F.when(had_blank, "paragraph_preserved").otherwise("plain_prose"))
        .otherwise("mixed_structured")
    )


def structure(text: Column, source_type: Column) -> Column:
    """struct(blocks, classification, mode); a block is struct(lines, type, break_after)."""

    def block(bs: Column, ends: Column) -> Column:
        return F.transform(
            bs,
            lambda ls, i: F.struct(
                ls.alias("lines"), block_type(ls, source_type).alias("type"), ((i < F.size(bs) - 1) | ends).alias("break_after")
            ),
        )

    def judged(bs: Column) -> Column:
        kinds = F.array_distinct(F.transform(bs, lambda b: b["type"]))
        blank = F.exists(bs, lambda b: b["break_after"])
        return R.let(
            R.let(kinds, lambda k: F.when(F.size(k) == 0, REAL).when(F.size(k) == 1, F.get(k, F.lit(0))).otherwise(MIXED)),
            lambda k: F.struct(bs.alias("blocks"), k.alias("classification"), mode_of(k, blank).alias("mode")),
        )

    trimmed = right_trimmed(unix(text))
    return R.let(trimmed, lambda x: R.let(R.let(runs(x), lambda bs: block(bs, x.endswith("\n"))), judged))


def rebuilt(text: Column, s: Column, merge) -> Column:
    """struct(text, fixes): the text again by its structure ``s``; ``merge`` joins wrapped lines of a block."""
    blocks, empty = s["blocks"], F.array().cast(_STRINGS)
    pack = lambda ls, fx: F.struct(ls.alias("lines"), fx.alias("fixes"))
    whole = R.let(
        merge(F.flatten(F.transform(blocks, lambda b: b["lines"]))),
        lambda m: F.struct(F.array_join(m["lines"], "\n\n").alias("text"), m["fixes"].alias("fixes")),
    )

    def gap(b: Column, i: Column, m: Column) -> Column:
        return F.when(b["break_after"] & (i < F.size(blocks) - 1), F.concat(m["lines"], F.array(F.lit("")))).otherwise(m["lines"])

    per_block = F.transform(
        blocks,
        lambda b, i: R.let(
            F.when(b["type"] == REAL, merge(b["lines"])).otherwise(pack(b["lines"], empty)), lambda m: pack(gap(b, i, m), m["fixes"])
        ),
    )
    mixed = R.let(
        per_block,
        lambda ms: F.struct(
            F.array_join(F.flatten(F.transform(ms, lambda m: m["lines"])), "\n").alias("text"),
            F.array_distinct(F.flatten(F.transform(ms, lambda m: m["fixes"]))).alias("fixes"),
        ),
    )
    kind = s["classification"]
    built = (
        F.when(F.size(blocks) == 0, F.struct(F.lit("").alias("text"), empty.alias("fixes")))
        .when(kind == REAL, whole).when(kind == LINES, F.struct(unix(text).alias("text"), empty.alias("fixes"))).otherwise(mixed)
    )
    return R.let(
        built, lambda r: F.struct(R.strip(F.regexp_replace(r["text"], r"\n{3,}", "\n\n")).alias("text"), r["fixes"].alias("fixes"))
    )


def completed_pages(pages: Column) -> Column:
    """Page texts with words that are hyphenated over a page end completed on the first page.

    A page joins the next when it ends in a hyphenated word and the next begins with a word.  A page that is nothing
    but a hyphenated word has nothing left to join with once the page before took it.
    """

    def facts(ps: Column) -> Column:
        def one(p: Column) -> Column:
            x = F.regexp_replace(p, r"\s+\z", "")
            return F.struct(
                x.rlike(r"\p{L}{2,}-\z").alias("ends"), F.regexp_extract(x, r"^\s*(\p{L}+)", 1).alias("first"), x.rlike(r"^\s*\p{L}+-\z").alias("only")
            )

        return F.transform(ps, one)

    def joins(fs: Column) -> Column:
        start = F.struct(F.array().cast("array<boolean>").alias("out"), F.lit(False).alias("last"))

        def step(s: Column, i: Column) -> Column:
            f, following = F.get(fs, i), F.coalesce(F.get(fs, i + 1)["first"], F.lit(""))
            joined = f["ends"] & (following != "") & ~(f["only"] & s["last"])
            return R.let(joined, lambda j: F.struct(F.concat(s["out"], F.array(j)).alias("out"), j.alias("last")))

        return F.aggregate(F.sequence(F.lit(0), F.size(fs) - 1), start, step, lambda s: s["out"])

    def rewrite(v: Column) -> Column:
        def page(p: Column, i: Column) -> Column:
            join, lost = F.get(v["js"], i), F.coalesce(F.when(i > 0, F.get(v["js"], i - 1)), F.lit(False))
            cut = F.when(lost, F.regexp_replace(p, r"^\s*\p{L}+[^\S\n]*", "")).otherwise(p)
            out = F.when(join, F.concat(F.regexp_replace(cut, r"-?\s*\z", ""), F.get(v["fs"], i + 1)["first"])).otherwise(cut)
            return F.when(join | lost, R.strip(F.regexp_replace(out, r"\n{3,}", "\n\n"))).otherwise(out)

        return F.transform(v["ps"], page)

    def body(ps: Column) -> Column:
        whole = R.let(facts(ps), lambda fs: R.let(F.struct(ps.alias("ps"), fs.alias("fs"), joins(fs).alias("js")), rewrite))
        return F.when(F.size(ps) > 1, whole).otherwise(ps)

    return R.let(pages, body)


def spoken_language(blocks: Column) -> Column:
    """Language of the blocks: mixed when known ones differ, else the one they have."""
    told = F.transform(blocks, lambda b: L.language_of(F.array_join(b["lines"], "\n")))
    return R.let(
        F.array_distinct(F.filter(told, lambda t: t != "unknown")),
        lambda known: F.when(F.size(known) > 1, "mixed").otherwise(F.coalesce(F.get(known, F.lit(0)), F.lit("unknown"))),
    )


def mode_of_pages(modes: Column) -> Column:
    """One mode for all pages of a document."""

    def one(ms: Column) -> Column:
        prose = F.forall(ms, lambda m: m.isin("plain_prose", "paragraph_preserved"))
        return F.when(F.size(ms) == 0, "plain_prose").when(F.size(ms) == 1, F.get(ms, F.lit(0))).when(prose, "paragraph_preserved").otherwise("mixed_structured")

    return R.let(F.array_distinct(F.filter(modes, lambda m: m != "")), one)


def language_of_pages(languages: Column) -> Column:
    """One language for all pages; Turkish with English is mixed; else the first."""

    def one(ls: Column) -> Column:
        both = F.array_contains(ls, "tr") & F.array_contains(ls, "en")
        return F.when(both, "mixed").otherwise(F.coalesce(F.get(ls, F.lit(0)), F.lit("unknown")))

    return R.let(F.filter(languages, lambda l: l != ""), one)


# ---------------------------------------------------------------- typed blocks


def _starts(facts: Column) -> Column:
    """Where blocks begin inside a run of lines: a run of equation steps ends before prose, but a running theorem or
    example goes on.  The state is the keyword of the block and whether it is all steps so far."""
    first = F.get(facts, F.lit(0))["f"]
    start = F.struct(F.array(F.lit(0)).alias("at"), F.lit(0).alias("i"), first["kw"].alias("kw"), F.lit(True).alias("eq"))

    def step(s: Column, l: Column) -> Column:
        f, no = l["f"], F.lit(False)
        keeps = F.coalesce((s["kw"] == "theorem") & ~f["theorem_end"], no) | F.coalesce(
            (s["kw"] == "example") & ~f["example_end"] & f["kw"].isNull() & ~f["caption"] & (f["prose"] | f["short"] | f["math"] | f["step"]), no
        )
        return R.let(
            (s["i"] > 0) & ~keeps & s["eq"] & f["prose"],
            lambda fresh: F.struct(
                F.when(fresh, F.concat(s["at"], F.array(s["i"]))).otherwise(s["at"]).alias("at"), (s["i"] + 1).alias("i"),
                F.when(fresh, f["kw"]).otherwise(s["kw"]).alias("kw"), ((fresh | s["eq"]) & f["step"]).alias("eq"),
            ),
        )

    return F.aggregate(facts, start, step, lambda s: s["at"])


def line_facts(lines: Column) -> Column:
    return F.transform(lines, lambda l: F.struct(l.alias("text"), P.layout_facts(l).alias("f")))


def segments(text: Column) -> Column:
    """Page text -> blocks as arrays of struct(text, f), the lines and their layout facts."""

    def cut(fs: Column) -> Column:
        return R.let(
            _starts(fs), lambda at: F.transform(at, lambda b, k: F.slice(fs, b + 1, F.coalesce(F.get(at, k + 1), F.size(fs)) - b))
        )

    lines = F.transform(F.split(F.replace(R.text(text), F.lit("\r\n"), F.lit("\n")), "\n"), B.normalize_line)
    return F.flatten(F.transform(runs(F.array_join(lines, "\n")), lambda ls: R.let(line_facts(ls), cut)))


def typed(facts: Column) -> Column:
    """Type of a block from the facts of its lines."""

    def kind(v: Column) -> Column:
        first, ff, n = v["first"], v["ff"], v["n"]
        strong = (v["prose"] > 0) & (ff["lead"] | ff["prose"] | (v["prose"] >= F.ceil(n / 2)))
        return (
            F.when(ff["caption"], F.when(F.lower(first).startswith("table"), "table_placeholder").otherwise("graph_placeholder"))
            .when(ff["heading"] & (n <= 2), F.when(F.length(first) <= 38, "chapter_header").otherwise("section_header"))
            .when(ff["kw"].isNotNull(), ff["kw"])
            .when(v["all"], "equation_group")
            .when(strong, "paragraph")
            .when(v["some"] & ~ff["rule"] & (n >= 2), "equation_group")
            .otherwise("paragraph")
        )

    head = F.get(facts, F.lit(0))
    return R.let(
        F.struct(
            R.strip(head["text"]).alias("first"), head["f"].alias("ff"), F.size(facts).alias("n"),
            _count(facts, lambda l: l["f"]["prose"] | l["f"]["short"] | l["f"]["lead"]).alias("prose"),
            F.forall(facts, lambda l: l["f"]["math"]).alias("all"), F.exists(facts, lambda l: l["f"]["any_math"]).alias("some"),
        ),
        kind,
    )


def two_digits(i: Column) -> Column:
    s = i.cast("string")
    return F.lpad(s, F.greatest(F.lit(2), F.length(s)), F.lit("0"))


def block_id(page_no: Column, order: Column, prefix: str = "block") -> Column:
    s = order.cast("string")
    return F.concat(F.lit(prefix + "-"), page_no.cast("string"), F.lit("-"), F.lpad(s, F.greatest(F.lit(4), F.length(s)), F.lit("0")))


def steps(id: Column, kind: Column, lines: Column) -> Column:
    """Children of a block: one for each line of an equation group."""
    none = F.array().cast("array<struct<id:string,ord:int,type:string,content:string>>")
    return F.when(
        kind == "equation_group",
        F.transform(
            lines,
            lambda l, i: F.struct(
                F.concat(id, F.lit("-step-"), two_digits(i + 1)).alias("id"), i.alias("ord"), F.lit("equation_step").alias("type"), l.alias("content")
            ),
        ),
    ).otherwise(none)


def page_tree(text: Column, page_no: Column) -> Column:
    """Blocks of one page: array of struct(page_no, id, ord, type, lines, content, children)."""

    def block(fs: Column, i: Column) -> Column:
        return R.let(
            F.struct(typed(fs).alias("type"), block_id(page_no, i).alias("id"), F.transform(fs, lambda l: l["text"]).alias("lines")),
            lambda v: F.struct(
                page_no.cast("int").alias("page_no"), v["id"].alias("id"), i.alias("ord"), v["type"].alias("type"), v["lines"].alias("lines"),
                R.strip(F.array_join(v["lines"], "\n")).alias("content"), steps(v["id"], v["type"], v["lines"]).alias("children"),
                F.lit(None).cast("struct<x0:double,y0:double,x1:double,y1:double>").alias("bbox"),
            ),
        )

    return F.transform(segments(text), block)


def tree(pages: Column) -> Column:
    """Blocks of all pages of a document, in order."""
    return F.flatten(F.transform(pages, lambda p, i: page_tree(p, i + 1)))


def leaves(blocks: Column) -> Column:
    """Leaves of a block tree in order: array of struct(child, of, id, type, content, parent_id, parent_type).

    ``child`` is the place among its siblings, from 0, and ``of`` how many there are (0 for a block without children).
    """

    def leaf(b: Column, j: Column, c: Column, parent: bool) -> Column:
        null = F.lit(None).cast("string")
        return F.struct(
            j.cast("int").alias("child"), F.size(b["children"]).alias("of"), *[c[n].alias(n) for n in ("id", "type", "content")],
            (b["id"] if parent else null).alias("parent_id"), (b["type"] if parent else null).alias("parent_type"),
        )

    return F.flatten(
        F.transform(
            blocks,
            lambda b: F.when(F.size(b["children"]) > 0, F.transform(b["children"], lambda c, j: leaf(b, j, c, True)))
            .otherwise(F.array(leaf(b, F.lit(0), b, False))),
        )
    )


def with_parents(cells: Column) -> Column:
    """Leaves with their ``cells`` -> struct(id, parent_id, type, cells) of leaves and of parents, which join their children.

    The leaves of a parent are neighbours, so a parent is the slice that begins at its first child.
    """

    def node(id: Column, parent: Column, kind: Column, c: Column) -> Column:
        return F.struct(id.alias("id"), parent.cast("string").alias("parent_id"), kind.alias("type"), c.alias("cells"))

    def parent(x: Column) -> Column:
        own = F.filter(F.transform(F.slice(cells, x["k"] + 1, x["l"]["of"]), lambda c: c["cells"]), lambda c: c != "")
        return node(x["l"]["parent_id"], F.lit(None), x["l"]["parent_type"], F.array_join(own, "\n\n"))

    numbered = F.transform(cells, lambda l, k: F.struct(k.alias("k"), l.alias("l")))
    heads = F.filter(numbered, lambda x: (x["l"]["of"] > 0) & (x["l"]["child"] == 0))
    return F.concat(F.transform(cells, lambda l: node(l["id"], l["parent_id"], l["type"], l["cells"])), F.transform(heads, parent))


def attached(blocks: Column, chunks: Column) -> Column:
    """Leaf k takes chunk k, the last leaf takes all that are left; parents join their children."""

    def pair(v: Column) -> Column:
        ls, cs = v["ls"], v["cs"]
        own = lambda k: F.when(k == F.size(ls) - 1, F.array_join(F.slice(cs, k + 1, F.size(cs)), "\n\n"))
        return F.transform(ls, lambda l, k: l.withField("cells", own(k).otherwise(F.coalesce(F.get(cs, k), F.lit("")))))

    return R.let(R.let(F.struct(leaves(blocks).alias("ls"), chunks.alias("cs")), pair), with_parents)
