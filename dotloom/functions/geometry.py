"""Geometry of one page, as arrays of its own row.

A page is an array of lines, struct(line_no, text, x0, y0, x1, y1), or of items, struct(str, x, y, width, height), with y
growing upwards.  Where a new band, line or group begins is seen from neighbours in sorted order, so it is a filter
over positions; only block walks and column sweeps carry a state, of fixed size, and note where blocks begin.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import blocks as K
from . import predicates as P
from . import regex as R
from . import text as B

PAGE_WIDTH, PAGE_HEIGHT = 612, 792
BAND = 0.8
REGIONS = ("main", "sidebar_left", "sidebar_right")
CLOSING, OPENING = ",.;:!?)}]»", "({[«"
MATH_FRAGMENT = [r"[=≠≤≥∞∫√→←↔⇔∈∉^/_]", r"(?i)\b(?:lim|sin|cos|tan|log|ln|sqrt)\b", r"[A-Za-z]\([A-Za-z0-9]\)"]


def slices(items: Column, starts: Column) -> Column:
    """``items`` cut before each of the positions ``starts`` (ascending, from 0)."""
    return R.let(
        F.struct(items.alias("v"), starts.alias("at")),
        lambda s: F.transform(
            s["at"], lambda b, k: F.slice(s["v"], b + 1, F.coalesce(F.get(s["at"], k + 1), F.size(s["v"])) - b)
        ),
    )


def islands(items: Column, begins) -> Column:
    """``items`` cut wherever ``begins(previous, item)`` holds."""
    return R.let(
        items,
        lambda v: slices(
            v,
            F.filter(
                F.transform(v, lambda _, i: i),
                lambda i: (i == 0) | F.coalesce(begins(F.get(v, F.greatest(i - 1, F.lit(0))), F.get(v, i)), F.lit(False)),
            ),
        ),
    )


def sorted_by(items: Column, *keys) -> Column:
    """``items`` in the order of ``keys``, functions of an item, and then of the item itself."""
    tagged = F.transform(items, lambda x: F.struct(*[k(x).alias(f"k{n}") for n, k in enumerate(keys)], x.alias("x")))
    return F.transform(F.array_sort(tagged), lambda t: t["x"])


def median(values: Column) -> Column:
    """Mean of the middle one or two; null without values."""
    return R.let(
        F.array_sort(values),
        lambda v: F.when(F.size(v) > 0, (F.get(v, F.floor((F.size(v) - 1) / 2).cast("int")) + F.get(v, F.floor(F.size(v) / 2).cast("int"))) / 2),
    )


def _all(items: Column, name: str) -> Column:
    return items[name]


def _positive(items: Column, name: str) -> Column:
    return F.filter(_all(items, name), lambda h: h > 0)


def box(l: Column) -> list[Column]:
    """Corners in order, and width, height and middle."""
    n = lambda c: F.coalesce(l[c].cast("double"), F.lit(0.0))
    x0, x1, y0, y1 = F.least(n("x0"), n("x1")), F.greatest(n("x0"), n("x1")), F.least(n("y0"), n("y1")), F.greatest(n("y0"), n("y1"))
    return [
        x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"), (x1 - x0).alias("width"), (y1 - y0).alias("height"),
        ((x0 + x1) / 2).alias("x_mid"), ((y0 + y1) / 2).alias("y_mid"),
    ]


def ordered(lines: Column, tolerance: float = BAND) -> Column:
    """Lines with text from top to bottom by band, then from left to right, then by text, with their ``band``."""
    boxed = F.transform(
        F.filter(lines, lambda l: R.strip(R.text(l["text"])) != ""), lambda l: F.struct(l["line_no"].alias("line_no"), l["text"].alias("text"), *box(l))
    )
    down = sorted_by(boxed, lambda l: -l["y_mid"], lambda l: l["x0"], lambda l: l["text"])
    bands = islands(down, lambda p, l: p["y_mid"] - l["y_mid"] > tolerance)
    across = lambda ls: sorted_by(ls, lambda l: l["x0"], lambda l: l["text"], lambda l: -l["y_mid"])
    return F.flatten(F.transform(bands, lambda ls, b: F.transform(across(ls), lambda l: l.withField("band", b))))


def column_band(lines: Column, page_width: Column | float = PAGE_WIDTH) -> Column:
    """Medians of the wide lines: struct(band_x0, band_x1, band_width, band_center), null without any."""
    width = F.lit(page_width) if isinstance(page_width, (int, float)) else page_width
    wide = lambda ls: F.greatest(F.coalesce(median(_positive(ls, "width")), F.lit(0.0)) * 0.82, width * 0.36, F.lit(140.0))

    def of(ws: Column) -> Column:
        m = lambda c: median(_all(ws, c))
        made = F.struct(m("x0").alias("band_x0"), m("x1").alias("band_x1"), m("width").alias("band_width"), m("x_mid").alias("band_center"))
        return F.when(F.size(ws) > 0, made)

    return R.let(
        lines, lambda ls: F.when(F.size(ls) >= 3, R.let(R.let(wide(ls), lambda w: F.filter(ls, lambda l: l["width"] >= w)), of))
    )


def regions(lines: Column, page_width: Column | float = PAGE_WIDTH) -> Column:
    """Ordered lines with their ``region`` and layout facts ``f``."""
    width = F.lit(float(page_width)) if isinstance(page_width, (int, float)) else F.coalesce(page_width.cast("double"), F.lit(float(PAGE_WIDTH)))

    def sided(v: Column) -> Column:
        b, w, n = v["b"], v["w"], F.size(v["ls"])
        gutter, none = F.greatest(w * 0.04, F.lit(26.0)), v["b"].isNull()

        def side(l: Column) -> Column:
            right, left = l["x0"] >= w * 0.62, l["x1"] <= w * 0.38
            narrow = (l["width"] > 0) & (l["width"] <= w * 0.42)
            inside = ~none & (l["x_mid"] >= b["band_x0"] - gutter) & (l["x_mid"] <= b["band_x1"] + gutter)
            out_right = F.when(none, right).otherwise(l["x0"] >= b["band_x1"] + gutter * 0.5)
            out_left = F.when(none, left).otherwise(l["x1"] <= b["band_x0"] - gutter * 0.5)
            return (
                F.when((n < 3) | F.coalesce(inside, F.lit(False)), "main")
                .when(narrow & out_right & (right | (l["x0"] >= F.coalesce(b["band_center"], F.lit(0.0)))), "sidebar_right")
                .when(narrow & out_left & (left | (l["x1"] <= F.coalesce(b["band_center"], w))), "sidebar_left")
                .otherwise("main")
            )

        def settled(ls: Column) -> Column:
            alone = lambda s: F.size(F.filter(ls, lambda l: l["region"] == s)) < 2

            def one(l: Column) -> Column:
                f, t = l["f"], l["text"]
                note = (
                    ~f["math"] & F.regexp_count(t, F.lit(r"\S+")).between(2, 8) & (F.length(t) <= 60) & (l["region"] == "sidebar_right")
                    & (l["x0"] >= F.greatest(w * 0.62, F.coalesce(b["band_x1"], F.lit(0.0)) + gutter * 0.75))
                    & (l["width"] <= F.greatest(w * 0.24, F.lit(110.0)))
                )
                strong = f["kw"].isNotNull() | f["caption"] | f["heading"] | note
                lone = F.when(l["region"] == "sidebar_left", alone("sidebar_left")).when(l["region"] == "sidebar_right", alone("sidebar_right")).otherwise(False)
                return l.withField("region", F.when(~lone | strong, l["region"]).otherwise("main"))

            return F.transform(ls, one)

        return R.let(F.transform(v["ls"], lambda l: l.withField("region", side(l)).withField("f", P.layout_facts(l["text"]))), settled)

    return R.let(lines, lambda ls: R.let(F.struct(ls.alias("ls"), column_band(ls, width).alias("b"), width.alias("w")), sided))


def _block_starts(lines: Column, h: Column, width: Column, continuation: bool) -> Column:
    """Where blocks begin among the ordered lines of one region; the state says what the block holds so far."""
    no = F.lit(False)
    start = F.struct(
        F.array().cast("array<int>").alias("at"), F.lit(0).alias("i"), F.lit(None).cast("string").alias("kw"), F.lit(0.0).alias("fx"),
        F.lit(True).alias("eq"), no.alias("prose"), no.alias("body"), F.lit(0.0).alias("py"), F.lit(0.0).alias("px"), no.alias("pstep"), no.alias("pmath"),
    )
    indent = F.greatest(width * 0.035, F.lit(18.0))

    def step(s: Column, l: Column) -> Column:
        f, gap = l["f"], s["py"] - l["y_mid"]
        announced, wordy = f["kw"].isNotNull() | f["caption"], f["prose"] | f["short"]
        in_example, in_theorem = F.coalesce(s["kw"] == "example", no), F.coalesce(s["kw"] == "theorem", no)
        example_ends = (
            in_example & wordy & ~f["math"] & ~announced & (F.abs(l["x0"] - s["fx"]) <= F.greatest(width * 0.03, F.lit(16.0)))
            & s["body"] & ((s["px"] - s["fx"] >= indent) | s["pmath"])
        )
        runs_on = (in_theorem & ~f["theorem_end"] & (gap <= F.greatest(h * 3.2, F.lit(48.0)))) | (
            in_example & ~f["example_end"] & ~announced & (gap <= F.greatest(h * 2.35, F.lit(32.0))) & (wordy | f["math"] | f["step"])
        )
        standalone = announced | (f["heading"] & s["prose"]) | ((F.abs(s["px"] - l["x0"]) > F.greatest(width * 0.06, F.lit(26.0))) & f["heading"])
        grouped = (gap <= F.greatest(h * 1.5, F.lit(16.0))) & s["pstep"] & f["step"] & ~announced & ~f["short"]
        plain = F.when(standalone, True).when(grouped, False).when(s["eq"] & wordy, True).otherwise(gap > F.greatest(h * 1.9, F.lit(18.0)))
        splits = F.when(example_ends, True).when(runs_on, False).otherwise(plain) if continuation else plain
        return R.let(
            (s["i"] == 0) | splits,
            lambda fresh: F.struct(
                F.when(fresh, F.concat(s["at"], F.array(s["i"]))).otherwise(s["at"]).alias("at"), (s["i"] + 1).alias("i"),
                F.when(fresh, f["kw"]).otherwise(s["kw"]).alias("kw"), F.when(fresh, l["x0"]).otherwise(s["fx"]).alias("fx"),
                ((fresh | s["eq"]) & f["step"]).alias("eq"), ((~fresh & s["prose"]) | f["prose"]).alias("prose"),
                (~fresh & (s["body"] | (l["x0"] - s["fx"] >= indent) | f["math"])).alias("body"),
                l["y_mid"].alias("py"), l["x0"].alias("px"), f["step"].alias("pstep"), f["math"].alias("pmath"),
            ),
        )

    return F.aggregate(lines, start, step, lambda s: s["at"])


def blocks(lines: Column, page_width: Column | float = PAGE_WIDTH, continuation: bool = True) -> Column:
    """Lines with regions -> array of struct(region, block_no, lines), block numbers within each region.

    A block ends at a large vertical gap, at captions, keywords and headings, and where a run of equation steps meets
    prose.  With ``continuation`` a running example or theorem goes on over larger gaps, and an example ends when text
    returns to its margin.
    """
    width = F.lit(float(page_width)) if isinstance(page_width, (int, float)) else F.coalesce(page_width.cast("double"), F.lit(float(PAGE_WIDTH)))

    def one(ls: Column, region: Column) -> Column:
        h = F.coalesce(median(_positive(ls, "height")), F.lit(12.0))
        cut = R.let(h, lambda hh: slices(ls, _block_starts(ls, hh, width, continuation)))
        return F.transform(cut, lambda b, k: F.struct(region.alias("region"), k.alias("block_no"), b.alias("lines")))

    names = F.array(*map(F.lit, REGIONS))
    return R.let(
        lines, lambda all_: F.flatten(F.transform(names, lambda r: R.let(F.filter(all_, lambda l: l["region"] == r), lambda ls: one(ls, r))))
    )


def typed_blocks(found: Column) -> Column:
    """Blocks with type, box and number of lines; sidebar paragraphs become notes."""

    def one(b: Column) -> Column:
        kind = K.typed(b["lines"])
        low, high = lambda c: F.array_min(_all(b["lines"], c)), lambda c: F.array_max(_all(b["lines"], c))
        return F.struct(
            b["region"].alias("region"), b["block_no"].alias("block_no"),
            R.let(kind, lambda k: F.when((b["region"] != "main") & (k == "paragraph"), "sidebar_note").otherwise(k)).alias("type"),
            low("x0").alias("x0"), low("y0").alias("y0"), high("x1").alias("x1"), high("y1").alias("y1"), _all(b["lines"], "text").alias("lines"),
        )

    return F.transform(found, one)


def blocks_in_order(typed: Column) -> Column:
    """Typed blocks by bands of their tops, main column before sidebars, then x; adds ``band``."""

    def arrange(bs: Column) -> Column:
        heights = F.filter(F.transform(bs, lambda b: b["y1"] - b["y0"]), lambda h: h > 0)
        down = sorted_by(bs, lambda b: -b["y1"], lambda b: b["x0"], lambda b: b["region"], lambda b: b["block_no"])
        rank = lambda b: F.when(b["region"] == "main", 0).otherwise(1)
        across = lambda g: sorted_by(g, rank, lambda b: b["x0"], lambda b: b["block_no"], lambda b: b["region"])
        return R.let(
            F.greatest(F.coalesce(median(heights), F.lit(14.0)) * 1.6, F.lit(26.0)),
            lambda tol: F.flatten(
                F.transform(islands(down, lambda p, b: p["y1"] - b["y1"] > tol), lambda g, n: F.transform(across(g), lambda b: b.withField("band", n)))
            ),
        )

    return R.let(typed, arrange)


def numbered(lines: Column) -> Column:
    """Lines struct(text, x0, y0, x1, y1) with their line_no."""
    return F.transform(
        lines,
        lambda l, i: F.struct(i.alias("line_no"), l["text"].alias("text"), *[l[c].cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")]),
    )


def page_tree(in_order: Column, page_no: Column) -> Column:
    """Typed blocks of one page in their order, in the shape of ``blocks.page_tree``."""

    def block(b: Column, i: Column) -> Column:
        return R.let(
            K.block_id(page_no, i),
            lambda id: F.struct(
                page_no.cast("int").alias("page_no"), id.alias("id"), i.alias("ord"), b["type"].alias("type"), b["lines"].alias("lines"),
                R.strip(F.array_join(b["lines"], "\n")).alias("content"), K.steps(id, b["type"], b["lines"]).alias("children"),
                F.struct(*[b[c].alias(c) for c in ("x0", "y0", "x1", "y1")]).alias("bbox"),
            ),
        )

    return F.transform(in_order, block)


# ------------------------------------------------------------- positioned items


def item_lines(items: Column) -> Column:
    """Items -> lines from the top: struct(line_no, text, x0, x1, y, height, y0, y1, items).

    Items share a line until the drop exceeds max(0.45 heights, 3).  Texts join with a space where the gap exceeds
    max(0.2 heights, 2.4) and no punctuation closes or opens, or where an item itself begins or ends in space.
    """
    # what is asked of an item is made once, before the items of a line are looked at together
    made = lambda i: F.struct(
        i["str"].alias("str"), *[i[c].alias(c) for c in ("x", "y", "width", "height")], R.strip(F.regexp_replace(i["str"], R.UNEVEN_SPACE, " ")).alias("word"),
        (i["x"] + i["width"]).alias("end"), (i["y"] - i["height"]).alias("low"), (i["y"] + i["height"]).alias("high"),
    )
    clean = F.transform(F.filter(items, lambda i: R.strip(R.text(i["str"])) != ""), made)
    down = sorted_by(clean, lambda i: -i["y"], lambda i: i["x"])
    rows = islands(down, lambda p, i: p["y"] - i["y"] > F.greatest(i["height"] * 0.45, F.lit(3.0)))
    sign = lambda signs, c: F.lit(signs).contains(c)

    def line(row: Column, n: Column) -> Column:
        def joined(own: Column) -> Column:
            def piece(i: Column, k: Column) -> Column:
                def after(before: Column) -> Column:
                    gap = i["x"] - before["x"] - before["width"]
                    spaced = (
                        (gap > F.greatest(i["height"] * 0.2, F.lit(2.4))) & ~sign(CLOSING, F.substring(i["word"], 1, 1))
                        & ~sign(OPENING, F.substring(before["word"], -1, 1))
                    )
                    loose = sign(R.SPACES, F.substring(i["str"], 1, 1)) | sign(R.SPACES, F.substring(before["str"], -1, 1))
                    return F.concat(F.when(spaced | loose, " ").otherwise(""), i["word"])

                return F.when(k == 0, i["word"]).otherwise(after(F.get(own, k - 1)))

            ys = _all(own, "y")
            return F.struct(
                n.alias("line_no"), B.normalize_pdf_math(F.array_join(F.transform(own, piece), "")).alias("text"),
                F.array_min(_all(own, "x")).alias("x0"), F.array_max(_all(own, "end")).alias("x1"),
                (F.aggregate(ys, F.lit(0.0), lambda a, y: a + y) / F.size(ys)).alias("y"), F.array_max(_all(own, "height")).alias("height"),
                F.array_min(_all(own, "low")).alias("y0"), F.array_max(_all(own, "high")).alias("y1"), own.alias("items"),
            )

        return R.let(sorted_by(row, lambda i: i["x"]), joined)

    return F.transform(rows, line)


def is_math_fragment(t: Column) -> Column:
    return R.let(R.strip(t), lambda x: R.matches(x, MATH_FRAGMENT[0]) | R.matches(x, MATH_FRAGMENT[1]) | R.matches(x, MATH_FRAGMENT[2]))


def _columns(items: Column) -> Column:
    """Items of a stacked formula, from left to right, cut into columns: a column closes where the next item begins
    beyond all of its ends by more than max(0.6 heights, 10)."""
    start = F.struct(F.array().cast("array<int>").alias("at"), F.lit(0).alias("i"), F.lit(0.0).alias("reach"))

    def step(s: Column, i: Column) -> Column:
        fresh = (s["i"] == 0) | (i["x"] > s["reach"] + F.greatest(i["height"] * 0.6, F.lit(10.0)))
        end = i["x"] + i["width"]
        return F.struct(
            F.when(fresh, F.concat(s["at"], F.array(s["i"]))).otherwise(s["at"]).alias("at"), (s["i"] + 1).alias("i"),
            F.when(s["i"] == 0, end).otherwise(F.greatest(s["reach"], end)).alias("reach"),
        )

    return slices(items, F.aggregate(items, start, step, lambda s: s["at"]))


def _stacked(lines: Column, own_items) -> Column:
    """Text of a group of stacked lines: items above and below the base line become fractions and limits."""
    relation = lambda l: R.matches(l["text"], "[=≠≤≥]")
    # base line: the highest with a relation sign, else the widest
    ranked = F.transform(
        lines, lambda l: F.struct(relation(l).alias("r"), F.when(relation(l), l["y"]).otherwise(l["x1"] - l["x0"]).alias("s"), l["y"].alias("y"))
    )

    def column(base: Column):
        lift = lambda i: F.greatest(i["height"] * 0.35, F.lit(2.0))

        def text(own: Column) -> Column:
            join = lambda test: R.strip(F.array_join(F.transform(F.filter(own, test), lambda i: R.strip(i["str"])), " "))
            parts = F.struct(
                join(lambda i: F.abs(i["y"] - base) <= lift(i)).alias("b"), join(lambda i: i["y"] > base + lift(i)).alias("u"),
                join(lambda i: i["y"] < base - lift(i)).alias("l"),
            )

            def made(p: Column) -> Column:
                b, u, l = p["b"], p["u"], p["l"]
                return (
                    F.when((F.lower(b) == "lim") & (l != ""), F.concat(F.lit("lim "), l))
                    .when((u != "") & (l != ""), F.concat(F.when(b != "", F.concat(b, F.lit(" "))).otherwise(""), u, F.lit("/"), l))
                    .otherwise(F.concat_ws(" ", *[F.when(x != "", x) for x in (b, u, l)]))
                )

            return R.let(parts, made)

        return text

    items = sorted_by(F.flatten(F.transform(lines, own_items)), lambda i: i["x"], lambda i: i["y"])
    return R.let(
        F.array_max(ranked)["y"],
        lambda base: B.normalize_pdf_math(F.regexp_replace(F.array_join(F.transform(R.let(items, _columns), column(base)), " "), r"\s+,", ",")),
    )


def merged_lines(lines: Column) -> Column:
    """Lines of ``item_lines`` with stacked fragments of one formula as one line.

    Neighbours join when they are close, overlap horizontally, one of them is short and one is mathematical.  Gives
    struct(text, kind, n_lines, x0, y0, x1, y1, y).
    """
    minor = lambda l: ((l["x1"] - l["x0"]) <= 150) | (F.length(l["text"]) <= 18) | ~l["text"].rlike(r"\s")

    def apart(p: Column, l: Column) -> Column:
        gap = p["y"] - l["y"]
        shared = F.least(l["x1"], p["x1"]) - F.greatest(l["x0"], p["x0"])
        narrow = F.least(l["x1"] - l["x0"], p["x1"] - p["x0"])
        return ~(
            (gap > 0) & (gap <= F.greatest(l["height"], p["height"]) * 2.2) & (shared > 0) & (shared >= narrow * 0.18)
            & (minor(l) | minor(p)) & (l["math"] | p["math"])
        )

    def one(g: Column, ls: Column) -> Column:
        text = F.when(F.size(g) > 1, _stacked(g, lambda l: F.get(ls, l["line_no"])["items"])).otherwise(F.get(g, F.lit(0))["text"])
        low, high = lambda c: F.array_min(_all(g, c)), lambda c: F.array_max(_all(g, c))
        return R.let(
            text,
            lambda t: F.struct(
                t.alias("text"), F.when(is_math_fragment(t), "math").otherwise("text").alias("kind"), F.size(g).alias("n_lines"),
                low("x0").alias("x0"), low("y0").alias("y0"), high("x1").alias("x1"), high("y1").alias("y1"), high("y").alias("y"),
            ),
        )

    # the items stay where they are, at the place of their line's number; only stacked lines ask for them
    brief = lambda l: F.struct(*[l[c].alias(c) for c in ("line_no", "text", "x0", "x1", "y", "height", "y0", "y1")], is_math_fragment(l["text"]).alias("math"))
    down = lambda ls: sorted_by(F.transform(ls, brief), lambda l: -l["y"], lambda l: l["x0"])
    return R.let(lines, lambda ls: F.transform(islands(down(ls), apart), lambda g: one(g, ls)))
