"""Layout operators over tables of positioned lines and items.

Coordinates are in page space with y growing upwards.  Lines (or items) of a page are brought together once, by
``pages``; everything after that works on the page's array in its row (``functions.geometry``), so a page costs one
exchange whatever is asked of it.  A page is bounded in size.  Positions that differ by no more than a tolerance count
as equal: rows are put into bands at every larger gap, which makes the order transitive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import geometry as G

PAGE_WIDTH, PAGE_HEIGHT = G.PAGE_WIDTH, G.PAGE_HEIGHT
KEYS = ["doc_id", "page_no"]


def normalize_bbox(df: DataFrame) -> DataFrame:
    """Corners in order, and width, height and middle of every box."""
    n = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    boxed = df.select(
        *[c for c in df.columns if c not in ("x0", "y0", "x1", "y1")],
        F.least(n("x0"), n("x1")).alias("x0"), F.least(n("y0"), n("y1")).alias("y0"),
        F.greatest(n("x0"), n("x1")).alias("x1"), F.greatest(n("y0"), n("y1")).alias("y1"),
    )
    return boxed.select(
        "*", (F.col("x1") - F.col("x0")).alias("width"), (F.col("y1") - F.col("y0")).alias("height"),
        ((F.col("x0") + F.col("x1")) / 2).alias("x_mid"), ((F.col("y0") + F.col("y1")) / 2).alias("y_mid"),
    )


def overlap_y(a: str, b: str) -> Column:
    """Vertical overlap of two boxes as a share of the lower one (1 high at least)."""
    high = lambda r: F.when(F.col(f"{r}.y1") - F.col(f"{r}.y0") > 0, F.col(f"{r}.y1") - F.col(f"{r}.y0")).otherwise(1.0)
    shared = F.least(F.col(f"{a}.y1"), F.col(f"{b}.y1")) - F.greatest(F.col(f"{a}.y0"), F.col(f"{b}.y0"))
    return F.greatest(F.lit(0.0), shared) / F.least(high(a), high(b))


LINE_FIELDS = ["line_no", "text", "x0", "y0", "x1", "y1"]
ITEM_FIELDS = ["str", "x", "y", "width", "height"]


def pages(rows: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Lines or items -> one row per page with the array ``lines`` or ``items``; the one exchange of the layout operators."""
    keys = keys or KEYS
    name, fields = ("items", ITEM_FIELDS) if "str" in rows.columns else ("lines", LINE_FIELDS)
    return rows.groupBy(*keys).agg(F.collect_list(F.struct(*fields)).alias(name))


def _keys(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in ("lines", "items")]


def _exploded(df: DataFrame, array: Column, fields: list[str], at: str | None = None) -> DataFrame:
    keys = _keys(df)
    place = [F.col("_p").alias(at)] if at else []
    rows = df.select(*keys, F.posexplode(array).alias("_p", "_r"))
    return rows.select(*keys, *place, *[F.col(f"_r.{c}").alias(c) for c in fields])


def reading_order(pages: DataFrame, tolerance: float = G.BAND) -> DataFrame:
    """Lines with text, with their band and ord (from 0): top to bottom by band, then left to right, then text."""
    return _exploded(pages, G.ordered(F.col("lines"), tolerance), [*LINE_FIELDS, "band"], "ord")


def main_column_band(pages: DataFrame, page_width: float = PAGE_WIDTH) -> DataFrame:
    """Per page: medians of the wide lines; no row for a page without any."""
    b = pages.select(*_keys(pages), G.column_band(G.ordered(F.col("lines")), page_width).alias("_b"))
    return b.where("_b is not null").select(*_keys(pages), "_b.*")


def _regions(page_width: float) -> Column:
    return G.regions(G.ordered(F.col("lines")), page_width)


def assign_regions(pages: DataFrame, page_width: float = PAGE_WIDTH) -> DataFrame:
    """Lines in reading order with their region: main, sidebar_left or sidebar_right."""
    return _exploded(pages, _regions(page_width), [*LINE_FIELDS, "band", "region"], "ord")


def _blocks(page_width: float, continuation: bool) -> Column:
    return G.blocks(_regions(page_width), page_width, continuation)


def layout_blocks(pages: DataFrame, page_width: float = PAGE_WIDTH, continuation: bool = True) -> DataFrame:
    """Lines with their region and block_no per region; see ``geometry.blocks``."""
    one = lambda b: F.transform(b["lines"], lambda l: l.withField("block_no", b["block_no"]))
    rows = F.flatten(F.transform(_blocks(page_width, continuation), one))
    return _exploded(pages, rows, [*LINE_FIELDS, "region", "block_no"])


def block_bbox(pages: DataFrame, page_width: float = PAGE_WIDTH, continuation: bool = True) -> DataFrame:
    """Union of the boxes of every block, and its number of lines."""
    t = G.typed_blocks(_blocks(page_width, continuation))
    rows = _exploded(pages, t, ["region", "block_no", "x0", "y0", "x1", "y1", "lines"])
    return rows.withColumn("n_lines", F.size("lines").cast("long")).drop("lines")


def block_reading_order(pages: DataFrame, page_width: float = PAGE_WIDTH, continuation: bool = True) -> DataFrame:
    """Typed blocks with box, band and ord: by bands of the block tops, main column before sidebars, then x."""
    t = G.blocks_in_order(G.typed_blocks(_blocks(page_width, continuation)))
    return _exploded(pages, t, ["region", "block_no", "type", "band", "x0", "y0", "x1", "y1", "lines"], "ord")


def items_to_lines(pages: DataFrame) -> DataFrame:
    """Pages of items -> lines from the top: texts joined, spaced by their gaps."""
    return _exploded(pages, G.item_lines(F.col("items")), ["line_no", "text", "x0", "x1", "y", "height", "y0", "y1"])


def merge_math_lines(pages: DataFrame) -> DataFrame:
    """Pages of items -> lines, with stacked fragments of one formula as one line; see ``geometry.merged_lines``."""
    return _exploded(pages, G.merged_lines(G.item_lines(F.col("items"))), ["text", "kind", "n_lines", "x0", "y0", "x1", "y1", "y"], "group_no")


def blank_line_gaps(pages: DataFrame) -> DataFrame:
    """Lines from the top with an empty row wherever the vertical gap is more than a blank line."""
    boxed = F.transform("lines", lambda l: F.struct(l["text"].alias("text"), *G.box(l)))
    down = G.sorted_by(boxed, lambda l: -l["y1"], lambda l: l["x0"])
    wide = lambda p, l: p["y1"] - l["y1"] > F.greatest(p["height"] * 2.1, F.lit(28.0))
    row = lambda text, kind: F.struct(text.alias("text"), F.lit(kind).alias("kind"))
    groups = F.transform(G.islands(down, wide), lambda g: F.transform(g, lambda l: row(l["text"], "text")))
    rows = F.flatten(F.transform(groups, lambda g, k: F.when(k > 0, F.concat(F.array(row(F.lit(""), "empty")), g)).otherwise(g)))
    return _exploded(pages, rows, ["text", "kind"], "ord")


def segmentation_report(pages: DataFrame, page_width: float = PAGE_WIDTH, continuation: bool = True) -> DataFrame:
    """Per page and region: line ids in reading order, box and number of blocks."""

    def region(bs: Column, name: Column) -> Column:
        own = F.flatten(F.transform(bs, lambda b: b["lines"]))
        id = lambda l: F.format_string("p%d-l%03d", F.col("page_no"), l["line_no"] + 1)
        low, high = lambda c: F.array_min(F.transform(own, lambda l: l[c])), lambda c: F.array_max(F.transform(own, lambda l: l[c]))
        return F.struct(
            name.alias("region"), F.array_join(F.transform(own, id), ",").alias("line_ids"), low("x0").alias("x0"), low("y0").alias("y0"),
            high("x1").alias("x1"), high("y1").alias("y1"), F.size(own).cast("long").alias("n_lines"), F.size(bs).cast("long").alias("n_blocks"),
        )

    names = F.array(*map(F.lit, G.REGIONS))
    found = F.transform(names, lambda r: region(F.filter("_b", lambda b: b["region"] == r), r))
    p = pages.withColumn("_b", _blocks(page_width, continuation))
    rows = p.select(*_keys(pages), F.explode(F.filter(found, lambda x: x["n_lines"] > 0)).alias("_r"))
    return rows.select(*_keys(pages), "_r.*")
