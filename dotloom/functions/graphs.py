"""Graph payloads: reading, completing and describing them in words."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import equations as E
from . import regex as R

# --- fixed values: aliases, labels and sentence wordings ------------------------
TYPE_ALIASES = {
    "line_graph": "line", "straight_line": "line", "linear": "line", "linear_graph": "line",
    "parabola_graph": "parabola", "quadratic": "parabola", "quadratic_graph": "parabola",
    "absolute_value_graph": "absolute_value", "abs_graph": "absolute_value", "v_shape": "absolute_value",
    "vertical": "vertical_line", "horizontal": "horizontal_line", "circle_graph": "circle",
    "polynomial_graph": "polynomial", "piecewise_graph": "piecewise", "segmented_graph": "piecewise",
    "unclear": "unknown", "coordinate_plane_graph": "unknown", "function_graph": "unknown",
}
CONFIDENCE_WORDS = {"high": 0.92, "medium": 0.68, "low": 0.38}
REFERENCE_LABEL = "x-constant reference"
VISUAL_PHRASES = (
    r"(?i)(?<!\w)(?:as seen|you can see|shown|visible|looks like|appears to show|blue line|red line|green line|black line)(?!\w)"
)
SUMMARY = {
    "line": ("straight line rising from left to right", "straight line falling from left to right"),
    "horizontal_line": ("horizontal line with constant y",) * 2,
    "vertical_line": ("vertical line with constant x",) * 2,
    "parabola": ("U-shaped parabola", "inverted U-shaped parabola"),
    "absolute_value": ("V-shaped absolute value graph",) * 2,
    "circle": ("circle on a coordinate plane",) * 2,
    "piecewise": ("piecewise graph made of separate segments",) * 2,
    "polynomial": ("curved polynomial graph with turning behavior",) * 2,
    "unknown": ("mathematical graph on a coordinate plane",) * 2,
}
OPENING = {
    # type: (natural up, natural down, compact up, compact down)
    "line": ("This graph shows a straight line rising from left to right.", "This graph shows a straight line falling from left to right.",
             "Straight line rising from left to right.", "Straight line falling from left to right."),
    "horizontal_line": ("This graph shows a horizontal line where y stays constant.",) * 2 + ("Horizontal line.",) * 2,
    "vertical_line": ("This graph shows a vertical line where x stays constant.",) * 2 + ("Vertical line.",) * 2,
    "parabola": ("This graph shows a U-shaped parabola opening upward.", "This graph shows a U-shaped parabola opening downward.",
                 "U-shaped parabola.", "Inverted U-shaped parabola."),
    "absolute_value": ("This graph shows a V-shaped absolute value graph opening upward.", "This graph shows a V-shaped absolute value graph opening downward.",
                       "V-shaped graph opening upward.", "V-shaped graph opening downward."),
    "circle": ("This graph shows a circle on a coordinate plane.",) * 2 + ("Circle on a coordinate plane.",) * 2,
    "piecewise": ("This graph shows a piecewise graph made of separate segments.",) * 2 + ("Piecewise graph.",) * 2,
    "polynomial": ("This graph shows a curved polynomial graph that changes direction.",) * 2 + ("Polynomial curve.",) * 2,
    "unknown": ("This graph shows a mathematical graph on a coordinate plane.",) * 2 + ("Math graph on a coordinate plane.",) * 2,
}
TYPE_LABELS = {
    "en": {"line": "Line", "parabola": "Parabola", "absolute_value": "Absolute Value", "vertical_line": "Vertical Line",
           "horizontal_line": "Horizontal Line", "circle": "Circle", "polynomial": "Polynomial", "piecewise": "Piecewise", "unknown": "Unknown"},
    "tr": {"line": "Doğru", "parabola": "Parabol", "absolute_value": "Mutlak Değer", "vertical_line": "Dikey Doğru",
           "horizontal_line": "Yatay Doğru", "circle": "Çember", "polynomial": "Polinom", "piecewise": "Parçalı", "unknown": "Belirsiz"},
}
TREND_LABELS_TR = {
    "Constant x": "Sabit x", "Constant": "Sabit", "Increasing": "Artan", "Decreasing": "Azalan",
    "Increasing then decreasing": "Önce artan sonra azalan", "Decreasing then increasing": "Önce azalan sonra artan",
    "Mixed": "Karışık", "Unclear": "Belirsiz",
}
TIPS = {
    "en": ("Check the equation and the axes first. Then verify the intercepts and the main graph features.",
           "Check the axes first. Then verify the key points and the overall graph behavior."),
    "tr": ("Önce denklemi ve eksenleri kontrol edin. Sonra kesişim noktalarını ve ana özellikleri doğrulayın.",
           "Önce eksenleri kontrol edin. Sonra ana noktaları ve grafik davranışını doğrulayın."),
}
PAYLOAD_TYPES = {
    "en": {"line graph": "line graph", "function graph": "function graph", "coordinate plane graph": "coordinate-plane graph"},
    "tr": {"line graph": "çizgi grafiği", "function graph": "fonksiyon grafiği", "coordinate plane graph": "koordinat düzlemi grafiği"},
}
#: Modes of an analysis: labels in English and Turkish; others are unknown.
MODE_LABELS = {"ai-vision": ("AI Vision", "AI Vision"), "offline-basic": ("Offline Basic", "Offline Basic")}
UNKNOWN_MODE = ("Unknown mode", "Bilinmeyen mod")
AXIS_STATUS = {"en": ("Present", "Not confirmed"), "tr": ("Var", "Doğrulanmadı")}
#: Flags of the axes: where each may stand, the first given one counting, and what it is by default.
AXIS_FLAGS = {
    "has_x_axis": (["axes.has_x_axis", "has_x_axis", "coordinate_plane_present"], True),
    "has_y_axis": (["axes.has_y_axis", "has_y_axis", "coordinate_plane_present"], True),
    "origin_visible": (["axes.origin_visible", "origin_visible"], False),
}
#: Supplied texts: where each may stand, the first with text counting, and what it is by default.
GIVEN_TEXTS = {
    "title": (["title"], ""), "caption": (["caption_text", "captionText"], ""), "tip": (["classroom_tip", "classroomTip"], ""),
    "mode": (["mode_used", "modeUsed", "analysisMode"], "offline-basic"), "mode_label": (["analysisModeLabel"], ""),
    "cells": (["explanation_braille"], ""),
}
CHART_KINDS = [
    (r"histogram|bins?|frequency\s+distribution", "histogram"), (r"scatter|scatterplot|dot\s*plot|nokta|dağılım|dagilim", "scatter"),
    (r"bar|column|sütun|sutun|çubuk|cubuk", "bar"), (r"pie|circle\s*chart|pasta|dilim", "pie"),
    (r"y\s*=|f\(x\)|x\^|parab|sin|cos|tan|log|sqrt", "function"), (r"line\s*graph|line\s*chart|trend|zaman|month|week|year|oran", "line"),
]
VISIBLE_EQUATION = r"(?i)\b(?:y|f\(x\))\s*=\s*[^\n,;]+"
VISIBLE_VALUE = r"-?\d+(?:[.,]\d+)?%?"
COORDINATES = r"\([-+]?\d*\.?\d+\s*,\s*[-+]?\d*\.?\d+\)"
# ----------------------------------------------------------------------------------

LIST_FIELDS = ["x_intercepts", "y_intercepts", "notable_points"]
POINT_FIELDS = ["vertex", "center", "maximum_point", "minimum_point"]
FEATURE_JSON = (
    "struct<" + ",".join(f"{n}:array<string>" for n in LIST_FIELDS + ["increasing_intervals", "decreasing_intervals"])
    + "," + ",".join(f"{n}:string" for n in POINT_FIELDS + ["slope", "radius", "opens", "axis_of_symmetry"]) + ">"
)
PAYLOAD_JSON = (
    "graph_type string, confidence string, equation_text string, shape_summary string, uncertainties array<string>, notes array<string>, "
    "natural_description string, braille_friendly_description string, x_intercept_text string, y_intercept_text string, "
    "axes struct<has_x_axis:boolean,has_y_axis:boolean,origin_visible:boolean,scale_notes:string>, "
    "has_x_axis boolean, has_y_axis boolean, coordinate_plane_present boolean, origin_visible boolean, scale_notes string, "
    + "".join(f"{n} string, " for names, _ in GIVEN_TEXTS.values() for n in names) + "key_features " + FEATURE_JSON
)


def strip_fences(col: Column) -> Column:
    """Model output often wraps JSON in code fences."""
    return R.strip(F.regexp_replace(R.text(col), "```(?:json)?", ""))


def read_payload(json: Column) -> Column:
    """JSON text -> typed payload; points stay raw text until :func:`parse_point`."""
    return F.from_json(strip_fences(json), PAYLOAD_JSON)


def _decimal(text: Column) -> Column:
    return R.let(R.strip(R.replace_all(F.translate(R.text(text), "−–—", "---"), [(",", ".")])), E.number)


def parse_point(raw: Column, x: float | None = None, y: float | None = None) -> Column:
    """A point written as '(1, 2)', [1, 2, label] or {"x": 1, "y": 2}."""
    pair = r"^\(?\s*([-+]?\d*\.?\d+)\s*,\s*([-+]?\d*\.?\d+)\s*\)?$"

    def coordinates(px: Column, py: Column, approx: Column, label: Column) -> Column:
        return F.struct(px.alias("x"), py.alias("y"), approx.alias("approx"), F.when(label != "", label).alias("label"))

    def from_object(o: Column) -> Column:
        px, py = F.coalesce(_decimal(o["x"]), F.lit(x).cast("double")), F.coalesce(_decimal(o["y"]), F.lit(y).cast("double"))
        return coordinates(px, py, F.lower(R.strip(R.text(o["approx"]))) == "true", E.squeeze(o["label"]))

    def from_list(a: Column) -> Column:
        at = lambda i: F.get(a, F.lit(i))
        return coordinates(_decimal(at(0)), _decimal(at(1)), F.lit(False), E.squeeze(at(2)))

    def read(t: Column) -> Column:
        # each spelling is read only where a value has it
        return (
            F.when(t.startswith("{"), R.let(F.from_json(t, "x string, y string, approx string, label string"), from_object))
            .when(t.startswith("["), R.let(F.from_json(t, "array<string>"), from_list))
            .when(t != "", coordinates(E.number(R.extract(t, pair, 1)), E.number(R.extract(t, pair, 2)), F.lit(False), F.lit("")))
        )

    def point(p: Column) -> Column:
        known = F.struct(E._zero(p["x"]).alias("x"), E._zero(p["y"]).alias("y"), p["approx"].alias("approx"), p["label"].alias("label"))
        return F.when(p["x"].isNotNull() & p["y"].isNotNull(), known.cast(E.POINT))

    return R.let(R.let(R.strip(R.text(raw)), read), point)


def _points(raw: Column, x: float | None = None, y: float | None = None) -> Column:
    made = F.filter(F.transform(F.coalesce(raw, F.array().cast("array<string>")), lambda r: parse_point(r, x, y)), lambda p: p.isNotNull())
    return E.unique_points(made)


def normalize_type(raw: Column) -> Column:
    t = F.regexp_replace(F.lower(E.squeeze(raw)), r"[\s-]+", "_")
    pairs = [F.lit(v) for kv in {**TYPE_ALIASES, **{g: g for g in E.GRAPH_TYPES}}.items() for v in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), t), F.lit("unknown"))


def normalize_confidence(raw: Column) -> Column:
    t = F.lower(E.squeeze(raw))
    out = F.coalesce(F.least(F.greatest(_decimal(t), F.lit(0.0)), F.lit(1.0)), F.lit(CONFIDENCE_WORDS["medium"]))
    for word, value in CONFIDENCE_WORDS.items():
        out = F.when(t == word, value).otherwise(out)
    return out


def unique_texts(values: Column) -> Column:
    clean = F.transform(F.coalesce(values, F.array().cast("array<string>")), E.squeeze)
    return F.array_distinct(F.filter(clean, lambda v: v != ""))


def normalize_features(p: Column) -> Column:
    """Key features of a payload as a typed feature struct."""
    k = p["key_features"]
    none = F.array().cast(f"array<{E.POINT}>")
    on_axis = lambda axis: lambda n: F.when(n.isNotNull(), F.array(E.point(n, F.lit(0.0)) if axis == "x" else E.point(F.lit(0.0), n)))
    legacy = lambda raw, axis: F.coalesce(R.let(parse_point(raw), lambda p: F.when(p.isNotNull(), F.array(p))), R.let(_decimal(raw), on_axis(axis)), none)
    listed = lambda pts, raw, axis: R.let(pts, lambda ps: F.when(F.size(ps) > 0, ps).otherwise(legacy(raw, axis)))
    direction = F.lower(E.squeeze(k["opens"]))
    axis = E.squeeze(k["axis_of_symmetry"])
    return E.features(
        slope=_decimal(k["slope"]), radius=_decimal(k["radius"]),
        opens=F.when(direction.isin("up", "down", "left", "right"), direction),
        axis_of_symmetry=F.when(axis != "", axis),
        x_intercepts=listed(_points(k["x_intercepts"], y=0.0), p["x_intercept_text"], "x"),
        y_intercepts=listed(_points(k["y_intercepts"], x=0.0), p["y_intercept_text"], "y"),
        notable_points=_points(k["notable_points"]),
        increasing_intervals=unique_texts(k["increasing_intervals"]), decreasing_intervals=unique_texts(k["decreasing_intervals"]),
        **{n: parse_point(k[n]) for n in POINT_FIELDS},
    )


def shape_summary(kind: Column, f: Column, given: Column) -> Column:
    down = F.when(kind == "line", F.coalesce(f["slope"] < 0, F.lit(False))).otherwise(F.coalesce(f["opens"] == "down", F.lit(False)))
    out = F.lit(SUMMARY["unknown"][0])
    for name, (up, dn) in SUMMARY.items():
        out = F.when(kind == name, F.when(down, dn).otherwise(up)).otherwise(out)
    clean = E.squeeze(given)
    return F.when(clean != "", clean).otherwise(out)


def point_text(p: Column) -> Column:
    return F.when(p.isNull(), "").otherwise(
        F.concat(F.when(p["approx"], "approximately ").otherwise(""), F.lit("("), E.format_number(p["x"]), F.lit(", "), E.format_number(p["y"]), F.lit(")"))
    )


def point_list(points: Column) -> Column:
    """'a', 'a and b' or 'a, b, and c'."""
    t = F.transform(points, point_text)
    n = F.size(t)
    head = F.array_join(F.slice(t, F.lit(1), F.greatest(n - 1, F.lit(0))), ", ")
    return (
        F.when(n == 0, "").when(n == 1, F.get(t, F.lit(0))).when(n == 2, F.concat(F.get(t, F.lit(0)), F.lit(" and "), F.get(t, F.lit(1))))
        .otherwise(F.concat(head, F.lit(", and "), F.element_at(t, -1)))
    )


def _constant_x(f: Column) -> Column:
    ref = F.get(F.filter(f["notable_points"], lambda p: p["label"] == REFERENCE_LABEL), F.lit(0))
    return F.coalesce(ref["x"], F.get(f["x_intercepts"], F.lit(0))["x"])


def _constant_y(f: Column) -> Column:
    return F.get(f["y_intercepts"], F.lit(0))["y"]


def example_points(kind: Column, f: Column) -> Column:
    """At most three distinct points: known ones first, then computed and mirrored ones."""
    none = F.array().cast(f"array<{E.POINT}>")
    own = F.filter(f["notable_points"], lambda p: ~F.coalesce(p["label"] == REFERENCE_LABEL, F.lit(False)))
    singles = F.array(f["vertex"], f["minimum_point"], f["maximum_point"], f["center"])
    known = F.concat(f["x_intercepts"], f["y_intercepts"], F.array_compact(singles), own)
    b, m, y, x = _constant_y(f), f["slope"], _constant_y(f), _constant_x(f)
    num = F.lit
    on_line = F.array(*[E.point(num(float(v)), m * v + b) for v in (2, 1, -1, -2)])
    level = F.array(*[E.point(num(float(v)), y) for v in (-2, 0, 2)])
    upright = F.array(*[E.point(x, num(float(v))) for v in (-2, 0, 2)])
    axis = E.number(R.extract(E.squeeze(f["axis_of_symmetry"]), r"(?i)^x\s*=\s*([-+]?\d*\.?\d+)$", 1))
    mirrored = F.transform(F.concat(f["y_intercepts"], own), lambda p: F.struct(E._zero(2 * axis - p["x"]).alias("x"), p["y"].alias("y"), p["approx"].alias("approx"), F.lit(None).cast("string").alias("label")).cast(E.POINT))
    c, r = f["center"], f["radius"]
    rim = F.array(E.point(c["x"] - r, c["y"]), E.point(c["x"], c["y"] + r), E.point(c["x"] + r, c["y"]))
    computed = (
        F.when((kind == "line") & m.isNotNull() & b.isNotNull(), on_line)
        .when((kind == "horizontal_line") & y.isNotNull(), level).when((kind == "vertical_line") & x.isNotNull(), upright)
        .when(kind.isin("parabola", "absolute_value") & axis.isNotNull(), mirrored)
        .when((kind == "circle") & c.isNotNull() & r.isNotNull(), rim).otherwise(none)
    )
    key = lambda p: F.concat_ws(":", E.format_number(p["x"]), E.format_number(p["y"]))
    add = lambda acc, p: F.when((F.size(acc) >= 3) | F.exists(acc, lambda a: key(a) == key(p)), acc).otherwise(F.array_append(acc, p))
    return F.aggregate(F.concat(known, computed.cast(f"array<{E.POINT}>")), none, add)


def _say(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def movement(kind: Column, f: Column, summary: Column, compact: bool) -> Column:
    """Sentences on how the graph moves as x grows."""
    c = lambda natural, short: short if compact else natural
    lead = c("As x increases, ", "As x increases ")
    m, v, down = f["slope"], f["vertex"], F.coalesce(f["opens"] == "down", F.lit(False))
    size = E.format_number(F.abs(m))
    both = lambda word: F.array(
        F.lit(c(f"As x increases, y {word} at a constant rate.", f"As x increases y {word}.")),
        _say(c(f"For every increase of 1 in x, y {word} by ", f"When x increases by 1 y {word} by "), size, "."),
    )
    still = F.lit(lead + "y stays the same.")
    x0 = _constant_x(f)
    upright = F.when(x0.isNull(), c("As y changes, x stays fixed, so the graph goes straight up and down.", "As y changes x stays fixed.")).otherwise(
        _say(c("As y changes, x stays fixed at ", "As y changes x stays "), E.format_number(x0), c(", so the graph goes straight up and down.", "."))
    )
    at = point_text(v)

    def turning(place: tuple[str, str], tail: tuple[str, str], note: tuple[str, str], bare: tuple[str, str]) -> Column:
        def say(i: int) -> Column:
            go = ("falls", "rises")[i]
            return F.array(
                _say(lead, c(f"the graph {go} to {place[i]} ", f"it {go} to {place[i + 2] if len(place) > 2 else place[i]}"), at, c(f" and then {tail[i]}.", ".")),
                F.lit(c(note[i], f"After that it {('rises', 'falls')[i]}.")),
            )

        plain = F.array(F.when(down, lead + bare[1]).otherwise(lead + bare[0]))
        return F.when(v.isNull(), plain).when(down, say(1)).otherwise(say(0))

    bowl = turning(
        ("its lowest point at", "its highest point at", "", ""), ("rises again", "falls again"),
        ("This lowest point is where the graph changes direction.", "This highest point is where the graph changes direction."),
        ("the graph falls and then rises.", "the graph rises and then falls."),
    )
    corner = turning(
        ("the corner at", "the corner at", "the corner at ", "the corner at "), ("rises away from it", "falls away from it"),
        ("That corner is the point where the graph changes direction.",) * 2,
        ("the graph falls to a corner and then rises.", "the graph rises to a corner and then falls."),
    )
    inc, dec = f["increasing_intervals"], f["decreasing_intervals"]
    has_text = E.squeeze(summary) != ""
    body = F.regexp_replace(clean_sentence(summary), r"\.\z", "")
    ranges = lambda up, dn: F.array(
        F.when(F.size(inc) > 0, _say(up, F.array_join(inc, ", "), ".")), F.when(F.size(dec) > 0, _say(dn, F.array_join(dec, ", "), "."))
    )
    poly = F.concat(
        F.array(
            F.when((F.size(inc) > 0) | (F.size(dec) > 0), lead + c("the graph changes direction in different parts of the plane.", "the graph changes direction."))
            .when(has_text, _say(lead + c("the graph follows this overall pattern: ", "the graph follows this pattern: "), body, "."))
            .otherwise(lead + "the graph changes direction more than once.")
        ),
        ranges("It increases on ", "It decreases on "),
    )
    pieces = F.concat(F.array(F.lit(lead + "the graph changes from one segment to another.")), ranges("Some segments rise on ", "Some segments fall on "))
    other = F.array(
        F.when(has_text, _say(lead + c("the graph follows this overall shape: ", "the graph follows this shape: "), body, "."))
        .otherwise(lead + c("the graph changes across the coordinate plane.", "the graph changes across the plane."))
    )
    out = (
        F.when((kind == "line") & (m > 0), both("increases")).when((kind == "line") & (m < 0), both("decreases"))
        .when(kind == "line", F.array(still))
        .when(kind == "horizontal_line", F.array(still, F.lit(c("The graph stays at the same height all the way across.", "The graph stays at one height."))))
        .when(kind == "vertical_line", F.array(upright)).when(kind == "parabola", bowl).when(kind == "absolute_value", corner)
        .when(kind == "circle", F.array(F.lit(c("It curves around a center point instead of moving only up or only down as x increases.", "It curves around a center point."))))
        .when(kind == "polynomial", poly).when(kind == "piecewise", pieces).otherwise(other)
    )
    return F.array_compact(out)


def crossings(kind: Column, f: Column, compact: bool) -> Column:
    """Sentences on where the graph meets the axes."""
    c = lambda natural, short: short if compact else natural

    def axis(a: str, o: str, lies: Column) -> Column:
        pts = f[f"{a}_intercepts"]
        p = F.get(pts, F.lit(0))
        own = E.format_number(p[a])
        zero = "zero" if not compact else "0"
        word = "is" if a == "y" else "becomes"
        if compact:
            pair = lambda first, second: F.array(first, second)
            return (
                F.when(lies, pair(F.lit(f"The graph lies on the {a}-axis."), F.lit(f"Every point has {o} equal to 0.")))
                .when(F.size(pts) == 1, pair(_say(f"Crosses the {a}-axis at ", point_text(p), "."), _say(f"When {o} is 0 {a} is ", own, ".")))
                .when(F.size(pts) > 1, pair(_say(f"Crosses the {a}-axis at ", point_list(pts), "."), F.lit(f"Those are the points where {o} is 0.")))
                .otherwise(pair(F.lit(f"Does not cross the {a}-axis."), F.lit(f"{o.upper()} is never 0 on this graph.")))
            )
        return (
            F.when(lies, F.array(F.lit(f"The graph lies on the {a}-axis, so every point on it has {o} equal to 0.")))
            .when(F.size(pts) == 1, F.array(_say(f"It crosses the {a}-axis at ", point_text(p), f", meaning when {o} is {zero}, {a} is ", own, ".")))
            .when(F.size(pts) > 1, F.array(_say(f"It crosses the {a}-axis at ", point_list(pts), f", meaning those are the points where {o} {word} {zero}.")))
            .otherwise(F.array(F.lit(f"It does not cross the {a}-axis, so there is no point on the graph where {o} {word} {zero}.")))
        )

    on_y = F.coalesce((kind == "vertical_line") & (F.abs(_constant_x(f)) < E.TINY), F.lit(False))
    on_x = F.coalesce((kind == "horizontal_line") & (F.abs(_constant_y(f)) < E.TINY), F.lit(False))
    return F.concat(axis("y", "x", on_y), axis("x", "y", on_x))


def clean_sentence(text: Column) -> Column:
    """One sentence without purely visual phrases, closed by a full stop."""
    t = R.sub(E.squeeze(text), VISUAL_PHRASES, "")
    t = R.strip(F.regexp_replace(F.regexp_replace(t, r"\s+,", ","), r"\s+\.", "."))
    return R.let(t, lambda c: F.when((c == "") | c.endswith("."), c).otherwise(F.concat(c, F.lit("."))))


def _opening(kind: Column, f: Column, compact: bool) -> Column:
    down = F.when(kind == "line", F.coalesce(f["slope"] < 0, F.lit(False))).otherwise(F.coalesce(f["opens"] == "down", F.lit(False)))
    i = 2 if compact else 0
    out = F.lit(OPENING["unknown"][i])
    for name, texts in OPENING.items():
        out = F.when(kind == name, F.when(down, texts[i + 1]).otherwise(texts[i])).otherwise(out)
    return out


def _examples(points: Column, compact: bool) -> Column:
    n = F.size(points)
    many, one = ("Example points ", "One example point is ") if compact else ("Example points include ", "One clear example point is ")
    nothing = "Clear example points are not confirmed." if compact else "Clear example points are not confirmed from the available graph details."
    return F.when(n >= 2, _say(many, point_list(points), ".")).when(n == 1, _say(one, point_list(points), ".")).otherwise(nothing)


def _equation(eq: Column, compact: bool) -> Column:
    missing = "Exact equation not confirmed." if compact else "An exact equation is not confirmed from the available graph details."
    return F.when(R.text(eq) == "", missing).otherwise(_say("Equation: " if compact else "The equation of the graph is ", eq, "."))


def describe(kind: Column, eq: Column, summary: Column, f: Column, compact: bool = False) -> Column:
    """Shape, movement, axis crossings, example points and equation, in words."""
    tidy = lambda a: F.filter(F.transform(a, clean_sentence), lambda s: s != "")
    points = example_points(kind, f)
    if compact:
        lines = F.concat(
            F.array(_opening(kind, f, True)), movement(kind, f, F.lit(""), True), crossings(kind, f, True),
            F.array(R.let(points, lambda p: _examples(p, True)), _equation(eq, True)),
        )
        return F.array_join(tidy(lines), "\n")
    paragraphs = [
        F.concat(F.array(_opening(kind, f, False)), movement(kind, f, summary, False)), crossings(kind, f, False),
        F.array(R.let(points, lambda p: _examples(p, False))), F.array(_equation(eq, False)),
    ]
    return F.array_join(F.filter(F.array(*[F.array_join(tidy(p), " ") for p in paragraphs]), lambda p: p != ""), "\n\n")


def is_well_formed(text: Column, compact: bool = False) -> Column:
    """Does a given description already follow the order of :func:`describe`?"""
    if compact:
        t = R.strip(F.regexp_replace(R.text(text), "\r\n?", "\n"))
        parts = F.filter(F.transform(F.split(t, "\n"), E.squeeze), lambda l: l != "")
        shape = r"(?i)(line|parabola|circle|piecewise|polynomial|absolute value|horizontal|vertical|v-shaped|u-shaped|math graph)"
        inner = [r"(?i)(as x increases|as y changes|when x increases|rises|falls|stays|curves)", r"(?i)(x-axis|y-axis|does not cross|lies on)", r"(?i)^(?:Example points|One example point)"]
        last = r"(?i)^(?:Equation:|Exact equation)"
        has = lambda ps: F.exists(ps, lambda l: R.matches(l, inner[0])) & F.exists(ps, lambda l: R.matches(l, inner[1])) & F.exists(ps, lambda l: R.matches(l, inner[2]))
    else:
        t = E.squeeze(text)
        parts = F.regexp_extract_all(t, F.lit(r"[^.!?]+[.!?]?"), 0)
        shape = r"(?i)(this graph|line|parabola|circle|piecewise|polynomial|absolute value|horizontal line|vertical line)"
        inner = [
            r"(?i)(as x increases|as y changes|rises|falls|goes straight up and down|curves around|stays the same|stays constant)",
            r"(?i)(cross(?:es)? the x-axis|cross(?:es)? the y-axis|does not cross the x-axis|does not cross the y-axis|lies on the x-axis|lies on the y-axis)",
        ]
        last = r"(?i)(equation|exact equation).*(=|confirmed)"
        has = lambda ps: R.matches(t, inner[0]) & R.matches(t, inner[1])
    return R.let(
        parts,
        lambda ps: (F.size(ps) >= 5) & ~R.matches(R.text(F.get(ps, F.lit(0))), r"(?i)\b(?:equation|y|x|f\(x\))\s*[:=]")
        & R.matches(R.text(F.get(ps, F.lit(0))), shape) & has(ps) & (F.regexp_count(t, F.lit(COORDINATES)) >= 2)
        & R.matches(R.text(F.get(ps, F.size(ps) - 1)), last),
    )


def relations(kind: Column, f: Column) -> Column:
    """Short relation phrases for a mathematics reader."""
    each = lambda name, text, show: F.transform(f[name], lambda p: _say(text, show(p)))
    same = lambda t: t
    head = F.array_compact(
        F.array(
            F.when((kind == "line") & f["slope"].isNotNull(), F.when(f["slope"] > 0, "rises from left to right").otherwise("falls from left to right")),
            F.when(kind == "vertical_line", "x stays constant"), F.when(kind == "horizontal_line", "y stays constant"),
            _say("opens ", f["opens"]), _say("symmetric about ", f["axis_of_symmetry"]),
        )
    )
    return F.array_distinct(
        F.concat(
            head, each("x_intercepts", "crosses x-axis at ", point_text), each("y_intercepts", "crosses y-axis at ", point_text),
            each("increasing_intervals", "increasing on ", same), each("decreasing_intervals", "decreasing on ", same),
        )
    )


def chart_kind(text: Column) -> Column:
    low = F.lower(R.text(text))
    out = F.lit("generic")
    for pattern, kind in reversed(CHART_KINDS):
        out = F.when(low.rlike(pattern), kind).otherwise(out)
    return out


def extract_equation(text: Column) -> Column:
    return E.squeeze(R.extract(F.translate(R.text(text), "−–—", "---"), VISIBLE_EQUATION, 0))


def extract_values(text: Column) -> Column:
    return F.array_distinct(F.slice(R.extract_all(R.text(text), VISIBLE_VALUE), 1, 8))


def trend_label(kind: Column, f: Column, locale: str = "en") -> Column:
    inc, dec = F.size(f["increasing_intervals"]) > 0, F.size(f["decreasing_intervals"]) > 0
    english = (
        F.when(kind == "vertical_line", "Constant x").when(kind == "horizontal_line", "Constant")
        .when(kind == "line", F.when(f["slope"] < 0, "Decreasing").otherwise("Increasing"))
        .when(kind.isin("parabola", "absolute_value"), F.when(f["opens"] == "down", "Increasing then decreasing").otherwise("Decreasing then increasing"))
        .when(inc & dec, "Mixed").when(inc, "Increasing").when(dec, "Decreasing").otherwise("Unclear")
    )
    if locale != "tr":
        return english
    return F.try_element_at(F.create_map(*[F.lit(v) for kv in TREND_LABELS_TR.items() for v in kv]), english)


def _at(payload: Column, path: str) -> Column:
    for name in path.split("."):
        payload = payload[name]
    return payload


def normalize_axes(payload: Column) -> Column:
    """struct(has_x_axis, has_y_axis, origin_visible, scale_notes) of a payload, all filled."""
    flags = [F.coalesce(*[_at(payload, p) for p in paths], F.lit(default)).alias(n) for n, (paths, default) in AXIS_FLAGS.items()]
    notes = E.squeeze(R.text(F.coalesce(payload["axes"]["scale_notes"], payload["scale_notes"])))
    return F.struct(*flags, notes.alias("scale_notes"))


def given_texts(payload: Column) -> Column:
    """Texts that came with a payload, trimmed: struct(title, caption, tip, mode, mode_label, cells)."""

    def first(paths: list[str], default: str) -> Column:
        own = [R.strip(R.text(_at(payload, p))) for p in paths]
        return F.coalesce(*[F.when(t != "", t) for t in own], F.lit(default))

    return F.struct(*[first(paths, default).alias(n) for n, (paths, default) in GIVEN_TEXTS.items()])


def _label(key: Column, labels: dict[str, str], default: str) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for kv in labels.items() for v in kv]), key), F.lit(default))


def mode_label(given: Column, locale: str = "en") -> Column:
    i = int(locale == "tr")
    known = _label(F.lower(given["mode"]), {k: v[i] for k, v in MODE_LABELS.items()}, UNKNOWN_MODE[i])
    return F.when(given["mode_label"] != "", given["mode_label"]).otherwise(known)


def display_record(p: Column, locale: str = "en") -> Column:
    """Labelled record of a normalised payload ``p`` for display; what was supplied goes before what is made up."""
    lang = "tr" if locale == "tr" else "en"
    f, eq, axes, given = p["features"], p["equation"], p["axes"], p["given"]
    label = _label(p["graph_type"], TYPE_LABELS[lang], TYPE_LABELS[lang]["unknown"])
    present, absent = AXIS_STATUS[lang]
    axis = lambda c: F.when(c, present).otherwise(absent)
    joined = lambda n: F.array_join(F.transform(f[n], point_text), ", ")
    supplied = lambda n, own: F.when(given[n] != "", given[n]).otherwise(own)
    title = F.concat(label, F.lit(" açıklaması" if lang == "tr" else " description"))
    tip = F.when(R.text(eq) != "", TIPS[lang][0]).otherwise(TIPS[lang][1])
    notes = F.filter(F.concat(F.array(axes["scale_notes"]), p["notes"]), lambda n: n != "")
    return F.struct(
        supplied("title", title).alias("title"), label.alias("graph_type"), (axes["has_x_axis"] | axes["has_y_axis"]).alias("coordinate_plane"),
        axis(axes["has_x_axis"]).alias("axis_x"), axis(axes["has_y_axis"]).alias("axis_y"),
        trend_label(p["graph_type"], f, locale).alias("trend"), joined("x_intercepts").alias("x_intercepts"), joined("y_intercepts").alias("y_intercepts"),
        R.strip(R.text(eq)).alias("equation"), given["caption"].alias("caption"), p["natural_description"].alias("explanation"),
        p["compact_description"].alias("compact"), notes.alias("notes"), F.format_string("%.2f", F.coalesce(p["confidence"], F.lit(0.68))).alias("confidence"),
        p["confidence"].alias("confidence_score"), given["mode"].alias("mode"), mode_label(given, locale).alias("mode_label"), p["summary"].alias("summary"),
        supplied("tip", tip).alias("tip"),
    )


LINEAR = r"(?i)^(?:y|f\(x\))=([+\-]?)(\d*(?:\.\d+)?)x(?:(\+|-)(\d+(?:\.\d+)?))?$"
CONSTANT = r"(?i)^(?:y|f\(x\))=([+\-]?\d+(?:\.\d+)?)$"


def _two_decimals(v: Column) -> Column:
    near = F.floor(v + 0.5)
    return F.when(F.abs(v - near) < E.TINY, near.cast("long").cast("string")).otherwise(
        F.regexp_replace(F.format_string("%.2f", F.bround(v, 2)), r"\.?0+\z", "")
    )


def linear_reading(eq: Column) -> Column:
    """struct(slope, intercept, x_intercept, y_intercept) of a linear equation, else null."""

    def read(t: Column) -> Column:
        flat = R.matches(t, CONSTANT)
        k = E.number(R.extract(t, CONSTANT, 1))
        m0 = F.when(R.extract(t, LINEAR, 2) == "", 1.0).otherwise(E.number(R.extract(t, LINEAR, 2)))
        m = F.when(flat, 0.0).otherwise(F.when(R.extract(t, LINEAR, 1) == "-", -m0).otherwise(m0)) + F.lit(0.0)
        b0 = F.coalesce(E.number(R.extract(t, LINEAR, 4)), F.lit(0.0))
        b = F.when(flat, k).otherwise(F.when(R.extract(t, LINEAR, 3) == "-", -b0).otherwise(b0))
        zero = F.abs(m) < E.TINY
        cross = F.when(flat & (F.abs(b) < E.TINY), "all real x-values").when(zero, "").otherwise(_two_decimals(-b / F.when(zero, None).otherwise(m) + F.lit(0.0)))
        return F.when(
            flat | R.matches(t, LINEAR),
            F.struct(m.alias("slope"), b.alias("intercept"), cross.alias("x_intercept"), _two_decimals(b).alias("y_intercept")),
        )

    return R.let(F.regexp_replace(F.translate(R.text(eq), "−–—", "---"), r"\s+", ""), read)


def trend_of(slope: Column) -> Column:
    return F.when(slope > 0, "increasing").when(slope < 0, "decreasing").when(slope == 0, "horizontal").otherwise("")


def enhance_payload(p: Column) -> Column:
    """Fill type, trend, intercepts and axis flags from a linear equation."""

    def fill(v: Column) -> Column:
        p, e = v["p"], v["e"]
        t = lambda n: E.squeeze(p[n])
        known = e.isNotNull()
        seen = F.coalesce(p["coordinate_plane_present"], F.lit(False)) | (t("axis_x") != "") | (t("axis_y") != "")
        keep = lambda n, new: F.when(t(n) != "", t(n)).otherwise(F.coalesce(new, F.lit("")))
        cross = F.when(e["x_intercept"] != "all real x-values", e["x_intercept"])
        axis = lambda n, name: F.when(known & (t(n) == "") & seen, name).otherwise(t(n))
        return F.struct(
            F.when(known, "line_graph").when((F.lower(t("graph_type")) == "unclear") & seen, "coordinate_plane_graph").otherwise(t("graph_type")).alias("graph_type"),
            F.when(known, keep("trend_direction", trend_of(e["slope"]))).otherwise(t("trend_direction")).alias("trend_direction"),
            F.when(known, keep("x_intercept_text", cross)).otherwise(t("x_intercept_text")).alias("x_intercept_text"),
            F.when(known, keep("y_intercept_text", e["y_intercept"])).otherwise(t("y_intercept_text")).alias("y_intercept_text"),
            axis("axis_x", "x").alias("axis_x"), axis("axis_y", "y").alias("axis_y"), seen.alias("axes_visible"),
            (F.lower(t("axis_x")).startswith("x") & F.lower(t("axis_y")).startswith("y")).alias("axes_labeled"),
            keep("confidence", F.when(known, "medium").otherwise("low")).alias("confidence"),
            t("equation_text").alias("equation_text"), t("caption_text").alias("caption_text"), t("note").alias("note"),
        )

    return R.let(F.struct(p.alias("p"), linear_reading(p["equation_text"]).alias("e")), fill)


def explanation(p: Column, locale: str = "en") -> Column:
    """Sentences about an enhanced payload, in English or Turkish."""
    tr = locale.lower().startswith("tr")
    w = lambda en, turkish: turkish if tr else en
    low = F.regexp_replace(F.lower(R.strip(p["graph_type"])), "_", " ")
    names = PAYLOAD_TYPES["tr" if tr else "en"]
    label = F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for kv in names.items() for v in kv]), low), F.when(low != "", low), F.lit(w("graph", "grafik")))
    ax, ay, plane = p["axis_x"], p["axis_y"], p["axes_visible"]
    is_line = label == names["line graph"]
    on_plane = plane | (ax != "") | (ay != "") | is_line
    opening = (
        F.when(is_line & on_plane, w("This graph shows a straight line on an x-y coordinate plane.", "Bu grafik x-y koordinat düzleminde çizilmiş bir doğru gösteriyor."))
        .when(on_plane & (label == names["coordinate plane graph"]), w("This graph is shown on an x-y coordinate plane.", "Bu grafik x-y koordinat düzleminde gösteriliyor."))
        .otherwise(_say(w("This graph is interpreted as a ", "Bu grafik "), label, w(".", " olarak yorumlandı.")))
    )
    t = F.lower(E.squeeze(p["trend_direction"]))
    trend = (
        F.when(t.isin("increasing", *(["artan"] if tr else [])), w("The line rises from left to right, so the function is increasing.", "Doğru soldan sağa yükseliyor, yani fonksiyon artan."))
        .when(t.isin("decreasing", *(["azalan"] if tr else [])), w("The line falls from left to right, so the function is decreasing.", "Doğru soldan sağa inerken görülüyor, yani fonksiyon azalan."))
        .when(t.isin("horizontal", *(["yatay"] if tr else [])), w("The line is horizontal, so the function stays constant.", "Doğru yatay görünüyor, yani fonksiyon sabit."))
        .when(~is_line, w("The overall direction of the graph is unclear.", "Grafiğin genel eğilimi net seçilemiyor."))
    )
    axes = (
        F.when(F.lower(ax).startswith("x") & F.lower(ay).startswith("y"), w("The graph includes labeled x and y axes.", "Grafikte etiketlenmiş x ve y eksenleri görülüyor."))
        .when(plane, w("The graph is shown on a coordinate plane.", "Grafik bir koordinat düzlemi üzerinde gösteriliyor."))
        .when((ax != "") & (ay != ""), _say(w("The graph shows ", "Grafikte x ekseni için "), ax, w(" on the x-axis and ", " ve y ekseni için "), ay, w(" on the y-axis.", " bilgisi görülüyor.")))
        .when(ax != "", _say(w("The x-axis appears to be labeled as ", "Grafikte x ekseni için "), ax, w(".", " bilgisi okunuyor.")))
        .when(ay != "", _say(w("The y-axis appears to be labeled as ", "Grafikte y ekseni için "), ay, w(".", " bilgisi okunuyor.")))
    )
    told = lambda n, a, b: F.when(p[n] != "", _say(a, p[n], b))
    sentences = F.array(
        opening, told("equation_text", w("The visible equation is ", "Görselde seçilebilen denklem "), "."), trend,
        told("y_intercept_text", w("It crosses the y-axis at ", "Doğru y eksenini "), w(".", " noktasında kesiyor gibi görünüyor.")),
        told("x_intercept_text", w("It crosses the x-axis at ", "Doğru x eksenini "), w(".", " noktasında kesiyor gibi görünüyor.")),
        axes, told("caption_text", w("A nearby caption reads ", "Görünen kısa açıklama veya caption metni "), "."),
        F.when(p["note"] != "", _say(w("Confidence is ", "Bu yorum "), p["confidence"], w(". ", " güven düzeyindedir. "), p["note"])),
    )
    return F.array_join(F.array_compact(sentences), " ")
