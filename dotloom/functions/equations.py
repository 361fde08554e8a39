"""Features of equations and graph descriptions, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import regex as R

POINT = "struct<x:double,y:double,approx:boolean,label:string>"
FEATURES = (
    "struct<type:string,slope:double,vertex:{p},center:{p},radius:double,opens:string,axis_of_symmetry:string,"
    "x_intercepts:array<{p}>,y_intercepts:array<{p}>,notable_points:array<{p}>,"
    "increasing_intervals:array<string>,decreasing_intervals:array<string>,maximum_point:{p},minimum_point:{p},x:double,y:double>"
).format(p=POINT)
FIELDS = [
    "type", "slope", "vertex", "center", "radius", "opens", "axis_of_symmetry", "x_intercepts", "y_intercepts",
    "notable_points", "increasing_intervals", "decreasing_intervals", "maximum_point", "minimum_point", "x", "y",
]
LISTS = {"x_intercepts", "y_intercepts", "notable_points"}
INTERVALS = {"increasing_intervals", "decreasing_intervals"}
TINY = 1e-9

# --- fixed values: equation shapes ---------------------------------------------
NUM = r"\d*\.?\d+"
VERTICAL = rf"(?i)^x=([-+]?{NUM})$"
CONSTANT = rf"(?i)^(?:y|f\(x\))=([-+]?{NUM})$"
LINE = rf"(?i)^(?:y|f\(x\))=([+-]?)(\d*\.?\d*)x(?:(\+|-)({NUM}))?$"
VERTEX_FORM = rf"(?i)^(?:y|f\(x\))=([+-]?\d*\.?\d*)?\(x([+-]{NUM})\)\^2([+-]{NUM})?$"
QUADRATIC = r"^(?:y|f\(x\))="
ABSOLUTE = rf"(?i)^(?:y|f\(x\))=([+-]?\d*\.?\d*)?\|x([+-]{NUM})?\|([+-]{NUM})?$"
CIRCLE = rf"(?i)^\(x([+-]{NUM})?\)\^2\+\(y([+-]{NUM})?\)\^2=([-+]?{NUM})$"
ORIGIN_CIRCLE = rf"(?i)^x\^2\+y\^2=([-+]?{NUM})$"
NUMBER = rf"^[-+]?(?:\d+\.?|{NUM})$"
GRAPH_TYPES = [
    "line", "horizontal_line", "vertical_line", "parabola", "absolute_value", "circle", "polynomial", "piecewise", "unknown",
]
SUMMARY_TYPES = [
    (r"vertical", "vertical_line"), (r"horizontal", "horizontal_line"), (r"straight", "line"),
    (r"u-shaped|inverted u", "parabola"), (r"v-shaped", "absolute_value"), (r"circle", "circle"),
    (r"piecewise|segment", "piecewise"), (r"polynomial|turning point", "polynomial"),
]
# ---------------------------------------------------------------------------------


def squeeze(col: Column) -> Column:
    return R.strip(F.regexp_replace(R.text(col), r"\s+", " "))


def _compact(col: Column) -> Column:
    t = F.regexp_replace(R.text(col), r"\s+", "")
    return R.replace_all(F.translate(t, "−–—", "---"), [("²", "^2")])


def number(text: Column) -> Column:
    """Plain decimal number, null for anything else."""
    return F.when(R.matches(text, NUMBER), text.try_cast("double"))


def _zero(v: Column) -> Column:
    return F.when(F.abs(v) < TINY, 0.0).otherwise(v)


def point(x: Column, y: Column, approx: bool = False, label: str | None = None) -> Column:
    return F.struct(
        _zero(x.cast("double")).alias("x"), _zero(y.cast("double")).alias("y"),
        F.lit(approx).alias("approx"), F.lit(label).cast("string").alias("label"),
    )


def features(**known: Column) -> Column:
    """Feature struct with the given fields; the others are null or empty."""
    fields = []
    for name in FIELDS:
        empty = F.array() if name in LISTS | INTERVALS else F.lit(None)
        fields.append(known.get(name, empty).alias(name))
    return F.struct(*fields).cast(FEATURES)


def format_number(v: Column) -> Column:
    """At most three decimals, no trailing zeros."""
    near = F.floor(v + 0.5)
    fixed = F.regexp_replace(F.format_string("%.3f", v), r"\.?0+\z", "")
    return F.when(v.isNull(), "").when(F.abs(v - near) < TINY, near.cast("long").cast("string")).otherwise(fixed)


def line_features(eq: Column) -> Column:
    def read(t: Column) -> Column:
        g = lambda p, i: R.extract(t, p, i)
        size = F.when(g(LINE, 2) == "", 1.0).otherwise(g(LINE, 2).try_cast("double"))
        slope = F.when(g(LINE, 1) == "-", -size).otherwise(size) + F.lit(0.0)
        b = F.when(g(LINE, 3) == "", 0.0).otherwise(F.concat(g(LINE, 3), g(LINE, 4)).try_cast("double"))
        flat = F.abs(slope) < TINY
        no_points = F.array().cast(f"array<{POINT}>")
        crossing = F.when(flat, no_points).otherwise(F.array(point(-b / F.when(flat, None).otherwise(slope), F.lit(0.0))))
        return (
            F.when(R.matches(t, VERTICAL), features(type=F.lit("vertical_line"), x=number(g(VERTICAL, 1))))
            .when(R.matches(t, CONSTANT), features(type=F.lit("horizontal_line"), y=number(g(CONSTANT, 1))))
            .when(
                R.matches(t, LINE) & (g(LINE, 2) != "."),
                features(
                    type=F.when(flat, "horizontal_line").otherwise("line"), slope=slope,
                    y_intercepts=F.array(point(F.lit(0.0), b)), x_intercepts=crossing,
                ),
            )
        )

    return R.let(F.regexp_replace(R.text(eq), r"\s+", ""), read)


def _leading(text: Column) -> Column:
    """Coefficient in front of a group: empty or a lone sign stands for one."""
    return F.when(text.isin("", "+"), 1.0).when(text == "-", -1.0).otherwise(number(text))


def _axis(x: Column) -> Column:
    return F.concat(F.lit("x = "), format_number(x))


def quadratic_features(eq: Column) -> Column:
    def from_vertex(t: Column) -> Column:
        a = _leading(R.extract(t, VERTEX_FORM, 1))
        h = -number(R.extract(t, VERTEX_FORM, 2)) + F.lit(0.0)
        k = F.coalesce(number(R.extract(t, VERTEX_FORM, 3)), F.lit(0.0))
        return features(
            type=F.lit("parabola"), vertex=point(h, k), opens=F.when(a >= 0, "up").otherwise("down"),
            axis_of_symmetry=_axis(h), y_intercepts=F.array(point(F.lit(0.0), a * h * h + k)),
        )

    def from_terms(t: Column) -> Column:
        terms = F.filter(F.split(F.split_part(F.replace(t, F.lit("-"), F.lit("+-")), F.lit("="), F.lit(2)), r"\+"), lambda x: x != "")
        square = lambda x: x.contains("x^2")
        last = lambda test, cut: F.element_at(
            F.concat(F.array(F.lit("0")), F.transform(F.filter(terms, test), lambda x: F.replace(x, F.lit(cut), F.lit("")) if cut else x)), -1
        )
        # only the first occurrence of the variable is cut from a term
        coef = F.struct(
            _leading(last(square, "x^2")).alias("a"), _leading(last(lambda x: x.contains("x") & ~square(x), "x")).alias("b"),
            number(last(lambda x: ~x.contains("x"), "")).alias("c"),
        )

        def solve(v: Column) -> Column:
            a, b, c = v["a"], v["b"], v["c"]
            x = -b / (2 * a)
            disc = b * b - 4 * a * c
            root = F.sqrt(F.greatest(disc, F.lit(0.0)))
            no_points = F.array().cast(f"array<{POINT}>")
            roots = (
                F.when(disc < 0, no_points).when(root > TINY, F.array(point((-b - root) / (2 * a), F.lit(0.0)), point((-b + root) / (2 * a), F.lit(0.0))))
                .otherwise(F.array(point((-b - root) / (2 * a), F.lit(0.0))))
            )
            return F.when(
                a.isNotNull() & b.isNotNull() & c.isNotNull() & (F.abs(a) >= TINY),
                features(
                    type=F.lit("parabola"), vertex=point(x, a * x * x + b * x + c), opens=F.when(a >= 0, "up").otherwise("down"),
                    axis_of_symmetry=_axis(x), y_intercepts=F.array(point(F.lit(0.0), c)), x_intercepts=roots,
                ),
            )

        return R.let(coef, solve)

    def read(t: Column) -> Column:
        applies = R.matches(t, QUADRATIC) & (t.contains("x^2") | t.contains(")^2")) & ~t.contains("y^2")
        return F.when(applies, F.when(R.matches(t, VERTEX_FORM), from_vertex(t)).otherwise(from_terms(t)))

    return R.let(_compact(eq), read)


def abs_features(eq: Column) -> Column:
    def read(t: Column) -> Column:
        a = _leading(R.extract(t, ABSOLUTE, 1))
        h = -F.coalesce(number(R.extract(t, ABSOLUTE, 2)), F.lit(0.0)) + F.lit(0.0)
        k = F.coalesce(number(R.extract(t, ABSOLUTE, 3)), F.lit(0.0))

        def build(v: Column) -> Column:
            a, h, k = v["a"], v["h"], v["k"]
            d = -k / F.when(F.abs(a) > TINY, a)
            none = F.array().cast(f"array<{POINT}>")
            roots = (
                F.when(d > TINY, F.array(point(h - d, F.lit(0.0)), point(h + d, F.lit(0.0))))
                .when(d >= 0, F.array(point(h - d, F.lit(0.0)))).otherwise(none)
            )
            return features(
                type=F.lit("absolute_value"), vertex=point(h, k), opens=F.when(a >= 0, "up").otherwise("down"),
                axis_of_symmetry=_axis(h), y_intercepts=F.array(point(F.lit(0.0), a * F.abs(h) + k)), x_intercepts=roots,
                notable_points=F.array(point(h - 1, k + F.abs(a)), point(h + 1, k + F.abs(a))),
            )

        return F.when(
            R.matches(t, ABSOLUTE), R.let(F.struct(a.alias("a"), h.alias("h"), k.alias("k")), build)
        )

    t = F.translate(F.regexp_replace(R.text(eq), r"\s+", ""), "−–—", "---")
    return R.let(F.replace(F.regexp_replace(t, r"(?i)abs\(", "|"), F.lit(")"), F.lit("")), read)


def circle_features(eq: Column) -> Column:
    def read(t: Column) -> Column:
        shift = lambda i: -F.coalesce(number(R.extract(t, CIRCLE, i)), F.lit(0.0)) + F.lit(0.0)
        r2, r2o = number(R.extract(t, CIRCLE, 3)), number(R.extract(t, ORIGIN_CIRCLE, 1))
        return F.when(
            r2 > 0, features(type=F.lit("circle"), center=point(shift(1), shift(2)), radius=F.sqrt(r2))
        ).when(r2o > 0, features(type=F.lit("circle"), center=point(F.lit(0.0), F.lit(0.0)), radius=F.sqrt(r2o)))

    return R.let(_compact(eq), read)


def equation_features(eq: Column) -> Column:
    """First reading that applies, else only a type (polynomial or unknown)."""
    cubic = F.regexp_replace(R.text(eq), r"\s+", "").rlike(r"x\^\d|x³")
    fallback = features(type=F.when(cubic, "polynomial").otherwise("unknown"))
    return F.coalesce(line_features(eq), quadratic_features(eq), abs_features(eq), circle_features(eq), fallback)


def equation_type(eq: Column) -> Column:
    return equation_features(eq)["type"]


def type_from_summary(summary: Column) -> Column:
    t = F.lower(squeeze(summary))
    out = F.lit("unknown")
    for pattern, kind in reversed(SUMMARY_TYPES):
        out = F.when(t.rlike(pattern), kind).otherwise(out)
    return out


def type_from_features(summary: Column, f: Column) -> Column:
    low = F.lower(squeeze(summary))
    return (
        F.when(f["center"].isNotNull() & f["radius"].isNotNull(), "circle")
        .when(f["vertex"].isNotNull() & f["opens"].isin("up", "down"), F.when(low.contains("v"), "absolute_value").otherwise("parabola"))
        .when(f["slope"].isNotNull(), F.when(F.abs(f["slope"]) < TINY, "horizontal_line").otherwise("line"))
        .otherwise(type_from_summary(summary))
    )


def resolve_type(raw: Column, by_shape: Column, by_equation: Column) -> Column:
    """struct(type, notes) from label, shape and equation."""
    plain = lambda c: F.replace(c, F.lit("_"), F.lit(" "))
    # a line may turn out to be horizontal; every other pair must agree
    agree = lambda a, b: (a == b) | ((a == "line") & (b == "horizontal_line")) | ((a == "horizontal_line") & (b == "line"))
    known = lambda c: c != "unknown"
    shape = known(raw) & known(by_shape) & ~agree(raw, by_shape)
    equation = known(raw) & known(by_equation) & ~agree(raw, by_equation)
    notes = F.array_compact(
        F.array(
            F.when(shape, F.concat(F.lit("The shape cues suggest "), plain(by_shape), F.lit(", but the model labeled it as "), plain(raw), F.lit("."))),
            F.when(equation, F.concat(F.lit("The equation suggests "), plain(by_equation), F.lit(", but the graph shape may indicate "), plain(raw), F.lit("."))),
        )
    )
    kind = (
        F.when((raw == "line") & (by_equation == "horizontal_line"), "horizontal_line")
        .when(known(raw), raw).when(known(by_shape), by_shape).otherwise(by_equation)
    )
    return F.struct(kind.alias("type"), notes.alias("notes"))


def unique_points(points: Column) -> Column:
    """Distinct points (by printed coordinates and label), by x then y."""
    keyed = F.transform(
        points,
        lambda p: F.struct(
            p["x"].alias("x"), p["y"].alias("y"),
            F.concat_ws(":", format_number(p["x"]), format_number(p["y"]), F.coalesce(p["label"], F.lit(""))).alias("k"), p.alias("p"),
        ),
    )
    first = F.aggregate(
        keyed, F.array().cast(f"array<struct<x:double,y:double,k:string,p:{POINT}>>"),
        lambda acc, k: F.when(F.exists(acc, lambda a: a["k"] == k["k"]), acc).otherwise(F.array_append(acc, k)),
    )
    return F.transform(F.array_sort(first), lambda k: k["p"])


def merge_hints(f: Column, info: Column) -> Column:
    """Fill only what is missing in the features from the equation."""

    def merge(v: Column) -> Column:
        f, e = v["f"], v["e"]
        out = {}
        for n in FIELDS:
            if n in LISTS:
                out[n] = F.when(F.size(f[n]) > 0, f[n]).otherwise(unique_points(e[n]))
            elif n in INTERVALS:
                out[n] = f[n]
            else:
                out[n] = F.coalesce(f[n], e[n])
        out["type"] = f["type"]
        out["notable_points"] = F.when(
            (e["type"] == "vertical_line") & (F.size(out["notable_points"]) == 0) & e["x"].isNotNull(),
            F.array(point(e["x"], F.lit(0.0), label="x-constant reference")),
        ).otherwise(out["notable_points"])
        out["y_intercepts"] = F.when(
            (e["type"] == "horizontal_line") & (F.size(out["y_intercepts"]) == 0) & e["y"].isNotNull(),
            F.array(point(F.lit(0.0), e["y"])),
        ).otherwise(out["y_intercepts"])
        free = (e["type"] == "line") & (F.size(f["increasing_intervals"]) == 0) & (F.size(f["decreasing_intervals"]) == 0)
        every = F.array(F.lit("all real x"))
        out["increasing_intervals"] = F.when(free & (e["slope"] > 0), every).otherwise(f["increasing_intervals"])
        out["decreasing_intervals"] = F.when(free & (e["slope"] < 0), every).otherwise(f["decreasing_intervals"])
        return F.when(e["type"] == "unknown", f).otherwise(features(**out))

    return R.let(F.struct(f.alias("f"), info.alias("e")), merge)
