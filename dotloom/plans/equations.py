"""Named queries: equation features and graph descriptions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import equations as E
from . import duck as D
from .catalog import catalog
from .views import equations, with_views


def _r6(c: Column) -> Column:
    return F.floor(c * 1e6 + 0.5) / 1e6


def _s6(x: str) -> str:
    return f"floor(({x}) * 1e6 + 0.5) / 1e6"


def flat_features(f: str = "f") -> list[Column]:
    """Scalars of a feature struct, for comparison."""
    c = lambda p: F.col(f"{f}.{p}")
    at = lambda n, i, k: F.get(c(n), F.lit(i))[k]
    return [
        c("type").alias("type"), _r6(c("slope")).alias("slope"), _r6(c("vertex.x")).alias("vx"), _r6(c("vertex.y")).alias("vy"),
        c("opens").alias("opens"), c("axis_of_symmetry").alias("axis"), _r6(c("center.x")).alias("cx"), _r6(c("center.y")).alias("cy"),
        _r6(c("radius")).alias("radius"), _r6(at("x_intercepts", 0, "x")).alias("x1"), _r6(at("x_intercepts", 1, "x")).alias("x2"),
        _r6(at("y_intercepts", 0, "y")).alias("y1"), _r6(at("notable_points", 0, "y")).alias("n1"), _r6(c("x")).alias("x"), _r6(c("y")).alias("y"),
    ]


def _num(x: str) -> str:
    return f"TRY_CAST(nullif({x}, '') AS DOUBLE)"


def _fmt(x: str) -> str:
    return f"CASE WHEN abs({x} - floor({x} + 0.5)) < 1e-9 THEN CAST(CAST(floor({x} + 0.5) AS BIGINT) AS VARCHAR) ELSE regexp_replace(printf('%.3f', CAST({x} AS DOUBLE)), '\\.?0+$', '') END"


_LEAD = "CASE WHEN {0} IN ('', '+') THEN 1.0 WHEN {0} = '-' THEN -1.0 ELSE TRY_CAST({0} AS DOUBLE) END"
_VALS = f"""c AS (SELECT p_partkey, equation, regexp_replace(equation, '\\s+', '', 'g') AS t FROM equations),
 l AS (SELECT *, {D.matches('t', E.LINE)} AS is_line, CASE WHEN {D.extract('t', E.LINE, 1)} = '-' THEN -1 ELSE 1 END * coalesce({_num(D.extract('t', E.LINE, 2))}, 1) + 0.0 AS m,
   coalesce({_num(f"concat({D.extract('t', E.LINE, 3)}, {D.extract('t', E.LINE, 4)})")}, 0) AS b FROM c),
 line AS (SELECT p_partkey, CASE WHEN {D.matches('t', E.VERTICAL)} THEN 'vertical_line' WHEN {D.matches('t', E.CONSTANT)} OR (is_line AND abs(m) < 1e-9) THEN 'horizontal_line' ELSE 'line' END AS type,
   CASE WHEN is_line THEN m END AS slope, CAST(NULL AS DOUBLE) AS vx, CAST(NULL AS DOUBLE) AS vy, CAST(NULL AS VARCHAR) AS opens, CAST(NULL AS VARCHAR) AS axis, CAST(NULL AS DOUBLE) AS cx, CAST(NULL AS DOUBLE) AS cy, CAST(NULL AS DOUBLE) AS radius,
   CASE WHEN is_line AND abs(m) >= 1e-9 THEN -b / m + 0.0 END AS x1, CAST(NULL AS DOUBLE) AS x2, CASE WHEN is_line THEN b END AS y1, CAST(NULL AS DOUBLE) AS n1,
   {_num(D.extract('t', E.VERTICAL, 1))} AS x, {_num(D.extract('t', E.CONSTANT, 1))} AS y FROM l WHERE is_line OR {D.matches('t', E.VERTICAL)} OR {D.matches('t', E.CONSTANT)}),
 q0 AS (SELECT p_partkey, list_filter(string_split(split_part(replace(t, '-', '+-'), '=', 2), '+'), lambda x: x <> '') AS ts FROM c WHERE {D.matches('t', E.QUADRATIC)} AND contains(t, 'x^2') AND NOT contains(t, 'y^2')),
 q1 AS (SELECT p_partkey, replace(list_extract(list_filter(ts, lambda x: contains(x, 'x^2')), -1), 'x^2', '') AS ta, coalesce(replace(list_extract(list_filter(ts, lambda x: contains(x, 'x') AND NOT contains(x, 'x^2')), -1), 'x', ''), '0') AS tb,
   coalesce(list_extract(list_filter(ts, lambda x: NOT contains(x, 'x')), -1), '0') AS tc FROM q0),
 q2 AS (SELECT p_partkey, {_LEAD.format('ta')} AS a, {_LEAD.format('tb')} AS b, TRY_CAST(tc AS DOUBLE) AS c FROM q1),
 q3 AS (SELECT *, -b / (2 * a) + 0.0 AS h, b * b - 4 * a * c AS dd FROM q2),
 quad AS (SELECT p_partkey, 'parabola' AS type, CAST(NULL AS DOUBLE) AS slope, h AS vx, a * h * h + b * h + c AS vy, CASE WHEN a >= 0 THEN 'up' ELSE 'down' END AS opens, concat('x = ', {_fmt('h')}) AS axis,
   CAST(NULL AS DOUBLE) AS cx, CAST(NULL AS DOUBLE) AS cy, CAST(NULL AS DOUBLE) AS radius, CASE WHEN dd >= 0 THEN (-b - sqrt(greatest(dd, 0))) / (2 * a) + 0.0 END AS x1, CASE WHEN dd >= 0 AND sqrt(greatest(dd, 0)) > 1e-9 THEN (-b + sqrt(greatest(dd, 0))) / (2 * a) + 0.0 END AS x2,
   c AS y1, CAST(NULL AS DOUBLE) AS n1, CAST(NULL AS DOUBLE) AS x, CAST(NULL AS DOUBLE) AS y FROM q3),
 a0 AS (SELECT p_partkey, {_LEAD.format(D.extract('t', E.ABSOLUTE, 1))} AS a, -coalesce({_num(D.extract('t', E.ABSOLUTE, 2))}, 0) + 0.0 AS h, coalesce({_num(D.extract('t', E.ABSOLUTE, 3))}, 0) AS k FROM c WHERE {D.matches('t', E.ABSOLUTE)}),
 absv AS (SELECT p_partkey, 'absolute_value' AS type, CAST(NULL AS DOUBLE) AS slope, h AS vx, k AS vy, CASE WHEN a >= 0 THEN 'up' ELSE 'down' END AS opens, concat('x = ', {_fmt('h')}) AS axis, CAST(NULL AS DOUBLE) AS cx, CAST(NULL AS DOUBLE) AS cy, CAST(NULL AS DOUBLE) AS radius,
   CASE WHEN -k / a >= 0 THEN h + k / a + 0.0 END AS x1, CASE WHEN -k / a > 1e-9 THEN h - k / a + 0.0 END AS x2, a * abs(h) + k AS y1, k + abs(a) AS n1, CAST(NULL AS DOUBLE) AS x, CAST(NULL AS DOUBLE) AS y FROM a0),
 circ AS (SELECT p_partkey, 'circle' AS type, CAST(NULL AS DOUBLE) AS slope, CAST(NULL AS DOUBLE) AS vx, CAST(NULL AS DOUBLE) AS vy, CAST(NULL AS VARCHAR) AS opens, CAST(NULL AS VARCHAR) AS axis,
   -coalesce({_num(D.extract('t', E.CIRCLE, 1))}, 0) + 0.0 AS cx, -coalesce({_num(D.extract('t', E.CIRCLE, 2))}, 0) + 0.0 AS cy, sqrt({_num(D.extract('t', E.CIRCLE, 3))}) AS radius,
   CAST(NULL AS DOUBLE) AS x1, CAST(NULL AS DOUBLE) AS x2, CAST(NULL AS DOUBLE) AS y1, CAST(NULL AS DOUBLE) AS n1, CAST(NULL AS DOUBLE) AS x, CAST(NULL AS DOUBLE) AS y FROM c WHERE {D.matches('t', E.CIRCLE)}),
 ev AS (SELECT * FROM line UNION ALL SELECT * FROM quad UNION ALL SELECT * FROM absv UNION ALL SELECT * FROM circ)"""
_ROUND = ", ".join(
    f"{_s6(n)} AS {n}" if n not in ("type", "opens", "axis") else n
    for n in ["type", "slope", "vx", "vy", "opens", "axis", "cx", "cy", "radius", "x1", "x2", "y1", "n1", "x", "y"]
)


def _eq(name: str, ids: str, sql: str):
    return catalog.add(name, ids, with_views(f"WITH {_VALS} {sql}", "equations"))


def _one(name: str, ids: str, fn, source: str) -> None:
    @_eq(name, ids, f"SELECT p_partkey, {_ROUND} FROM {source}")
    def _(spark, sf):
        d = equations(spark, sf).select("p_partkey", fn(F.col("equation")).alias("f")).filter("f IS NOT NULL")
        return d.select("p_partkey", *flat_features())


_one("line_features", "K1", E.line_features, "line")
_one("quadratic_features", "K2", E.quadratic_features, "quad")
_one("absolute_value_features", "K3", E.abs_features, "absv")
_one("circle_features", "K4", E.circle_features, "circ")
_one("equation_features", "K5", E.equation_features, "ev")

# the shape summary and label a picture reader could have given, right in most cases
_SUMMARIES = ["straight line rising", "U-shaped curve", "V-shaped graph", "a circle", "horizontal band", "", "piecewise segments", "polynomial with a turning point", "vertical line"]
_LABELS = ["line", "parabola", "absolute_value", "circle", "horizontal_line", "unknown", "vertical_line"]


def _pick(items: list[str], mult: int) -> Column:
    return F.element_at(F.array(*map(F.lit, items)), (F.col("p_partkey") * mult % len(items) + 1).cast("int"))


def labelled(spark, sf) -> DataFrame:
    return equations(spark, sf).select(
        "p_partkey", "equation", _pick(_SUMMARIES, 5).alias("summary"), _pick(_LABELS, 3).alias("label"),
        E.equation_features(F.col("equation")).alias("e"),
    )


def _list(items: list[str]) -> str:
    return "[" + ", ".join(D.q(i) for i in items) + "]"


_SUMMARY_CASE = "CASE " + " ".join(f"WHEN regexp_matches(low, {D.q(p)}) THEN '{k}'" for p, k in E.SUMMARY_TYPES) + " ELSE 'unknown' END"
_LABELLED = f"""lb AS (SELECT ev.*, lower(({_list(_SUMMARIES)})[p_partkey * 5 % {len(_SUMMARIES)} + 1]) AS low, ({_list(_LABELS)})[p_partkey * 3 % {len(_LABELS)} + 1] AS label FROM ev),
 lt AS (SELECT *, {_SUMMARY_CASE} AS by_summary, CASE WHEN cx IS NOT NULL AND radius IS NOT NULL THEN 'circle' WHEN vx IS NOT NULL AND opens IN ('up', 'down') THEN CASE WHEN contains(low, 'v') THEN 'absolute_value' ELSE 'parabola' END
   WHEN slope IS NOT NULL THEN CASE WHEN abs(slope) < 1e-9 THEN 'horizontal_line' ELSE 'line' END ELSE {_SUMMARY_CASE} END AS by_features FROM lb)"""


def _labelled_query(name: str, ids: str, sql: str):
    return catalog.add(name, ids, with_views(f"WITH {_VALS}, {_LABELLED} {sql}", "equations"))


@_labelled_query("types_from_features", "K6", "SELECT p_partkey, by_features, by_summary FROM lt")
def _(spark, sf):
    return labelled(spark, sf).select(
        "p_partkey", E.type_from_features(F.col("summary"), F.col("e")).alias("by_features"), E.type_from_summary(F.col("summary")).alias("by_summary")
    )


_OK = "({a} = {b} OR ({a} IN ('line', 'horizontal_line') AND {b} IN ('line', 'horizontal_line')))"


@_labelled_query("resolved_types", "K7", f"""SELECT p_partkey, CASE WHEN label = 'line' AND type = 'horizontal_line' THEN 'horizontal_line' WHEN label <> 'unknown' THEN label WHEN by_features <> 'unknown' THEN by_features ELSE type END AS type,
 concat_ws('|', CASE WHEN label <> 'unknown' AND by_features <> 'unknown' AND NOT {_OK.format(a='label', b='by_features')} THEN concat('The shape cues suggest ', replace(by_features, '_', ' '), ', but the model labeled it as ', replace(label, '_', ' '), '.') END,
  CASE WHEN label <> 'unknown' AND type <> 'unknown' AND NOT {_OK.format(a='label', b='type')} THEN concat('The equation suggests ', replace(type, '_', ' '), ', but the graph shape may indicate ', replace(label, '_', ' '), '.') END) AS notes FROM lt""")
def _(spark, sf):
    r = E.resolve_type(F.col("label"), E.type_from_features(F.col("summary"), F.col("e")), F.col("e.type"))
    return labelled(spark, sf).select("p_partkey", r.alias("r")).select("p_partkey", "r.type", F.array_join("r.notes", "|").alias("notes"))


@_eq("merged_hints", "K8", f"""SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 7.0 ELSE {_s6('slope')} END AS slope, CASE WHEN p_partkey % 3 = 0 THEN 'left' ELSE opens END AS opens, axis, {_s6('vx')} AS vx, {_s6('radius')} AS radius,
 CASE WHEN type = 'horizontal_line' AND y1 IS NULL THEN {_s6('y')} ELSE {_s6('y1')} END AS y1, CASE WHEN type = 'vertical_line' THEN {_s6('x')} WHEN type = 'absolute_value' THEN {_s6('vx - 1')} END AS n1,
 CASE WHEN type = 'line' AND slope > 0 THEN 'all real x' ELSE '' END AS inc, CASE WHEN type = 'line' AND slope < 0 THEN 'all real x' ELSE '' END AS dec FROM ev""")
def _(spark, sf):
    k = F.col("p_partkey")
    given = E.features(
        type=F.lit("unknown"), slope=F.when(k % 2 == 0, 7.0), opens=F.when(k % 3 == 0, "left")
    )
    m = equations(spark, sf).select("p_partkey", E.merge_hints(given, E.equation_features(F.col("equation"))).alias("f"))
    c = lambda p: F.col(f"f.{p}")
    return m.select(
        "p_partkey", _r6(c("slope")).alias("slope"), c("opens").alias("opens"), c("axis_of_symmetry").alias("axis"), _r6(c("vertex.x")).alias("vx"),
        _r6(c("radius")).alias("radius"), _r6(F.get(c("y_intercepts"), F.lit(0))["y"]).alias("y1"), _r6(F.get(c("notable_points"), F.lit(0))["x"]).alias("n1"),
        F.array_join(c("increasing_intervals"), ",").alias("inc"), F.array_join(c("decreasing_intervals"), ",").alias("dec"),
    )


# ------------------------------------------------------------ graph descriptions

from ..functions import graphs as G  # noqa: E402
from ..operators import graphs as GO  # noqa: E402
from .sqlrules import trim  # noqa: E402
from .views import layout_lines, marked_docs  # noqa: E402

_EQ = "regexp_replace(translate(text, '−–—', '---'), '^', '')"
_KINDS = "CASE " + " ".join(f"WHEN regexp_matches(lower(text), {D.q(p)}) THEN '{k}'" for p, k in G.CHART_KINDS) + " ELSE 'generic' END"


@catalog.add("visible_equations_and_values", "K13", with_views(f"""
WITH x AS (SELECT doc_id, text, {D.extract_all('text', G.VISIBLE_VALUE)}[1:8] AS vs FROM marked_docs)
SELECT doc_id, {trim("regexp_replace(" + D.extract("translate(text, '−–—', '---')", G.VISIBLE_EQUATION, 0) + ", '" + chr(92) + "s+', ' ', 'g')")} AS equation,
 array_to_string(list_filter(vs, lambda v, i: list_position(vs, v) = i), ',') AS vals, {_KINDS} AS kind FROM x""", "marked_docs"))
def _(spark, sf):
    t = F.col("text")
    return marked_docs(spark, sf).select(
        "doc_id", G.extract_equation(t).alias("equation"), F.array_join(G.extract_values(t), ",").alias("vals"), G.chart_kind(t).alias("kind")
    )


_OCR = "o AS (SELECT doc_id, text, (x0 + x1) / 2 AS x_mid, ((792 - y0) + (792 - y1)) / 2 AS y_mid FROM layout_lines)"


def _best(name: str, cond: str, order: str) -> str:
    return f"{name} AS (SELECT doc_id, text FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY {order}) AS r FROM o WHERE regexp_matches(text, '\\p{{L}}') AND {cond}) WHERE r = 1)"


@catalog.add("graph_labels", "K14", with_views(f"""
WITH {_OCR}, {_best('ti', 'y_mid <= 792 * 0.24', 'length(text) DESC, y_mid, x_mid')}, {_best('ax', 'y_mid >= 792 * 0.72', 'y_mid, length(text) DESC, x_mid')},
 {_best('ay', 'x_mid <= 612 * 0.28 AND y_mid BETWEEN 792 * 0.12 AND 792 * 0.84', 'y_mid, length(text) DESC, x_mid')}, {_best('ca', 'y_mid >= 792 * 0.82', 'length(text) DESC, y_mid DESC, x_mid')}
SELECT d.doc_id, coalesce(ti.text, '') AS title, coalesce(ax.text, '') AS axis_x, coalesce(ay.text, '') AS axis_y, coalesce(ca.text, '') AS caption
FROM (SELECT DISTINCT doc_id FROM o) d LEFT JOIN ti USING (doc_id) LEFT JOIN ax USING (doc_id) LEFT JOIN ay USING (doc_id) LEFT JOIN ca USING (doc_id)""", "layout_lines"))
def _(spark, sf):
    o = layout_lines(spark, sf).select(
        "doc_id", "text", ((F.col("x0") + F.col("x1")) / 2).alias("x_mid"), (((792 - F.col("y0")) + (792 - F.col("y1"))) / 2).alias("y_mid")
    )
    return GO.pick_labels(o, ["doc_id"], 612, 792)


def raw_payloads(spark, sf) -> DataFrame:
    """What a simple reader returns for an equation: some fields, in part."""
    k = F.col("p_partkey")
    text = lambda n: F.lit("").alias(n)
    return equations(spark, sf).select(
        "p_partkey",
        F.struct(
            F.when(k % 3 == 0, "unclear").otherwise("function_graph").alias("graph_type"), F.col("equation").alias("equation_text"),
            F.when(k % 4 == 0, "falling").otherwise("").alias("trend_direction"), text("x_intercept_text"),
            F.when(k % 5 == 0, "1").otherwise("").alias("y_intercept_text"), F.when(k % 2 == 0, "x").otherwise("").alias("axis_x"), text("axis_y"),
            (k % 7 == 0).alias("coordinate_plane_present"), text("confidence"), text("caption_text"), F.when(k % 6 == 1, "Check the scale.").otherwise("").alias("note"),
        ).alias("p"),
    )


def _two(x: str) -> str:
    return f"CASE WHEN abs({x} - floor({x} + 0.5)) < 1e-9 THEN CAST(CAST(floor({x} + 0.5) AS BIGINT) AS VARCHAR) ELSE regexp_replace(printf('%.2f', CAST({x} AS DOUBLE)), '\\.?0+$', '') END"


@_eq("enhanced_payloads", "K15", f""", r0 AS (SELECT p_partkey, equation, t, {D.matches('t', G.CONSTANT)} AS fl, {D.matches('t', G.LINEAR)} AS li FROM c),
 r1 AS (SELECT *, CASE WHEN fl THEN 0.0 ELSE CASE WHEN {D.extract('t', G.LINEAR, 1)} = '-' THEN -1 ELSE 1 END * coalesce({_num(D.extract('t', G.LINEAR, 2))}, 1) + 0.0 END AS m,
   CASE WHEN fl THEN {_num(D.extract('t', G.CONSTANT, 1))} ELSE CASE WHEN {D.extract('t', G.LINEAR, 3)} = '-' THEN -1 ELSE 1 END * coalesce({_num(D.extract('t', G.LINEAR, 4))}, 0) END AS b FROM r0),
 r2 AS (SELECT *, fl OR li AS known, p_partkey % 7 = 0 OR p_partkey % 2 = 0 AS seen FROM r1)
SELECT p_partkey, CASE WHEN known THEN 'line_graph' WHEN p_partkey % 3 = 0 AND seen THEN 'coordinate_plane_graph' WHEN p_partkey % 3 = 0 THEN 'unclear' ELSE 'function_graph' END AS graph_type,
 CASE WHEN p_partkey % 4 = 0 THEN 'falling' WHEN NOT known THEN '' WHEN m > 0 THEN 'increasing' WHEN m < 0 THEN 'decreasing' ELSE 'horizontal' END AS trend_direction,
 CASE WHEN NOT known OR abs(m) < 1e-9 THEN '' ELSE {_two('(-b / m + 0.0)')} END AS x_intercept_text, CASE WHEN p_partkey % 5 = 0 THEN '1' WHEN known THEN {_two('b')} ELSE '' END AS y_intercept_text,
 CASE WHEN p_partkey % 2 = 0 OR (known AND seen) THEN 'x' ELSE '' END AS axis_x, CASE WHEN known AND seen THEN 'y' ELSE '' END AS axis_y, seen AS axes_visible, CASE WHEN known THEN 'medium' ELSE 'low' END AS confidence FROM r2""".lstrip().replace(", r0", ", r0", 1))
def _(spark, sf):
    e = raw_payloads(spark, sf).select("p_partkey", G.enhance_payload(F.col("p")).alias("e"))
    return e.select("p_partkey", *[f"e.{n}" for n in ("graph_type", "trend_direction", "x_intercept_text", "y_intercept_text", "axis_x", "axis_y", "axes_visible", "confidence")])


@catalog.add("graph_explanations", "K16")
def _(spark, sf):
    e = raw_payloads(spark, sf).select("p_partkey", G.enhance_payload(F.col("p")).alias("e"))
    return e.select("p_partkey", G.explanation(F.col("e"), "en").alias("english"), G.explanation(F.col("e"), "tr").alias("turkish"))


def json_payloads(spark, sf) -> DataFrame:
    """Payload JSON as a vision model writes it, code fences included."""
    d = labelled(spark, sf)
    k = F.col("p_partkey")
    body = F.to_json(
        F.struct(
            F.col("label").alias("graph_type"), F.when(k % 3 == 0, "high").otherwise("0.5").alias("confidence"), F.col("equation").alias("equation_text"),
            F.when(k % 4 == 0, F.col("summary")).alias("shape_summary"),
            F.struct(F.array(F.struct(F.lit("1").alias("x"), F.lit(True).alias("approx"))).alias("x_intercepts"), F.when(k % 5 == 0, "(0, 3)").alias("vertex")).alias("key_features"),
            F.array(F.lit("scale is faint")).alias("uncertainties"),
            # axes, mode and texts stand in one of several places, or nowhere
            F.when(k % 3 == 0, F.struct(F.when(k % 2 == 0, False).alias("has_x_axis"), F.lit(True).alias("origin_visible"), F.lit("  one   unit ").alias("scale_notes"))).alias("axes"),
            F.when(k % 4 == 1, False).alias("has_y_axis"), F.when(k % 5 == 0, False).alias("coordinate_plane_present"), F.when(k % 7 == 0, "top level").alias("scale_notes"),
            F.when(k % 3 == 1, "AI-Vision").when(k % 3 == 2, " ").alias("mode_used"), F.when(k % 6 == 2, "other").alias("analysisMode"),
            F.when(k % 9 == 0, "Own label").alias("analysisModeLabel"), F.when(k % 5 == 1, "").alias("caption_text"), F.when(k % 5 < 3, " Figure 1 ").alias("captionText"),
            F.when(k % 8 == 0, " A title ").alias("title"), F.when(k % 8 == 3, "Look at the axes.").alias("classroomTip"), F.when(k % 10 == 0, "⠁⠃").alias("explanation_braille"),
        )
    )
    return d.select("p_partkey", F.concat(F.lit("```json\n"), body, F.lit("\n```")).alias("json"))


@catalog.add("normalized_payloads", "K9 K10 K11 K12 A7")
def _(spark, sf):
    n = GO.normalize_payloads(json_payloads(spark, sf), "json")
    return n.select(
        "p_partkey", "graph_type", "confidence", "equation", "summary", "natural_description", "compact_description",
        F.array_join("relations", "|").alias("relations"), F.array_join("notes", "|").alias("notes"),
    )


@catalog.add("graph_axes_and_texts", "K9 K17", """
WITH g AS (SELECT p_partkey, p_partkey % 3 = 0 AS ax, p_partkey AS k FROM part),
 m AS (SELECT *, CASE k % 3 WHEN 1 THEN 'AI-Vision' ELSE CASE WHEN k % 6 = 2 THEN 'other' ELSE 'offline-basic' END END AS mode FROM g)
SELECT p_partkey, coalesce(CASE WHEN ax AND k % 2 = 0 THEN false END, CASE WHEN k % 5 = 0 THEN false END, true) AS has_x_axis,
 coalesce(CASE WHEN k % 4 = 1 THEN false END, CASE WHEN k % 5 = 0 THEN false END, true) AS has_y_axis, ax AS origin_visible,
 CASE WHEN ax THEN 'one unit' WHEN k % 7 = 0 THEN 'top level' ELSE '' END AS scale_notes, mode,
 CASE WHEN k % 9 = 0 THEN 'Own label' WHEN mode = 'AI-Vision' THEN 'AI Vision' WHEN mode = 'other' THEN 'Unknown mode' ELSE 'Offline Basic' END AS label_en,
 CASE WHEN k % 9 = 0 THEN 'Own label' WHEN mode = 'AI-Vision' THEN 'AI Vision' WHEN mode = 'other' THEN 'Bilinmeyen mod' ELSE 'Offline Basic' END AS label_tr,
 CASE WHEN k % 5 < 3 THEN 'Figure 1' ELSE '' END AS caption, CASE WHEN k % 8 = 0 THEN 'A title' ELSE '' END AS title,
 CASE WHEN k % 8 = 3 THEN 'Look at the axes.' ELSE '' END AS tip FROM m""")
def _(spark, sf):
    p = GO.read_graph_payloads(json_payloads(spark, sf), "json").select("p_partkey", G.normalize_axes(F.col("payload")).alias("a"), G.given_texts(F.col("payload")).alias("g"))
    return p.select(
        "p_partkey", "a.*", "g.mode", G.mode_label(F.col("g")).alias("label_en"), G.mode_label(F.col("g"), "tr").alias("label_tr"), "g.caption", "g.title", "g.tip"
    )


@catalog.add("graph_display_records", "K17")
def _(spark, sf):
    n = GO.normalize_payloads(json_payloads(spark, sf), "json")
    return GO.display_records(n, ["p_partkey"], ("en", "tr")).withColumn("notes", F.array_join("notes", "|"))
