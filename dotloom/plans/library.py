"""Named queries: library scans, filters, aggregates and mutations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import predicates as P
from ..operators import library as L
from . import duck as D
from .catalog import catalog
from .views import library_docs, profiles, table, with_views

META = "doc_id, user_id, file_name, source_type, is_favorite, is_archived"
TS = "strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at"
NOW = "(SELECT max(created_at) FROM library_docs)"


def _ts(name: str = "created_at") -> Column:
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss").alias(name)


def now_of(docs: DataFrame) -> Column:
    """The reference time of the tests: the newest document."""
    return docs.agg(F.max("created_at")).scalar()


def flat(df: DataFrame) -> DataFrame:
    """Scalars only, for comparison."""
    cols = [c for c in META.split(", ") if c in df.columns]
    return df.select(*cols, *[_ts(c) for c in ("created_at", "archived_at", "updated_at") if c in df.columns])


def chosen(spark: SparkSession, sf: str) -> DataFrame:
    """A selection of documents: those with a quality label of 1."""
    return table(spark, sf, "labels").filter("quality = 1").select("doc_id")


CHOSEN = "chosen AS (SELECT doc_id FROM labels WHERE quality = 1)"


def _lib(name: str, ids: str, sql: str):
    return catalog.add(name, ids, with_views(sql, "library_docs"))


@_lib("scan_library", "A1", f"SELECT {META}, {TS} FROM library_docs")
def _(spark, sf):
    return flat(L.scan_library(library_docs(spark, sf)))


@_lib("get_documents", "A2", f"WITH {CHOSEN} SELECT {META}, {TS}, original_text FROM library_docs WHERE doc_id IN (SELECT doc_id FROM chosen)")
def _(spark, sf):
    return L.get_documents(library_docs(spark, sf), chosen(spark, sf)).select(*META.split(", "), _ts(), "original_text")


@_lib("hydrate", "A3", f"""
WITH {CHOSEN} SELECT {META}, coalesce(b.text, 'none') AS original_text FROM library_docs
 LEFT JOIN (SELECT doc_id, text FROM documents WHERE doc_id IN (SELECT doc_id FROM chosen)) b USING (doc_id)""")
def _(spark, sf):
    meta = library_docs(spark, sf).select(*META.split(", ")).withColumn("original_text", F.lit("none"))
    bodies = table(spark, sf, "documents").select("doc_id", F.col("text").alias("original_text"))
    return L.hydrate(meta, bodies.join(chosen(spark, sf), "doc_id", "left_semi"))


_NAME = "lower(regexp_replace(file_name, '\\.[^/.]+$', ''))"
_BASE = D.sub(D.sub(D.sub(_NAME, "[^a-z0-9\\-_]+", "-"), "-+", "-"), "^-|-$", "")


@_lib("export_names", "A11", f"""
WITH g AS (SELECT user_id, source_type, count(*) AS n, min(file_name) AS file_name FROM library_docs GROUP BY user_id, source_type)
SELECT concat(user_id, '/', source_type) AS selection, CASE WHEN n = 1 THEN {_BASE} ELSE concat('braille-library-', n, '-items') END AS name FROM g
UNION ALL SELECT file_name AS selection, {_BASE} AS name FROM library_docs""")
def _(spark, sf):
    d = library_docs(spark, sf)
    groups = d.withColumn("selection", F.concat_ws("/", "user_id", "source_type"))
    single = d.withColumn("selection", F.col("file_name"))
    return L.export_name(groups, "selection").unionAll(L.export_name(single, "selection"))


for _status, _where in {
    "active": "NOT is_archived", "favorites": "is_favorite AND NOT is_archived", "archived": "is_archived", "all": "true",
}.items():
    @_lib(f"filter_status_{_status}", "I1", f"SELECT {META}, {TS} FROM library_docs WHERE {_where}")
    def _(spark, sf, status=_status):
        return flat(L.filter_status(library_docs(spark, sf), status))

for _kind, _where in {
    "graph": "source_type = 'graph'", "pdf": "source_type = 'pdf'", "image": "source_type IN ('image', 'camera')",
    "text": "source_type NOT IN ('graph', 'pdf', 'image', 'camera')",
}.items():
    @_lib(f"filter_type_{_kind}", "I2", f"SELECT {META}, {TS} FROM library_docs WHERE {_where}")
    def _(spark, sf, kind=_kind):
        return flat(L.filter_type(library_docs(spark, sf), kind))

for _win, _days in L.DATE_WINDOWS.items():
    @_lib(f"filter_date_{_win}", "I3", f"SELECT {META}, {TS} FROM library_docs WHERE created_at >= {NOW} - INTERVAL {_days} DAY")
    def _(spark, sf, win=_win):
        d = library_docs(spark, sf)
        return flat(L.filter_date(d, win, now_of(d)))


@_lib("filter_tag", "I4", f"SELECT {META}, {TS} FROM library_docs WHERE list_contains(tags, 'src3')")
def _(spark, sf):
    return flat(L.filter_tag(library_docs(spark, sf), "src3"))


@_lib("search_library", "I5", f"""SELECT {META}, {TS} FROM library_docs
 WHERE contains(lower(concat_ws(' ', file_name, original_text, source_type, array_to_string(tags, ' '))), 'the and')""")
def _(spark, sf):
    return flat(L.search(library_docs(spark, sf), " The AND "))


@_lib("recent_documents", "I6", f"SELECT {META}, {TS}, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, doc_id DESC) AS rank FROM library_docs) WHERE rank <= 4")
def _(spark, sf):
    return L.recent(library_docs(spark, sf)).select(*META.split(", "), _ts(), "rank")


@_lib("latest_documents", "I6", f"SELECT {META}, {TS} FROM library_docs ORDER BY created_at DESC, doc_id DESC LIMIT 4")
def _(spark, sf):
    return flat(L.recent(library_docs(spark, sf), 4, None))


@_lib("dashboard_counts", "I7", f"""SELECT user_id, count(*) FILTER (WHERE NOT is_archived) AS active, count(*) FILTER (WHERE is_favorite AND NOT is_archived) AS favorites,
 count(*) FILTER (WHERE created_at >= {NOW} - INTERVAL 7 DAY) AS last_7_days, count(*) AS total FROM library_docs GROUP BY user_id""")
def _(spark, sf):
    d = library_docs(spark, sf)
    return L.dashboard_counts(d, now_of(d))


@_lib("most_used_source", "I8", """WITH g AS (SELECT user_id, source_type, count(*) AS documents, max(created_at) AS seen FROM library_docs GROUP BY ALL)
SELECT user_id, source_type, documents FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY documents DESC, seen DESC) AS r FROM g) WHERE r = 1""")
def _(spark, sf):
    return L.most_used_source(library_docs(spark, sf))


_QUOTA = "CAST(least(100, floor(documents / 50 * 100 + 0.5)) AS BIGINT) AS usage, documents >= 40 AS is_warning, documents >= 50 AS is_exceeded"


@_lib("quota_status", "I9", f"SELECT user_id, documents, {_QUOTA} FROM (SELECT user_id, count(*) AS documents FROM library_docs GROUP BY user_id)")
def _(spark, sf):
    return L.quota_status(library_docs(spark, sf))


@_lib("toggle_favorite", "I10", f"WITH {CHOSEN} SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM chosen) THEN NOT is_favorite ELSE is_favorite END AS is_favorite FROM library_docs")
def _(spark, sf):
    return L.toggle_favorite(library_docs(spark, sf), chosen(spark, sf)).select("doc_id", "is_favorite")


_TARGET = "t AS (SELECT user_id, bool_or(NOT {0}) AS target FROM library_docs WHERE doc_id IN (SELECT doc_id FROM chosen) GROUP BY user_id)"


@_lib("bulk_favorite", "I10", f"WITH {CHOSEN}, {_TARGET.format('is_favorite')} SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM chosen) THEN target ELSE is_favorite END AS is_favorite FROM library_docs LEFT JOIN t USING (user_id)")
def _(spark, sf):
    return L.bulk_favorite(library_docs(spark, sf), chosen(spark, sf)).select("doc_id", "is_favorite")


_STAMP = f"strftime(CASE WHEN sel AND flag THEN {NOW} END, '%Y-%m-%d %H:%M:%S') AS archived_at"


@_lib("toggle_archive", "I11", f"WITH {CHOSEN} SELECT doc_id, flag AS is_archived, {_STAMP} FROM (SELECT doc_id, doc_id IN (SELECT doc_id FROM chosen) AS sel, (doc_id IN (SELECT doc_id FROM chosen)) <> is_archived AS flag FROM library_docs)")
def _(spark, sf):
    d = library_docs(spark, sf)
    return L.toggle_archive(d, chosen(spark, sf), now_of(d)).select("doc_id", "is_archived", _ts("archived_at"))


@_lib("bulk_archive", "I11", f"""WITH {CHOSEN}, {_TARGET.format('is_archived')} SELECT doc_id, flag AS is_archived, {_STAMP} FROM (
 SELECT doc_id, doc_id IN (SELECT doc_id FROM chosen) AS sel, CASE WHEN doc_id IN (SELECT doc_id FROM chosen) THEN target ELSE is_archived END AS flag FROM library_docs LEFT JOIN t USING (user_id))""")
def _(spark, sf):
    d = library_docs(spark, sf)
    return L.bulk_archive(d, chosen(spark, sf), now_of(d)).select("doc_id", "is_archived", _ts("archived_at"))


@_lib("rename_documents", "I12", """SELECT d.doc_id, coalesce(nullif(trim(n.new_name), ''), d.file_name) AS file_name FROM library_docs d
 LEFT JOIN (SELECT doc_id, CASE WHEN toxic = 1 THEN '  ' ELSE concat(' renamed ', doc_id, ' ') END AS new_name FROM labels) n USING (doc_id)""")
def _(spark, sf):
    names = table(spark, sf, "labels").select(
        "doc_id", F.when(F.col("toxic") == 1, "  ").otherwise(F.concat(F.lit(" renamed "), F.col("doc_id"), F.lit(" "))).alias("new_name")
    )
    return L.rename(library_docs(spark, sf), names).select("doc_id", "file_name")


@_lib("delete_documents", "I13", f"WITH {CHOSEN} SELECT {META}, {TS} FROM library_docs WHERE doc_id NOT IN (SELECT doc_id FROM chosen)")
def _(spark, sf):
    return flat(L.delete(library_docs(spark, sf), chosen(spark, sf)))


@_lib("reconcile_selection", "I14", f"WITH {CHOSEN} SELECT doc_id FROM chosen INTERSECT SELECT doc_id FROM library_docs WHERE NOT is_archived")
def _(spark, sf):
    return L.reconcile_selection(chosen(spark, sf), L.filter_status(library_docs(spark, sf)))


@catalog.add("upsert_profiles", "I15", with_views("""
WITH u AS (SELECT c_custkey + 500 AS id, concat('new', c_custkey, '@example.com') AS email, 'admin' AS role FROM customer)
SELECT coalesce(u.id, p.id) AS id, coalesce(u.email, p.email) AS email, coalesce(u.role, p.role) AS role, p.preferences FROM profiles p FULL OUTER JOIN u ON p.id = u.id""", "profiles"))
def _(spark, sf):
    k = F.col("c_custkey")
    u = table(spark, sf, "customer").select(
        (k + 500).alias("id"), F.concat(F.lit("new"), k, F.lit("@example.com")).alias("email"), F.lit("admin").alias("role")
    )
    return L.upsert_profiles(profiles(spark, sf), u)


@catalog.add("normalize_profiles", "I16", with_views("""
SELECT id, email, array_to_string(list_transform(regexp_extract_all(regexp_replace(split_part(email, '@', 1), '[._-]+', ' ', 'g'), '\\w+|\\W+'),
  lambda p: concat(upper(p[1]), p[2:])), '') AS display_name, role, 'comfortable' AS density, 'lilac' AS accent,
 CASE json_extract_string(preferences, '$.documentView') WHEN 'library' THEN 'documents' WHEN 'upload' THEN 'upload' WHEN 'overview' THEN 'overview' ELSE 'documents' END AS view,
 CASE json_extract_string(preferences, '$.themeMode') WHEN 'dark' THEN 'dark' ELSE 'light' END AS theme, false AS onboarded, true AS notified FROM profiles""", "profiles"))
def _(spark, sf):
    p = L.normalize_profiles(profiles(spark, sf))
    pref = lambda n, a: F.col(f"preferences.{n}").alias(a)
    return p.select(
        "id", "email", "display_name", "role", pref("dashboardDensity", "density"), pref("themeAccent", "accent"),
        pref("documentView", "view"), pref("themeMode", "theme"), pref("onboardingCompleted", "onboarded"), pref("notificationsEnabled", "notified"),
    )


@_lib("touch_updated_at", "I17", f"""SELECT d.doc_id + 100 AS doc_id, strftime(CASE WHEN o.doc_id IS NOT NULL THEN {NOW} ELSE d.created_at END, '%Y-%m-%d %H:%M:%S') AS updated_at
 FROM library_docs d LEFT JOIN library_docs o ON o.doc_id = d.doc_id + 100""")
def _(spark, sf):
    d = library_docs(spark, sf)
    new = d.select((F.col("doc_id") + 100).alias("doc_id"), F.col("created_at").alias("updated_at"))
    return L.touch_updated_at(d, new, now_of(d)).select("doc_id", _ts("updated_at"))


_MODES = "CASE WHEN doc_id % 17 = 0 THEN 'speech' WHEN source_type IN ('image', 'camera') THEN 'ocr' ELSE 'text' END"


@_lib("document_violations", "I18", f"""WITH x AS (SELECT doc_id, CASE WHEN doc_id % 19 = 0 THEN 'fax' ELSE source_type END AS source_type, {_MODES} AS conversion_mode, CASE WHEN doc_id % 23 <> 0 THEN file_name END AS file_name FROM library_docs)
SELECT doc_id, 'source_type' AS rule FROM x WHERE source_type NOT IN ('manual', 'pdf', 'image', 'camera', 'graph', 'word-addin')
UNION ALL SELECT doc_id, 'conversion_mode' FROM x WHERE conversion_mode NOT IN ('text', 'nemeth', 'ocr', 'graph-description')
UNION ALL SELECT doc_id, 'file_name' FROM x WHERE file_name IS NULL""")
def _(spark, sf):
    k = F.col("doc_id")
    mode = F.when(k % 17 == 0, "speech").when(F.col("source_type").isin("image", "camera"), "ocr").otherwise("text")
    d = library_docs(spark, sf).select(
        "doc_id", "user_id", F.when(k % 19 == 0, "fax").otherwise(F.col("source_type")).alias("source_type"),
        mode.alias("conversion_mode"), F.when(k % 23 != 0, F.col("file_name")).alias("file_name"),
    )
    return L.constraint_violations(d, "doc_id", L.document_rules())


@catalog.add("profile_violations", "I18", with_views("SELECT id, 'role' AS rule FROM profiles WHERE role NOT IN ('member', 'admin')", "profiles"))
def _(spark, sf):
    return L.constraint_violations(profiles(spark, sf), "id", L.profile_rules())


@_lib("backfill_defaults", "I19", f"""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'manual' ELSE source_type END AS source_type, CASE WHEN doc_id % 4 = 0 THEN false ELSE is_favorite END AS is_favorite,
 CASE WHEN doc_id % 5 = 0 THEN '' ELSE array_to_string(tags, ',') END AS tags,
 strftime(CASE WHEN doc_id % 2 = 0 THEN {NOW} ELSE created_at END, '%Y-%m-%d %H:%M:%S') AS updated_at FROM library_docs""")
def _(spark, sf):
    k = F.col("doc_id")
    d = library_docs(spark, sf)
    old = d.select(
        "doc_id", F.when(k % 3 != 0, F.col("source_type")).alias("source_type"),
        F.when(k % 4 != 0, F.col("is_favorite")).alias("is_favorite"), F.when(k % 5 != 0, F.col("tags")).alias("tags"),
        F.when(k % 2 != 0, F.col("created_at")).alias("created_at"), F.lit(None).cast("timestamp_ntz").alias("updated_at"),
    )
    return L.backfill_defaults(old, now_of(d)).select(
        "doc_id", "source_type", "is_favorite", F.array_join("tags", ",").alias("tags"), _ts("updated_at")
    )


@_lib("visible_to_user", "I20", f"SELECT {META}, {TS} FROM library_docs WHERE user_id IN (SELECT concat('u', user_id % 50) FROM events WHERE event_type = 'signup' AND value > 20)")
def _(spark, sf):
    users = table(spark, sf, "events").filter("event_type = 'signup' AND value > 20").select(
        F.concat(F.lit("u"), (F.col("user_id") % 50).cast("string")).alias("user_id")
    )
    return flat(L.visible_to(library_docs(spark, sf), users))


_LABELS = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in L.SOURCE_LABELS.items())


@_lib("document_labels", "I21", f"""SELECT doc_id, CASE source_type {_LABELS} ELSE 'Manual / TXT' END AS source_label, CASE WHEN source_type IN ('image', 'camera') THEN 'OCR' ELSE 'Text' END AS mode_label,
 CASE WHEN length(original_text) > 180 THEN concat({D.strip('substr(original_text, 1, 180)')}, '...') ELSE original_text END AS preview FROM library_docs""")
def _(spark, sf):
    src = F.col("source_type")
    return library_docs(spark, sf).select(
        "doc_id", L.source_label(src).alias("source_label"),
        L.mode_label(F.when(src.isin("image", "camera"), "ocr").otherwise("other")).alias("mode_label"),
        L.truncate_preview(F.col("original_text")).alias("preview"),
    )


@_lib("page_lookups", "P13", f"""WITH x AS (SELECT doc_id, trim((['', 'abc', '0', '3', ' 12 ', '99999999999999999999'])[doc_id % 6 + 1]) AS t, CAST(1 + length(original_text) // 1600 AS INT) AS total FROM library_docs)
SELECT doc_id, total, ok, error, CASE WHEN ok THEN CAST(t AS BIGINT) - 1 END AS page_index FROM (SELECT *, error IS NULL AS ok FROM (
 SELECT *, CASE WHEN t = '' THEN 'empty' WHEN NOT regexp_matches(t, '^\\d+$') THEN 'invalid' WHEN CAST(t AS HUGEINT) < 1 OR CAST(t AS HUGEINT) > total THEN 'out_of_range' END AS error FROM x))""")
def _(spark, sf):
    raw = F.array(*map(F.lit, ["", "abc", "0", "3", " 12 ", "99999999999999999999"]))
    d = library_docs(spark, sf).select(
        "doc_id", F.element_at(raw, (F.col("doc_id") % 6 + 1).cast("int")).alias("raw"),
        (1 + F.floor(F.length("original_text") / 1600)).cast("int").alias("total"),
    )
    return d.withColumn("_r", P.page_lookup(F.col("raw"), F.col("total"))).select("doc_id", "total", "_r.*")
