"""Library operators: look-ups, filters, search, facets, quotas and mutations.

Mutations are copy-on-write: they return the new table.  Times come in as a
parameter; nothing here reads a clock.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions import regex as R
from .transcoding import PAGE_MARKER

# --- fixed values: labels, limits and allowed values -----------------------------
SOURCE_LABELS = {
    "manual": "Manual / TXT", "pdf": "PDF", "image": "Image OCR", "camera": "Camera OCR",
    "graph": "Graph Reader", "word-addin": "Word Add-in",
}
MODE_LABELS = {"text": "Text", "nemeth": "Nemeth", "ocr": "OCR", "graph-description": "Graph Description"}
TEXT_COLUMNS = ["original_text", "braille_text"]
DOCUMENT_LIMIT, WARNING_SHARE = 50, 0.8
PREVIEW_LENGTH = 180
ROLES = ["member", "admin"]
PREFERENCES = {
    # name: (default, allowed values)
    "dashboardDensity": ("comfortable", ["comfortable", "compact"]),
    "documentView": ("documents", ["overview", "documents", "upload"]),
    "themeAccent": ("lilac", ["lilac", "ocean", "sunrise"]),
    "themeMode": ("light", ["light", "dark"]),
}
DATE_WINDOWS = {"today": 1, "7d": 7, "30d": 30}
# ---------------------------------------------------------------------------------


def scan_library(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Metadata only, newest first; the text columns are never read."""
    cols = columns or [c for c in df.columns if c not in TEXT_COLUMNS]
    return df.select(*cols).orderBy(F.desc("created_at"))


def visible_to(df: DataFrame, users: DataFrame, user: str = "user_id") -> DataFrame:
    """Row-level security: only rows owned by the given users."""
    return df.join(users.select(user).distinct(), user, "left_semi")


def get_documents(df: DataFrame, ids: DataFrame, key: str = "doc_id", user: str | None = None) -> DataFrame:
    """Documents by id; with ``user`` the requester must own the document."""
    on = [key] + ([user] if user else [])
    return df.join(ids.select(*on).distinct(), on, "left_semi")


def hydrate(meta: DataFrame, bodies: DataFrame, key: str = "doc_id") -> DataFrame:
    """Fill text columns for the chosen rows; a body value wins over the meta value."""
    wanted = bodies.join(meta.select(key), key, "left_semi")
    filled = [c for c in wanted.columns if c != key]
    b = wanted.select(key, *[F.col(c).alias(f"_b_{c}") for c in filled])
    joined = meta.join(b, key, "left")
    rest = [F.col(c) for c in meta.columns if c not in filled]
    return joined.select(
        *rest,
        *[F.coalesce(f"_b_{c}", c).alias(c) if c in meta.columns else F.col(f"_b_{c}").alias(c) for c in filled],
    )


def export_base_name(file_name: Column) -> Column:
    stem = F.regexp_replace(R.text(file_name), r"\.[^/.]+\z", "")
    t = F.regexp_replace(F.lower(stem), r"[^a-z0-9\-_]+", "-")
    t = F.regexp_replace(F.regexp_replace(t, "-+", "-"), r"^-|-\z", "")
    return F.when(t == "", "braille-document").otherwise(t)


def export_name(df: DataFrame, group: str, file_name: str = "file_name") -> DataFrame:
    """Name of the export file of each selection."""
    g = df.groupBy(group).agg(F.count("*").alias("_n"), F.min(file_name).alias("_f"))
    return g.select(
        group,
        F.when(F.col("_n") == 1, export_base_name(F.col("_f")))
        .otherwise(F.concat(F.lit("braille-library-"), F.col("_n").cast("string"), F.lit("-items"))).alias("name"),
    )


def filter_status(df: DataFrame, status: str = "active") -> DataFrame:
    archived, favorite = F.col("is_archived"), F.col("is_favorite")
    keep = {
        "active": ~archived, "favorites": favorite & ~archived, "archived": archived, "all": F.lit(True),
    }[status]
    return df.filter(keep)


def display_type(source: Column) -> Column:
    return F.when(source.isin("graph", "pdf"), source).when(source.isin("image", "camera"), "image").otherwise("text")


def filter_type(df: DataFrame, kind: str = "all") -> DataFrame:
    return df if kind == "all" else df.filter(display_type(F.col("source_type")) == kind)


def filter_date(df: DataFrame, window: str, now: Column) -> DataFrame:
    """Rows of the last day, week or month before ``now``."""
    if window == "all":
        return df
    return df.filter(F.col("created_at") >= now - F.make_dt_interval(days=F.lit(DATE_WINDOWS[window])))


def filter_tag(df: DataFrame, tag: str) -> DataFrame:
    return df if tag == "all" else df.filter(F.array_contains("tags", tag))


def search(df: DataFrame, query: str, marker: str = PAGE_MARKER) -> DataFrame:
    """Case-insensitive substring over names, texts, source, mode and tags."""
    wanted = query.strip().lower()
    if not wanted:
        return df
    text = lambda c: F.replace(F.col(c), F.lit(marker), F.lit(" "))
    parts = [F.col("file_name")] + [text(c) for c in TEXT_COLUMNS if c in df.columns]
    parts += [F.col(c) for c in ("source_type", "conversion_mode") if c in df.columns]
    parts = [F.when(p != "", p) for p in parts]  # empty values leave no separator
    parts.append(F.when(F.size("tags") > 0, F.array_join("tags", " ")))
    return df.filter(F.lower(F.concat_ws(" ", *parts)).contains(wanted))


def recent(df: DataFrame, n: int = 4, by: str | None = "user_id") -> DataFrame:
    """The newest n documents, per user.  The limit is applied before the shuffle."""
    order = [F.desc("created_at"), F.desc("doc_id")]
    if by is None:
        return df.orderBy(*order).limit(n)
    w = Window.partitionBy(by).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def latest_document(df: DataFrame, by: str | None = "user_id") -> DataFrame:
    return recent(df, 1, by)


def dashboard_counts(df: DataFrame, now: Column, by: str | None = "user_id") -> DataFrame:
    week = F.col("created_at") >= now - F.make_dt_interval(days=F.lit(7))
    g = df.withColumn("_week", week).groupBy(*([by] if by else []))
    return g.agg(
        F.count_if(~F.col("is_archived")).alias("active"),
        F.count_if(F.col("is_favorite") & ~F.col("is_archived")).alias("favorites"),
        F.count_if("_week").alias("last_7_days"),
        F.count("*").alias("total"),
    )


def most_used_source(df: DataFrame, by: str = "user_id") -> DataFrame:
    """Most frequent source; among equals the one seen first (newest first)."""
    counts = df.groupBy(by, "source_type").agg(F.count("*").alias("n"), F.max("created_at").alias("seen"))
    return counts.groupBy(by).agg(F.max_by("source_type", F.struct("n", "seen")).alias("source_type"), F.max("n").alias("documents"))


def quota_columns(count: Column, limit: int = DOCUMENT_LIMIT) -> list[Column]:
    """Usage, warning and exceeded flags of a document count."""
    usage = F.least(F.lit(100), F.floor(count / limit * 100 + 0.5)).cast("long")
    warn = -int(-(limit * WARNING_SHARE) // 1)
    return [usage.alias("usage"), (count >= warn).alias("is_warning"), (count >= limit).alias("is_exceeded")]


def quota_status(df: DataFrame, by: str = "user_id", limit: int = DOCUMENT_LIMIT) -> DataFrame:
    n = df.groupBy(by).agg(F.count("*").alias("documents"))
    return n.select("*", *quota_columns(F.col("documents"), limit))


def _selected(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    marks = ids.select(key).distinct().withColumn("_sel", F.lit(True))
    return df.join(marks, key, "left").withColumn("_sel", F.coalesce("_sel", F.lit(False)))


def toggle_favorite(df: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    s = _selected(df, ids, key)
    return s.withColumn("is_favorite", F.col("is_favorite") != F.col("_sel")).drop("_sel")


def _bulk_target(df: DataFrame, ids: DataFrame, flag: str, key: str, by: str) -> DataFrame:
    """Per user: set the flag when any selected row lacks it, else clear it."""
    selected = df.select(key, by, flag).join(ids.select(key).distinct(), key, "left_semi")
    target = selected.groupBy(by).agg(F.bool_or(~F.col(flag)).alias("_target"))
    # the library itself is joined by key alone, so a user with many documents is no join key
    marks = selected.join(target, by, "left").groupBy(key).agg(F.first("_target").alias("_target"))
    marked = df.join(marks.withColumn("_sel", F.lit(True)), key, "left")
    return marked.withColumn("_sel", F.coalesce("_sel", F.lit(False)))


def bulk_favorite(df: DataFrame, ids: DataFrame, key: str = "doc_id", by: str = "user_id") -> DataFrame:
    s = _bulk_target(df, ids, "is_favorite", key, by)
    return s.withColumn("is_favorite", F.when(F.col("_sel"), F.col("_target")).otherwise(F.col("is_favorite"))).select(*df.columns)


def _archive(s: DataFrame, archived: Column, now: Column, columns: list[str]) -> DataFrame:
    """Apply an archived flag to the selected rows and stamp or clear the time."""
    old = F.col("archived_at") if "archived_at" in columns else F.lit(None).cast("timestamp_ntz")
    s = s.withColumn("_new", F.when(F.col("_sel"), archived).otherwise(F.col("is_archived")))
    stamp = F.when(~F.col("_sel"), old).when(F.col("_new"), now)
    keep = [c for c in columns if c not in ("is_archived", "archived_at")]
    return s.select(*keep, F.col("_new").alias("is_archived"), stamp.alias("archived_at"))


def toggle_archive(df: DataFrame, ids: DataFrame, now: Column, key: str = "doc_id") -> DataFrame:
    return _archive(_selected(df, ids, key), ~F.col("is_archived"), now, df.columns)


def bulk_archive(df: DataFrame, ids: DataFrame, now: Column, key: str = "doc_id", by: str = "user_id") -> DataFrame:
    return _archive(_bulk_target(df, ids, "is_archived", key, by), F.col("_target"), now, df.columns)


def rename(df: DataFrame, names: DataFrame, key: str = "doc_id") -> DataFrame:
    """New names, trimmed; a blank name changes nothing."""
    n = names.select(key, R.strip(R.text("new_name")).alias("_n")).filter("_n <> ''")
    j = df.join(n, key, "left")
    return j.withColumn("file_name", F.coalesce("_n", "file_name")).select(*df.columns)


def delete(df: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    return df.join(ids.select(key), key, "left_anti")


def reconcile_selection(selected: DataFrame, visible: DataFrame, key: str = "doc_id") -> DataFrame:
    """Selected ids that are still visible."""
    return selected.select(key).intersect(visible.select(key))


def upsert_profiles(base: DataFrame, updates: DataFrame, key: str = "id") -> DataFrame:
    """Insert or replace on id; a replaced row takes every non-null update value."""
    u = updates.select(key, *[F.col(c).alias(f"_u_{c}") for c in updates.columns if c != key])
    j = base.join(u, key, "full_outer")
    return j.select(
        key,
        *[F.coalesce(f"_u_{c}", c).alias(c) if c in updates.columns else F.col(c) for c in base.columns if c != key],
    )


def default_display_name(email: Column) -> Column:
    local = F.split_part(R.text(email), F.lit("@"), F.lit(1))
    local = F.when(local == "", "Library User").otherwise(local)
    pieces = F.regexp_extract_all(F.regexp_replace(local, "[._-]+", " "), F.lit(r"\w+|\W+"), 0)
    return F.array_join(
        F.transform(pieces, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, F.lit(2), F.length(p)))), ""
    )


PREFERENCE_SCHEMA = T.StructType(
    [T.StructField(k, T.StringType()) for k in PREFERENCES]
    + [T.StructField("onboardingCompleted", T.BooleanType()), T.StructField("notificationsEnabled", T.BooleanType())]
)


def normalize_preferences(json: Column) -> Column:
    """Preference JSON -> struct of allowed values with defaults."""

    def clean(p: Column) -> Column:
        fields = []
        for name, (default, allowed) in PREFERENCES.items():
            v = F.coalesce(p[name], F.lit(default))
            if name == "documentView":
                v = F.when(v == "library", "documents").otherwise(v)
            fields.append(F.when(v.isin(allowed), v).otherwise(default).alias(name))
        return F.struct(
            *fields,
            F.coalesce(p["onboardingCompleted"], F.lit(False)).alias("onboardingCompleted"),
            F.coalesce(p["notificationsEnabled"], F.lit(True)).alias("notificationsEnabled"),
        )

    return R.let(F.from_json(F.coalesce(json, F.lit("{}")), PREFERENCE_SCHEMA), clean)


def normalize_profiles(df: DataFrame) -> DataFrame:
    name = F.col("display_name") if "display_name" in df.columns else F.lit(None).cast("string")
    return df.select(
        "id", "email",
        F.coalesce(F.when(name != "", name), default_display_name(F.col("email"))).alias("display_name"),
        F.coalesce("role", F.lit("member")).alias("role"),
        normalize_preferences(F.col("preferences")).alias("preferences"),
    )


def touch_updated_at(old: DataFrame, new: DataFrame, now: Column, key: str = "doc_id") -> DataFrame:
    """New versions of existing rows are stamped; every other row keeps its time."""
    o = old.select(key).withColumn("_old", F.lit(True))
    j = new.join(o, key, "left")
    return j.withColumn("updated_at", F.when(F.col("_old"), now).otherwise(F.col("updated_at"))).select(*new.columns)


def constraint_violations(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """One row per broken rule, in a single pass over the table."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in rules.items()]))
    return df.select(key, F.explode(broken).alias("rule"))


def document_rules() -> dict[str, Column]:
    return {
        "source_type": F.col("source_type").isin(list(SOURCE_LABELS)),
        "conversion_mode": F.col("conversion_mode").isin(list(MODE_LABELS)),
        "user_id": F.col("user_id").isNotNull(),
        "file_name": F.col("file_name").isNotNull(),
    }


def profile_rules() -> dict[str, Column]:
    return {"role": F.col("role").isin(ROLES), "email": F.col("email").isNotNull()}


def backfill_defaults(df: DataFrame, now: Column) -> DataFrame:
    """Nulls of an older table take the defaults of the current one."""
    fill = {
        "source_type": F.lit("manual"), "conversion_mode": F.lit("text"),
        "tags": F.array().cast("array<string>"), "is_favorite": F.lit(False), "is_archived": F.lit(False),
    }
    out = df.select(*[F.coalesce(F.col(c), fill[c]).alias(c) if c in fill else F.col(c) for c in df.columns])
    return out.withColumn("updated_at", F.coalesce("updated_at", "created_at", now))


def _label(table: dict[str, str], col: Column, default: str) -> Column:
    flat = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*flat), col), F.lit(table[default]))


def source_label(col: Column) -> Column:
    return _label(SOURCE_LABELS, col, "manual")


def mode_label(col: Column) -> Column:
    return _label(MODE_LABELS, col, "text")


def truncate_preview(col: Column, length: int = PREVIEW_LENGTH) -> Column:
    t = R.text(col)
    return F.when(F.length(t) > length, F.concat(R.strip(F.substring(t, 1, length)), F.lit("..."))).otherwise(t)
