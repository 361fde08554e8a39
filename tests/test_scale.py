"""Values beyond any fixed length, and streams over tables of part files."""

import datetime as dt
import tempfile

import pytest
from pyspark.sql import functions as F

from dotloom.functions import transcode as X
from dotloom.functions import wordrepair as W
from dotloom.operators import align as A
from dotloom.operators import library as L
from dotloom.operators import repair as RP
from dotloom.streaming import jobs


@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def test_scripts_of_any_length_carry_no_capital_sign(apply):
    capital = apply(X.to_braille_lenient, ["A"])[0].removesuffix(apply(X.to_braille_lenient, ["a"])[0])
    scripts = [f"x^{'1' * n}A" for n in (0, 1, 10, 64, 70, 500)] + [f"x_{'2' * 70}A"]
    assert capital and not any(capital in cells for cells in apply(X.to_braille_lenient, scripts))
    signed, plain = apply(X.to_braille_lenient, [f"x^{'1' * 70} A", f"x^{'1' * 70}a B"])
    assert capital in signed and capital in plain


def test_long_values_stay_whole(apply):
    n = 1_200_000
    (name,) = apply(L.default_display_name, ["a" * n + "@x"])
    assert len(name) == n
    (merged,) = apply(lambda c: RP.merged_line(F.lit("one"), c, F.lit(False)), ["b" * n])
    assert len(merged) == n + 4
    (cased,) = apply(lambda c: W.preserve_case(F.lit("Abc"), c), ["b" * n])
    assert len(cased) == n


def test_highlight_indices_of_a_long_line(spark):
    words = 5000
    df = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(words)))], "k int, text string")
    rows = A.highlight_tokens(df, "text", F.lit(False)).orderBy("pos").collect()
    assert [r.pos for r in rows] == list(range(2 * words - 1))
    assert [r.token_index for r in rows if r.kind == "word"] == list(range(words))
    assert all(r.token_index is None for r in rows if r.kind == "space") and {r.n_tokens for r in rows} == {words}


def events(spark, hours):
    rows = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(hours=h), i % 3, "e", 1.0, "") for i, h in enumerate(hours)]
    return spark.createDataFrame(rows, jobs.EVENT_SCHEMA)


def test_streams_read_files_and_folders(spark, folder):
    e = events(spark, range(60))
    e.coalesce(1).write.parquet(f"{folder}/one")
    e.repartition(3).write.parquet(f"{folder}/parts.parquet")
    counts = []
    for k, path in enumerate([f"{folder}/one", f"{folder}/parts.parquet"]):
        out = jobs.latest(jobs.drain(jobs.running_quota(jobs.read_events(spark, path)), f"{folder}/base{k}"), ["user_id"])
        counts.append(sorted((r.user_id, r.documents) for r in out.collect()))
    assert counts[0] == counts[1] == [(0, 20), (1, 20), (2, 20)]


def test_an_empty_stream_gives_an_empty_table(spark, folder):
    events(spark, []).write.parquet(f"{folder}/none")
    out = jobs.drain(jobs.running_quota(jobs.read_events(spark, f"{folder}/none")), f"{folder}/base")
    assert out.count() == 0 and "user_id" in out.columns and "batch" in out.columns


def test_late_rows_are_dropped(spark, folder):
    events(spark, [1, 30]).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    windows = jobs.activity_windows(jobs.read_events(spark, f"{folder}/in"), "1 day", None, "2 hours")
    jobs.drain(windows, f"{folder}/base", "append")
    # the watermark is at hour 28: of two rows that come now, one belongs to the day that is closed
    events(spark, [2, 31]).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    jobs.drain(windows, f"{folder}/base", "append")
    events(spark, [90]).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    out = jobs.drain(windows, f"{folder}/base", "append").orderBy("window_start").collect()
    assert [(r.window_start.day, r.events) for r in out] == [(1, 1), (2, 2)]
