"""Sources, sinks and streams round-trip; layout, alignment and graphs keep their invariants."""

import json
import tempfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from conftest import SF_DIR
from dotloom.functions import equations as E, graphs as G
from dotloom.operators import align as A, graphs as GO, layout as LA, structure as S
from dotloom.operators.transcoding import PAGE_MARKER
from dotloom.plans import structure as PS
from dotloom.plans.views import library_docs
from dotloom.sources import packs, readers, writers
from dotloom.streaming import jobs


@pytest.fixture
def folder():
    return Path(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))


def test_text_documents(spark, folder):
    (folder / "a.txt").write_text("one\ntwo")
    (row,) = readers.read_text_documents(spark, str(folder / "*.txt")).collect()
    assert (row.file_name, row.original_text, row.source_type) == ("a.txt", "one\ntwo", "manual")


def test_golden_tsv(spark, folder):
    f = folder / "g.tsv"
    f.write_text("# comment\nG1\t2 + 3\t[\"t\"]\t(2 + 3)\t\\u283C\\u2803\n")
    (row,) = readers.read_golden_tsv(spark, str(f)).collect()
    assert (row.case_id, row.expected_tokens, row.expected_cells) == ("G1", '["t"]', "⠼⠃")
    f.write_text("G1\tonly two\n")
    with pytest.raises(Exception, match="expected 5 fields"):
        readers.read_golden_tsv(spark, str(f)).collect()


def test_layout_items(spark, folder):
    items = [{"str": s, "transform": [1, 0, 0, 1, x, y], "width": w, "height": 12} for s, x, y, w in
             [("1.", 70, 760, 10), ("Kökler", 86, 760, 40), (",", 126, 760, 4), ("Next", 70, 740, 30), ("far", 70, 600, 20)]]
    (folder / "l.json").write_text(json.dumps({"doc_id": "d", "pages": [{"page_no": 1, "width": 612, "height": 792, "items": items}]}))
    got = readers.read_layout_items(spark, str(folder / "l.json"))
    lines = LA.items_to_lines(LA.pages(got))
    assert [r.text for r in lines.orderBy("line_no").collect()] == ["1. Kökler,", "Next", "far"]
    gaps = LA.blank_line_gaps(LA.pages(lines))
    assert [r.text for r in gaps.orderBy("ord").collect()] == ["1. Kökler,", "Next", "", "far"]


def test_library_sinks(spark, folder):
    rows = [(1, "u", "a", "x", f"⠁⠃\n{PAGE_MARKER}\n⠑⠝", "manual", "text", ["My Tag", "my tag"]), (2, "u", "b", "y", "⠁", "pdf", "text", [])]
    cols = "doc_id int, user_id string, file_name string, original_text string, braille_text string, source_type string, conversion_mode string, tags array<string>"
    df = spark.createDataFrame(rows, cols)
    writers.append_documents(df, str(folder / "lib"))
    writers.append_documents(df, str(folder / "lib"))
    lib = writers.read_library(spark, str(folder / "lib"))
    assert lib.count() == 4 and lib.filter("doc_id = 1").first().tags == ["my-tag"]
    writers.write_brf(df, str(folder / "brf"), "doc_id")
    assert packs.fetch(str(folder / "brf"), "1.brf").decode() == "ab\n\f\nen" and packs.fetch(str(folder / "brf"), "3.brf") is None
    writers.write_brf(df, str(folder / "all"), "doc_id", combined=True)
    text = "".join(p.read_text() for p in sorted((folder / "all").glob("part-*")))
    assert text.removesuffix("\n\f\n") == "ab\n\f\nen\n\f\na"
    writers.write_txt(df, str(folder / "txt"), "doc_id")
    assert {r.name: r.text for r in packs.read_pack(spark, str(folder / "txt")).collect()} == {"1.txt": "⠁⠃\n\f\n⠑⠝", "2.txt": "⠁"}


def test_batches_are_appended_once(spark, folder):
    df = spark.createDataFrame([(1, "manual", ["A"]), (2, "pdf", [])], "doc_id int, source_type string, tags array<string>")
    path = str(folder / "lib")
    writers.append_documents(df, path, 0)
    writers.append_documents(df.withColumn("doc_id", F.col("doc_id") + 10), path, 1)
    writers.append_documents(df.withColumn("doc_id", F.col("doc_id") + 20), path, 1)  # the batch again, after a failure
    assert sorted(r.doc_id for r in writers.read_library(spark, path).collect()) == [1, 2, 21, 22]


def test_packs(spark, folder):
    path = str(folder / "pack")
    docs = spark.range(0, 5000, 1, 20).select(
        F.concat(F.lit("n"), F.col("id")).alias("name"), F.when(F.col("id") % 7 == 0, None).otherwise(F.repeat(F.lit("ü☃x"), (F.col("id") % 50).cast("int"))).alias("text")
    )
    packs.write_pack(docs, path, 6)
    files = list((folder / "pack").glob("*.pack"))
    assert len(files) == 6 and len(packs.manifest_of(path)["parts"]) == 6
    got = {r.name: r.text for r in packs.read_pack(spark, path).collect()}
    assert got == {r.name: r.text or "" for r in docs.collect()}
    assert packs.fetch(path, "n51") == "ü☃x".encode() and packs.fetch(path, "n49") == b"" and packs.fetch(path, "m") is None
    one = packs.read_pack(spark, path, "n52")
    assert one.rdd.getNumPartitions() == 1 and [r.text for r in one.collect()] == ["ü☃xü☃x"]
    # files of tasks that no manifest names are not read; appended records are
    (folder / "pack" / "part-lost.pack").write_bytes(b"half")
    packs.write_pack(spark.createDataFrame([("n51", "again"), (None, None)], "name string, text string"), path, 6, "append")
    assert packs.read_pack(spark, path).count() == 5002 and packs.read_pack(spark, path, "n51").count() == 2
    packs.write_pack(docs.limit(0), path, 2)
    assert packs.read_pack(spark, path).count() == 0 and packs.fetch(path, "n1") is None


def test_stream_equals_batch(spark, folder):
    docs = library_docs(spark, SF_DIR).select("doc_id", "user_id", "file_name", "original_text", "source_type")
    docs.write.parquet(str(folder / "in"))
    jobs.stream_convert(spark, str(folder / "in"), str(folder / "out"), str(folder / "cp")).awaitTermination()
    streamed = writers.read_library(spark, str(folder / "out"))
    batch = jobs.convert_columns(docs)
    assert streamed.count() == batch.count()
    assert streamed.select(*batch.columns).exceptAll(batch).isEmpty()
    # a second run over the same files converts nothing again
    jobs.stream_convert(spark, str(folder / "in"), str(folder / "out"), str(folder / "cp")).awaitTermination()
    assert writers.read_library(spark, str(folder / "out")).count() == batch.count()


def test_reading_order_is_a_permutation(spark):
    o = LA.reading_order(PS._pages(spark, SF_DIR))
    assert o.select("page_no").distinct().count() > 1
    bad = o.groupBy("doc_id", "page_no").agg(F.count("*").alias("n"), F.count_distinct("ord").alias("d"), F.max("ord").alias("m")).filter("n <> d OR m <> n - 1")
    assert bad.isEmpty()


def test_every_leaf_is_aligned_once(spark):
    d = PS._attachable(spark, SF_DIR)
    got = A.attach_braille(d)
    nodes = d.selectExpr("sum(size(tree) + aggregate(tree, 0, (a, b) -> a + size(b.children))) n").first().n
    assert got.count() == nodes == got.select("doc_id", "id").distinct().count()


def test_review_pages_keep_every_chunk(spark):
    p = PS._pairs(spark, SF_DIR).withColumn("r", A.review_pages(S.pages_by_blocks(F.col("text")), F.col("braille")))
    shown = F.array_join(F.filter(F.transform("r", lambda x: x["braille"]), lambda b: b != ""), "\n\n")
    assert p.filter((F.size("r") > 1) & (shown != F.array_join(A.paragraphs(F.col("braille")), "\n\n"))).isEmpty()


def test_token_counterparts(spark):
    df = spark.createDataFrame([(1, "a b c", "x y")], "k int, o string, b string")
    rows = A.align_tokens(df, "k", "o", "b").filter("token_index IS NOT NULL").orderBy("side", "token_index").collect()
    assert [(r.side, r.counterpart_index, r.degraded) for r in rows] == [
        ("braille", 0, True), ("braille", 1, True), ("original", 0, True), ("original", 0, True), ("original", 1, True),
    ]


def test_equation_features(apply):
    line, parabola, circle, other = apply(E.equation_features, ["y = x + 2", "y = x^2 - 4", "(x - 1)^2 + (y + 2)^2 = 9", "y = x^3"])
    assert (line.type, line.slope, line.y_intercepts[0].y, line.x_intercepts[0].x) == ("line", 1.0, 2.0, -2.0)
    assert (parabola.vertex.y, [p.x for p in parabola.x_intercepts], parabola.opens) == (-4.0, [-2.0, 2.0], "up")
    assert (circle.center.x, circle.center.y, circle.radius, other.type) == (1.0, -2.0, 3.0, "polynomial")


def test_graph_payload(spark):
    raw = {"graph_type": "linear", "confidence": "high", "equation_text": "y = x + 2", "key_features": {"x_intercepts": ["(-2, 0)", {"x": -2}]}}
    df = spark.createDataFrame([(1, "```json\n" + json.dumps(raw) + "\n```")], "id int, json string")
    r = GO.normalize_payloads(df, "json").first()
    assert (r.graph_type, r.confidence, r.features.slope) == ("line", 0.92, 1.0)
    assert len(r.features.x_intercepts) == 1 and r.features.increasing_intervals == ["all real x"]
    assert r.summary == "straight line rising from left to right"
    paragraphs = r.natural_description.split("\n\n")
    assert paragraphs[0] == (
        "This graph shows a straight line rising from left to right. As x increases, y increases at a constant rate. "
        "For every increase of 1 in x, y increases by 1."
    )
    assert paragraphs[1] == (
        "It crosses the y-axis at (0, 2), meaning when x is zero, y is 2. It crosses the x-axis at (-2, 0), meaning when y is zero, x is -2."
    )
    assert paragraphs[2:] == ["Example points include (-2, 0), (0, 2), and (2, 4).", "The equation of the graph is y = x + 2."]
    assert r.compact_description.split("\n")[0] == "Straight line rising from left to right."
    assert "crosses x-axis at (-2, 0)" in r.relations
    again = spark.createDataFrame([(r.natural_description, r.compact_description)], "n string, c string")
    assert again.select(G.is_well_formed(F.col("n")), G.is_well_formed(F.col("c"), True)).first() == (True, True)


def test_block_tree_of_three_levels(spark):
    rows = [(1, "a", None, 0, "T"), (1, "b", "a", 0, "M"), (1, "c", "b", 1, "two"), (1, "d", "b", 0, "one"), (1, "e", "a", 1, "last")]
    tree = spark.createDataFrame(rows, "doc_id int, id string, parent_id string, ord int, content string")
    tree = tree.withColumn("type", F.lit("paragraph")).withColumn("mode", F.lit("text"))
    got = {r.id: r.braille for r in S.transcode_blocks(tree).collect()}
    assert got["b"] == "⠕⠝⠑\n\n⠞⠺⠕" and got["a"] == got["b"] + "\n\n⠇⠁⠎⠞"
