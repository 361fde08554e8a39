"""The pipeline: every stage on odd rows against brute force, and the whole on a given table."""

import corpus_pipeline
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from conftest import SF_DIR
from dotloom.llm import pretokens
from dotloom.llm.common import written
from test_linededup import brute as brute_lines
from test_ngramjoin import brute as brute_groups

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def test_stages_follow_each_other(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    kept = {}
    for name, f in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, written(f(spark, docs, SF_DIR))
        assert docs.columns == COLUMNS
        kept[name] = {r.doc_id: r.text for r in docs.collect()}
        was = {r.doc_id: r.text for r in before.collect()}
        if name == "language":
            assert kept[name].keys() == {i for i, t in was.items() if any(map(str.isalpha, t or ""))}
        if name == "line_dedup":
            want = brute_lines(list(was.items()), 20)
            assert kept[name] == {i: t for i, t in want.items() if t.strip(" ") or t == was[i]}
        if name == "near_duplicates":
            groups = brute_groups(list(was.items()), 5, 80, 100)
            assert kept[name].keys() == {i for i, (_, least) in groups.items() if i == least}
        if name == "mixing":
            assert 0.3 * len(was) < len(kept[name]) < 0.7 * len(was)
    lib = Tokenizer.from_file(pretokens.default_vocabulary())
    out = stage("bpe")(spark, docs, SF_DIR).collect()
    assert {r.doc_id: r.ids for r in out} == {i: lib.encode(t, add_special_tokens=False).ids for i, t in kept["mixing"].items()}
    assert {r.doc_id for r in corpus_pipeline.run(spark, SF_DIR).collect()} == kept["mixing"].keys()


def test_odd_rows(spark):
    rows = [(1, None, "en", "a"), (2, "", None, None), (3, "12 34", "en", "a"), (4, "some words in english here", "en", "a"),
            (4, "some words in english here", "en", "a"), (None, "des mots en français ici même", "fr", "b"), (5, "x " * 9000, None, "a")]
    docs = spark.createDataFrame([(*r, len(r[1] or ""), 0.1, 7, "x", "y") for r in rows],
        "doc_id long, text string, lang string, source string, n_chars long, score double, n_tokens long, doc string, Ratio string")
    for name, f in corpus_pipeline.STAGES[:-1]:
        own = f(spark, docs, SF_DIR)
        assert own.columns == docs.columns and own.count() <= len(rows), name
        assert {(r.score, r.n_tokens, r.doc, r.Ratio) for r in own.collect()} <= {(0.1, 7, "x", "y")}, name
        assert f(spark, docs.limit(0), SF_DIR).count() == 0, name
    assert sorted(r.doc_id or 0 for r in stage("language")(spark, docs, SF_DIR).collect()) == [0, 4, 4, 5]
    assert sorted(r.doc_id or 0 for r in stage("near_duplicates")(spark, docs, SF_DIR).collect()) == [0, 1, 2, 3, 4, 5]
    assert stage("bpe")(spark, docs, SF_DIR).where(F.size("ids") == 0).count() == 2
