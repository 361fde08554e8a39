"""Encoding, decoding and counting against the tokenizers library."""

from hashlib import sha256

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from conftest import SF_DIR
from dotloom.llm import bpe, pretokens as pre, queries, tokencount

ODD = [
    "", " ", "  ", "a", " a", "a ", "a  b", "a   b\n\n c", "\n", "\n \n", "it's I'll we'd", "x y   z", "\x1c a\x1d b \x85c",
    "aaaaaaa aaaa aaa", "<|endoftext|>", "a<|endoftext|> b<|endoftext|><|endoftext|>c", "a <|endoftext|>", "日本語 テキスト 한국어 ١٢٣ ²½Ⅷ",
    "é 👩‍👩‍👧 ✨✨", "word," * 300, "x" * 3000, "日" * 700, "� ﻿​", "Hello   world\t\ttabs \r\n end  ", "'s's 'S '' ' s", "ſt ß Ÿ",
]


@pytest.fixture(scope="module")
def lib():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.no_truncation()
    t.no_padding()
    return t


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids string")


def test_encode_matches_library(spark, lib):
    got = {r.doc_id: r for r in bpe.encode_documents(frame(spark, [*ODD, None])).collect()}
    for i, t in enumerate([*ODD, ""]):
        assert got[i].ids == lib.encode(t, add_special_tokens=False).ids, repr(t)
        assert got[i].n_tokens == len(got[i].ids)


def test_decode_returns_text(spark, lib):
    df = bpe.decode_documents(bpe.encode_documents(frame(spark, [*ODD, None])))
    assert {r.doc_id: r.text for r in df.select("doc_id", "text").collect()} == dict(enumerate([*ODD, ""]))
    broken = spark.createDataFrame([([160, 50256, 245],), (None,), ([],)], "ids array<int>")
    assert [r.text for r in bpe.decode_documents(broken).collect()] == [lib.decode([160, 50256, 245], skip_special_tokens=False), "", ""]


def test_counts_match_library(spark, lib):
    got = {r.doc_id: r for r in tokencount.count_tokens(frame(spark, [*ODD, None])).collect()}
    for i, t in enumerate([*ODD, ""]):
        assert got[i].n_tokens == len(lib.encode(t, add_special_tokens=False).ids), repr(t)
        assert got[i].n_bytes == len(t.encode())
        assert got[i].over_limit == (got[i].n_tokens > 512)


def test_empty_table(spark):
    none = frame(spark, ["x"]).limit(0)
    assert bpe.encode_documents(none).count() == tokencount.count_tokens(none).count() == 0


def test_queries(spark, lib):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    one = {r.doc_id: r for r in queries.op1_bpe(spark, SF_DIR).collect()}
    two = {r.doc_id: r for r in queries.op2_token_counts(spark, SF_DIR).collect()}
    assert one.keys() == two.keys() == texts.keys()
    for i, t in texts.items():
        ids = lib.encode(t, add_special_tokens=False).ids
        assert (one[i].n_tokens, one[i].ids_sha256) == (len(ids), sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert one[i].decoded_sha256 == sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()
        assert two[i].n_tokens == len(ids)


def test_words_are_cut_and_looked_up_once(lib, monkeypatch):
    """Letters with a sign behind them are cut without the pattern; every byte of the sorted words is one move."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    for chunk in ["word", "Été", "ªa", "a'", "don't", "x.", "x..", "1", "a1", "'", ".", "", "a\n", "ß—"]:
        cut = None if pre.UNUSUAL.search(chunk) else pre.letters_cut(chunk)
        assert cut is None or cut == [f" {chunk}"[a:b] for _, (a, b) in lib.pre_tokenizer.pre_tokenize_str(f" {chunk}")], chunk
    asked = []
    monkeypatch.setattr(pre, "pretokens", lambda c, p, f=pre.pretokens: asked.append(c) or f(c, p))
    enc, text = bpe.Encoder(path), "a zwölf words, words; and zwölfte ones. b2"
    assert enc.encode([text])[0].tolist() == lib.encode(text, add_special_tokens=False).ids
    assert sorted(asked) == [" b2", "a"]


def test_tokens_that_end_at_a_prefix(lib):
    """The automaton's tokens are all those that the read bytes end with, longest first."""
    enc = bpe.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    word, node = " unbelievable—日本".encode(), 0
    for i, b in enumerate(word):
        node = enc._from(node, b)
        ends = [enc.ids[word[k : i + 1]] for k in range(i + 1) if word[k : i + 1] in enc.ids]
        assert [t for t, _ in enc.ends[node]] == ends and [n for _, n in enc.ends[node]] == [len(enc.bytes[t]) for t in ends]
