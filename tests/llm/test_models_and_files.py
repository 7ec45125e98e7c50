"""Mixing, records, languages, licences, URLs, and the pipeline."""

import random
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from siteplan_spark.llm import (
    byte_cnn,
    license_classifier,
    queries,
    soft_mixing,
    token_records,
    url_markov,
)
from tests.llm.helpers import awkward, documents, prose
from tests.oracle import compare, connect

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_query_matches_sql(spark, name):
    ok, note = compare(spark, connect(FOLDER), name, FOLDER)
    assert ok, note


# --- mixing -------------------------------------------------------------------------------

def _labelled(rng):
    rows = [prose(rng, 30) for _ in range(30)] + [prose(rng, 30) + " vile foul" for _ in range(15)]
    rows += ["### " * 10 + prose(rng, 10) for _ in range(15)]
    labels = [(i, 1, 0) for i in range(30)] + [(i, 1, 1) for i in range(30, 45)]
    return rows, labels + [(i, 0, 0) for i in range(45, 60)] + [(None, 1, 0), (3, None, None)]


def test_rates_meet_targets(spark):
    rows, labels = _labelled(random.Random(1))
    docs = documents(spark, rows + [(100, None), (101, ""), (None, rows[0]), (102, rows[0])])
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    weights = soft_mixing.train(docs, "doc_id", "text", lab, "doc_id", "quality", "toxic")
    share = {"clean": 0.8, "low": 0.1, "toxic": 0.1}
    got = soft_mixing.soft_mixing(docs, "doc_id", "text", weights, share).collect()
    assert len(got) == 64
    total = sum(r.tokens for r in got)
    for d, name in enumerate(soft_mixing.DOMAINS):
        assert abs(sum(r.rate * r.tokens * r.p[d] for r in got) / total - share[name]) < 1e-3
    assert all(r.rate >= 0 for r in got)
    right = sum(np.argmax(r.p) == (0 if r.id < 30 else 2 if r.id < 45 else 1)
                for r in got if r.id is not None and r.id < 60)
    assert right >= 57


def test_rates_are_projected_gradient():
    """Replayed rates solve the small problem as a plain projected gradient does."""
    rng = np.random.default_rng(2)
    p = rng.dirichlet([0.3, 0.3, 0.3], 40)
    w = rng.random(40)
    w /= w.sum()
    goal, residuals = np.array([0.7, 0.2, 0.1]), np.empty((0, 3))
    for _ in range(400):
        point = soft_mixing.replay(p, residuals)[1]
        residuals = np.vstack([residuals, (w * point) @ p - goal])
    fast = soft_mixing.replay(p, residuals)[0]
    plain = np.ones(40)
    for _ in range(20_000):
        plain = np.maximum(0, plain - (p @ ((w * plain) @ p - goal)
                                       + soft_mixing.DAMPING * (plain - 1)))
    assert np.abs((w * fast) @ p - (w * plain) @ p).max() < 1e-3


def test_mixing_without_labels_or_rows(spark):
    docs = documents(spark, awkward(random.Random(3)))
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    weights = soft_mixing.train(docs, "doc_id", "text", none, "doc_id", "quality", "toxic")
    got = soft_mixing.soft_mixing(docs, "doc_id", "text", weights, {"clean": 1.0}).collect()
    assert len(got) == docs.count() and all(abs(sum(r.p) - 1) < 1e-9 for r in got)
    taken = soft_mixing.take_mixture(docs.limit(0), "doc_id", "text", weights, {"clean": 1.0})
    assert taken.count() == 0 and taken.columns == docs.columns


# --- records ------------------------------------------------------------------------------

def test_records_round_trip(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = awkward(random.Random(4)) + [
        (20, "<|endoftext|> it's"), (21, "a\x85b\xa0c'll ½²"), (22, "İΣΑΣ ŉ ﬁ é ́x"), (-3, "minus")]
    docs = documents(spark, rows)
    shards = token_records.write_token_records(docs, "doc_id", "text", path, 2).cache()
    got = token_records.read_in_order(shards).collect()
    tokenizer = Tokenizer.from_file(path)
    want = []
    for d, t in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [2]
        want.append((d, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    key = lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])
    assert sorted(((r.key, r.n_tokens, r.ids_crc32) for r in got), key=key) == sorted(want, key=key)
    ordered = sorted(got, key=lambda r: r.start)
    assert [r.key is not None for r in ordered] == sorted(r.key is not None for r in ordered)
    keys = [r.key for r in ordered if r.key is not None]
    assert keys == sorted(keys)
    assert [r.start for r in ordered] == list(np.cumsum([0] + [r.n_tokens for r in ordered[:-1]]))
    mixed = token_records.read_shuffled(spark, shards, 5).collect()
    assert sorted(len(r.ids) for r in mixed) == sorted(w[1] for w in want)
    assert [r.key for r in mixed] != [r.key for r in ordered]


def test_broken_record_is_noticed(spark):
    docs = documents(spark, ["some words", "more words"])
    shards = token_records.write_token_records(
        docs, "doc_id", "text", public_tokenizers.path("word_bpe_49k.json"), 2).cache()
    path = Path(shards.first().bin.removeprefix("file:"))
    data = bytearray(path.read_bytes())
    data[25] ^= 1
    path.write_bytes(bytes(data))
    with pytest.raises(Exception, match="broken record"):
        token_records.read_in_order(shards).collect()


def test_records_of_an_empty_table(spark):
    shards = token_records.write_token_records(
        documents(spark, []), "doc_id", "text", public_tokenizers.path("word_bpe_49k.json"), 2)
    assert token_records.read_in_order(shards).count() == 0


# --- languages ----------------------------------------------------------------------------

def test_slopes_match_differences():
    net = byte_cnn.Network(["a", "b"])
    net.weights = {k: v.astype(np.float64) for k, v in net.weights.items()}
    rng = np.random.default_rng(1)
    x, label = rng.integers(0, 257, (5, 20)), np.array([0, 1, 1, 0, 1])
    loss = lambda: -net.log_softmax(net.maxima(x)[0])[np.arange(5), label].mean()
    slopes = net._slopes(x, label)
    for name, at in (("embedding", (int(x[0, 3]), 2)), ("filter3", (5, 4)), ("shift2", (3,)),
                     ("out", (7, 1)), ("bias", (0,))):
        old, sides = net.weights[name][at], []
        for step in (1e-5, -1e-5):
            net.weights[name][at] = old + step
            sides.append(loss())
        net.weights[name][at] = old
        assert abs((sides[0] - sides[1]) / 2e-5 - slopes[name][at]) < 1e-4


def test_held_out_accuracy(spark):
    found = queries.QUERIES["op9_byte_cnn"](spark, "/root/testdata/sf0.01")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    held = found.where("held_out").join(docs, "doc_id").collect()
    assert all((zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in held)
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.95


def test_languages_of_awkward_rows(spark):
    docs = documents(spark, [(0, None), (1, ""), (2, "12 34 !!"), (3, "hello"), (None, "hello"),
                             (3, "hello")])
    assert byte_cnn.train_network(docs, "doc_id", "text", "lang") is None
    got = byte_cnn.identify_languages(docs, "doc_id", "text", None).collect()
    assert [(r.lang, r.score) for r in got] == [("und", 0.0)] * 6
    net = byte_cnn.Network(["xx", "yy"])
    got = byte_cnn.identify_languages(docs, "doc_id", "text", net).collect()
    assert [r.lang == "und" for r in got] == [True] * 3 + [False] * 3
    assert all(0 <= r.score <= 1 for r in got)


def test_windows_cover_the_text():
    text = bytes(range(256)) * 3 + b"xyz"
    x = byte_cnn.windows_of(text)
    assert bytes(v for v in x.reshape(-1).tolist() if v < 256) == text
    assert byte_cnn.windows_of(b"").shape == (1, byte_cnn.WINDOW)


# --- licences -----------------------------------------------------------------------------

def test_licences(spark):
    rng = random.Random(5)
    rows = [prose(rng, 60) for _ in range(40)] + [
        (100, prose(rng, 20) + "\nReleased under the MIT License.\n" + prose(rng, 20)),
        (101, "Licensed under the Apache License, Version 2.0."),
        (102, None), (103, ""), (None, "Licensed under CC BY-NC 4.0."),
        (104, "licensed UNDER the apache license version 2 0"), (105, "see the licence file")]
    docs = documents(spark, rows)
    model = license_classifier.train(docs, "doc_id", "text")
    got = license_classifier.scan_licences(docs, "doc_id", "text", model).where("confirmed").collect()
    assert sorted((str(r.id), r.paragraph, r.family) for r in got) == [
        ("100", 2, "mit"), ("101", 0, "apache-2.0"), ("104", 0, "apache-2.0"),
        ("None", 0, "cc-by-nc-4.0")]
    assert license_classifier.scan_licences(docs.limit(0), "doc_id", "text", model).count() == 0


# --- urls ---------------------------------------------------------------------------------

def test_url_rules_and_parts(spark):
    rows = [(0, None), (1, ""), (2, "no scheme/x"), (3, "http://WWW.Example.org/es/1?q#f"),
            (4, "https://a.example.org/en/12"), (5, "https://example.org?x"), (6, "ftp://x.com/fr/"),
            (7, "http://y.com/de/3#z"), (8, "http://notexample.org/es/1"), (None, "http://z.net/"),
            (9, "http://a://b/c"), (3, "http://WWW.Example.org/es/1?q#f")]
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in rows],
                                  "page_id long, url string, folded string, score string")
    got = {r.id: r for r in url_markov.filter_urls(pages, "page_id", "url",
                                                   queries.URL_RULES).collect()}
    assert (got[0].host, got[0].path, got[2].host) == ("", "", "")
    assert (got[3].host, got[3].path, got[3].rule, got[3].verdict) == (
        "www.example.org", "/es/1", "example.org/es/", "block")
    assert (got[4].rule, got[4].verdict) == ("example.org/en/1", "block")
    assert (got[5].host, got[5].path, got[5].rule) == ("example.org", "", None)
    assert (got[6].rule, got[7].rule, got[8].rule) == ("com/fr/", "com/de/", "org/")
    assert (got[9].host, got[9].path) == ("a:", "//b/c")
    assert got[None].verdict in ("allow", "block")
    assert url_markov.filter_urls(pages.limit(0), "page_id", "url", queries.URL_RULES).count() == 0


# --- pipeline -----------------------------------------------------------------------------

def test_pipeline_stages(spark):
    docs = corpus_pipeline.read_table(spark, FOLDER, "documents")
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.cut_lineage(stage(spark, docs, FOLDER))
        if name != "token_records":
            assert docs.columns == columns
        sizes.append(docs.count())
    assert sizes[0] > sizes[1] > sizes[2] >= sizes[3] > 0 and sizes[4] == sizes[5]
    assert docs.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_pipeline_on_awkward_rows(spark):
    rng = random.Random(6)
    docs = documents(spark, awkward(rng)).selectExpr(
        "doc_id", "text", "lang", "kind AS source", "key AS n_chars")
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.cut_lineage(stage(spark, docs, FOLDER))
    assert docs.count() > 0
    none = corpus_pipeline.read_table(spark, FOLDER, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        none = corpus_pipeline.cut_lineage(stage(spark, none, FOLDER))
    assert none.count() == 0
