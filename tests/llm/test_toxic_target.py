"""Planted toxic documents leave the mixing stage, clean ones stay."""

import random

import numpy as np
import pytest

import corpus_pipeline
from siteplan_spark.llm import soft_mixing
from tests.llm.helpers import documents, prose


@pytest.mark.parametrize("n_toxic", [60, 6])
def test_planted_toxic_documents_leave(spark, tmp_path, n_toxic):
    rng = random.Random(21)
    clean = [(i, prose(rng, 60)) for i in range(300)]
    toxic = [(1000 + i, prose(rng, 50) + " vile foul scum" * 2) for i in range(n_toxic)]
    known = [(i, 1, 0) for i, _ in clean[::2]] + [(i, 1, 1) for i, _ in toxic[::2]]
    spark.createDataFrame(known, "doc_id long, quality int, toxic int").write.parquet(
        str(tmp_path / "labels.parquet"))
    docs = documents(spark, clean + toxic)
    kept = [r.doc_id for r in corpus_pipeline.mix(spark, docs, str(tmp_path)).collect()]
    assert not [i for i in kept if i >= 1000]
    assert len(set(kept)) >= 295


def test_nothing_is_banned_without_labels(spark):
    docs = documents(spark, [prose(random.Random(i), 40) for i in range(20)])
    weights = np.zeros((soft_mixing.BUCKETS + 1, len(soft_mixing.DOMAINS)))
    got = soft_mixing.soft_mixing(docs, "doc_id", "text", weights, {"clean": 1.0}).collect()
    assert all(r.rate > 0 for r in got)


def test_columns_with_working_names_survive_the_mixture(spark):
    docs = documents(spark, ["one two", None, "", "one two"]).selectExpr(
        "doc_id", "text", "1 AS _copies", "2 AS _fence", "3 AS row", "4 AS copies", "5 AS col")
    equal = {d: 1 / 3 for d in soft_mixing.DOMAINS}
    weights = np.zeros((soft_mixing.BUCKETS + 1, len(soft_mixing.DOMAINS)))
    taken = soft_mixing.take_mixture(docs, "doc_id", "text", weights, equal)
    assert taken.columns == docs.columns
    assert sorted(map(str, taken.collect())) == sorted(map(str, docs.collect()))
