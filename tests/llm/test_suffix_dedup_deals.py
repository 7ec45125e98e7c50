"""The runs around repeated anchors are dealt to shards once, hot anchors or not."""

import random
import re

import pytest

from siteplan_spark.llm import suffix_dedup
from tests.llm.helpers import documents, prose


@pytest.mark.parametrize("hot", [suffix_dedup.HOT, 3])
def test_runs_are_shuffled_once(spark, monkeypatch, hot):
    rng = random.Random(31)
    shared = prose(rng, 40)
    rows = [(i, prose(rng, 15) + shared[:180 + i] + prose(rng, 20)) for i in range(25)]
    plans, cut = [], suffix_dedup.cut_lineage

    def recorded(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return cut(df)
    monkeypatch.setattr(suffix_dedup, "cut_lineage", recorded)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables beyond it
    try:
        found = suffix_dedup.remove_repeats(documents(spark, rows), "doc_id", "text", hot).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert sum(len(r.spans) for r in found) >= 24
    dealt = [set(re.findall(r"hashpartitioning\((b#\d+L?, [^)]*)\)", p)) for p in plans]
    assert max(map(len, dealt)) == 1
