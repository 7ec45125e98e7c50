"""Closed syncmers, zone clusters and the filter audit against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
from itertools import permutations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from siteplan_spark.llm import filter_audit, queries, syncmers, zone_clusters
from tests.llm.helpers import awkward, documents, prose
from tests.oracle import compare, connect

SMALL = "/root/testdata/sf0.001"


# --- closed syncmers --------------------------------------------------------------------------

def _hash(*parts) -> int:
    """Hashes of longs or strings chained as the engine chains columns, signed."""
    seed = 42
    for p in parts:
        data = p.encode() if isinstance(p, str) else p.to_bytes(8, "little", signed=True)
        seed = xxhash.xxh64_intdigest(data, seed)
    return seed - (1 << 64) if seed >> 63 else seed


def _tokens(text):
    spaceless = "฀-໿က-႟ក-៿぀-ヿ㐀-鿿豈-﫿"
    spaceless += "\U00020000-\U0003ffff"
    return re.findall(rf"[{spaceless}]|[^\x20\x09-\x0d{spaceless}]{{1,32}}", text)


def _anchors(text):
    h = [_hash(t) for t in _tokens(text)]
    if len(h) < syncmers.K:
        return [_hash(*h) >> 32] if h else []
    inner = [_hash(*h[i:i + syncmers.S]) for i in range(len(h) - syncmers.S + 1)]
    width = syncmers.K - syncmers.S + 1
    return [_hash(*h[i:i + syncmers.K]) >> 32 for i in range(len(h) - syncmers.K + 1)
            if min(inner[i:i + width]) in (inner[i], inner[i + width - 1])]


def _likeness(a, b):
    a, b = list(dict.fromkeys(a)), list(dict.fromkeys(b))
    if not a and not b:
        return 1.0
    moved = sorted(b.index(h) - i for i, h in enumerate(a) if h in b)
    slack = syncmers.SLACK + syncmers.SLACK_SHARE * min(len(a), len(b))
    middle = moved[len(moved) // 2] if moved else 0
    return 2.0 * sum(abs(d - middle) <= slack for d in moved) / (len(a) + len(b))


def _text_of(anchors):
    return "".join(f"{h & 0xFFFFFFFF:08x}" for h in anchors)


def _expected(rows):
    rows = {(i, t or "") for i, t in rows}
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), -_hash(r[1])))
    out = []
    for (i, t), (_, after) in zip(order, order[1:] + order[:1]):
        take = len(t) // 3
        edited = t[:len(t) - take] + after[:take]
        a, e = _anchors(t), _anchors(edited)
        out.append((i, len(t), _text_of(a), edited, _text_of(e), _likeness(a, e),
                    _likeness(a, _anchors(after))))
    return sorted(out, key=str)


def _found(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def _texts():
    rng = random.Random(21)
    base = prose(rng, 400)
    rows = [(i, t) if not isinstance(t, tuple) else t for i, t in enumerate(awkward(rng))]
    rows += [(100 + i, prose(rng, rng.randrange(1, 120))) for i in range(40)]
    rows += [(200 + i, base) for i in range(5)]  # copies under several ids
    rows += [(300, "漢字とかなの文章は空白なしで書かれる。" * 9), (301, "x" * 5000 + " end"),
             (302, prose(rng, 30) + "\n" + base), (303, "word " * 500), (-7, "a b c d e f g h")]
    return rows


def test_fingerprints_match_brute_force(spark):
    rows = _texts()
    got = syncmers.fingerprint_documents(documents(spark, rows).repartition(7), "doc_id", "text")
    assert _found(got) == _expected(rows)


def test_a_single_document_follows_itself_and_none_gives_none(spark):
    docs = documents(spark, ["one two three four five six seven eight nine ten"])
    assert _found(syncmers.fingerprint_documents(docs, "doc_id", "text")) == _expected(
        [(0, "one two three four five six seven eight nine ten")])
    none = syncmers.fingerprint_documents(documents(spark, []), "doc_id", "text")
    assert none.columns[0] == "id" and none.isEmpty()


def test_a_moved_passage_keeps_its_anchors(spark):
    rng = random.Random(5)
    base = prose(rng, 300)
    rows = [(base, prose(rng, 25) + " " + base), (base, prose(rng, 300))]
    df = spark.createDataFrame(rows, "x string, y string")
    df = syncmers.with_anchors(syncmers.with_anchors(df, F.col("x"), "a"), F.col("y"), "b")
    near, far = [r[0] for r in syncmers.with_likeness(df, "a", "b", "n").select("n").collect()]
    assert near > 0.85 and far < 0.05


def test_op11_on_the_given_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    want = [(i, n, hashlib.sha256(e.encode()).hexdigest(), f, g, x, y)
            for i, n, f, e, g, x, y in _expected(rows)]
    got = entry_module.queries()["op11_closed_syncmers"](spark, SMALL)
    assert got.columns == ["doc_id", "n_chars", "edited_sha256", "fingerprint",
                           "edited_fingerprint", "near_edited", "near_next"]
    assert _found(got) == sorted(want, key=str)


# --- zone clusters ----------------------------------------------------------------------------

def _vectors(spark, rows):
    return spark.createDataFrame([(i, v, "x", 3) for i, v in rows],
                                 "vec_id long, embedding array<float>, cluster string, n int")


def _lloyd(rows, k=16, rounds=3, dims=64):
    kept = []
    for i, v in rows:
        if v is not None and len(v) == dims and all(
                x is not None and abs(np.float32(x)) <= zone_clusters.LARGEST for x in v):
            x = np.array(v, np.float32).astype(np.float64)
            name = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
            kept.append((name, x.tolist(), i, [int(f) for f in np.floor(64 * x)]))
    first = sorted(kept, key=lambda r: r[:2])[:k]
    cents = [r[3] for r in first]

    def nearest(v):
        far = [sum((a - b) ** 2 for a, b in zip(v, c)) for c in cents]
        return far.index(min(far)), min(far)

    for _ in range(rounds):
        at = [nearest(r[3])[0] for r in kept]
        cents = [[sum(x) // len(own) for x in zip(*own)] if (own := [
            r[3] for r, a in zip(kept, at) if a == j]) else c for j, c in enumerate(cents)]
    at = [nearest(r[3]) for r in kept]
    per = [sum(d for a, d in at if a == j) for j in range(len(cents))]
    return sorted(((r[2], a, d, per[a], sum(per), cents[a]) for r, (a, d) in zip(kept, at)), key=str)


def _random_vectors(n, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(9, 64))
    return [(i, (centres[i % 9] + 0.2 * rng.normal(size=64)).tolist()) for i in range(n)]


def test_clusters_match_plain_lloyd(spark):
    rows = _random_vectors(900)
    rows += [(1000 + i, rows[0][1]) for i in range(300)] + [rows[5], (None, rows[7][1])]
    rows += [(2000, None), (2001, []), (2002, rows[0][1][:63]), (2003, [None] * 64),
             (2004, [float("nan")] * 64), (2005, [math.inf] * 64), (2006, [1e30] * 64),
             (2007, [-2e6] * 64), (2008, [0.0] * 64), (2009, [-0.001] * 64)]
    got = zone_clusters.cluster_vectors(_vectors(spark, rows).repartition(5), "vec_id", "embedding")
    assert _found(got) == _lloyd(rows)


@pytest.mark.parametrize("rows", [[], [(1, None)], _random_vectors(5)])
def test_few_vectors(spark, rows):
    got = zone_clusters.cluster_vectors(_vectors(spark, rows), "vec_id", "embedding")
    assert _found(got) == _lloyd(rows)


def test_hilbert_neighbours_are_one_step_apart():
    for dims, bits in ((2, 4), (3, 3), (5, 2)):
        axes = np.indices((1 << bits,) * dims).reshape(dims, -1).T
        keys = [bytes(k) for k in zone_clusters.hilbert_keys(axes, bits)]
        assert len(set(keys)) == len(keys)
        path = axes[sorted(range(len(keys)), key=keys.__getitem__)]
        assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_box_bounds_never_lose_the_nearest_centroid():
    rng = np.random.default_rng(8)
    for spread in (1, 5, 40):
        cents = rng.integers(-50, 50, (16, 64))
        v = rng.integers(-spread, spread + 1, (40, 64)) + cents[3] // 2
        near = zone_clusters.candidates(v.min(0), v.max(0), cents)
        k, far = zone_clusters.nearest(v, cents[near])
        whole = ((v[:, None] - cents) ** 2).sum(2)
        assert (near[k] == whole.argmin(1)).all() and (far == whole.min(1)).all()


# --- filter audit -----------------------------------------------------------------------------

def _fails(rows):
    """(part, failing letters) of each row, E by smaller ids with the same text."""
    out = []
    for i, t, part in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w),
             "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
             "D": bool(re.search("[#$%&*|]", t)),
             "E": any((u or "") == t and j is not None and (i is None or j < i)
                      for j, u, _ in rows)}
        out.append((part or "", {k for k, v in f.items() if v}))
    return out


def _audit(rows, labels):
    good = {i for i, q, _ in labels if q == 1}
    toxic = {i for i, _, x in labels if x == 1}
    facts = [(p, f, r[0] in good, r[0] in toxic) for r, (p, f) in zip(rows, _fails(rows))]
    out, removed = {}, {}
    for part in {f[0] for f in facts}:
        own = [f for f in facts if f[0] == part]
        for order in map("".join, permutations("ABCDE")):
            for s, name in enumerate(order):
                hit = [f for f in own if name in f[1] and not f[1] & set(order[:s])]
                removed[part, name] = removed.get((part, name), 0) + len(hit)
                out[part, order, s + 1] = [
                    sum(not f[1] & set(order[:s + 1]) for f in own), len(hit),
                    sum(name in f[1] for f in own) - len(hit),
                    sum(f[1] == {name} for f in own), sum(f[2] for f in hit),
                    sum(f[3] for f in hit)]
    return sorted((*k, *v, removed[k[0], k[1][k[2] - 1]]) for k, v in out.items())


def _audited(spark, rows, labels):
    docs = spark.createDataFrame(
        [(*r, 1, "x", 2) for r in rows],
        "doc_id long, text string, source string, n long, part string, good int")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    universe, failing = filter_audit.document_relations(docs, "doc_id", "text", "source", marks,
                                                        "doc_id", "quality", "toxic")
    return sorted(tuple(r) for r in filter_audit.audit_filters(universe, failing).collect())


def test_audit_matches_all_orders(spark):
    rng = random.Random(9)
    rows = [(i if not isinstance(t, tuple) else t[0], t if not isinstance(t, tuple) else t[1],
             rng.choice(["web", "book", None])) for i, t in enumerate(awkward(rng))]
    for i in range(60):
        text = prose(rng, rng.choice([30, 250, 260]))
        text = rng.choice([text, text.upper(), text + " #", ("go " * 300), rows[0][1]])
        rows.append((100 + i, text, rng.choice(["web", "book", None])))
    labels = [(100 + i, rng.randrange(2), rng.randrange(2)) for i in range(50)]
    labels += [(100, 1, 1), (100, None, None), (None, 1, 1), (5, 1, 0), (99999, 1, 1)]
    # a null label id matches no document
    assert _audited(spark, rows, labels) == _audit(rows, [x for x in labels if x[0] is not None])


def test_audit_of_an_empty_table(spark):
    assert _audited(spark, [], []) == []


@pytest.mark.parametrize("name", ["op12_zone_clusters", "op13_filter_audit"])
def test_new_queries_match_sql(spark, name):
    assert name in queries.ORACLES
    ok, note = compare(spark, connect(SMALL), name, SMALL)
    assert ok, note
