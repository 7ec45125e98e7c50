"""Secret scans that link the parts of a credential.

Strong patterns (assignments, access ids, long hexadecimal runs) are found by themselves. Weak
candidates, such as a mixed string that may be a secret key, an account id or an endpoint, mean
nothing alone: they are reported only when complementary parts co-occur. Parts are joined by
interval: two parts are linked when they lie within ``REACH`` code points of the same document.
Positions are cut into scopes of that size, so a weak part only meets the parts of its own scope
and of the two beside it, and a scope holds no more parts than fit into so many code points.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteplan_spark.llm.common import cut_lineage

#: Code points between two parts that belong together, at most.
REACH = 200

#: Base kinds, in the order in which equal starts are listed.
KINDS = ("assign", "access", "hex", "secret_key", "account", "endpoint")
_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
#: Weak candidates. A secret key is a 40-character string with all three kinds of characters.
_SECRET_KEY = re.compile(r"(?<![A-Za-z0-9+/=])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=])")
_ACCOUNT = re.compile(r"(?i:\b(?:user(?:name)?|account|client_id|login))\x20*[:=]\x20*"
                      r"""["']?([A-Za-z0-9_.@-]{3,64})""")
_ENDPOINT = re.compile(r"\b(?:https?|s3|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb(?:\+srv)?|redis|"
                       r"amqps?|ftp)://[^\s\"'<>]{4,200}")

#: What a kind stands for: a weak kind is reported with one of the roles that complete it.
IDENTIFIER, SECRET, PLACE = "identifier", "secret", "endpoint"
ROLES = {"assign": SECRET, "access": IDENTIFIER, "hex": SECRET, "secret_key": SECRET,
         "account": IDENTIFIER, "endpoint": PLACE}
NEEDS = {"secret_key": (IDENTIFIER,), "account": (SECRET,), "endpoint": (SECRET, IDENTIFIER)}


def parts_of(text: str) -> Iterator[tuple[str, int, int]]:
    """(kind, start, end) of all base spans and weak candidates, in code points."""
    for m in _ASSIGN.finditer(text):
        if m.end(2) - m.start(2) >= 6:
            yield "assign", *m.span()
    for m in _ACCESS.finditer(text):
        yield "access", *m.span()
    for m in _HEX.finditer(text):
        yield "hex", *m.span()
    if "://" in text:
        for m in _ENDPOINT.finditer(text):
            yield "endpoint", *m.span()
    for m in _SECRET_KEY.finditer(text):
        s = m.group()
        if any(c.isdigit() for c in s) and any(c.islower() for c in s) and any(
                c.isupper() for c in s):
            yield "secret_key", *m.span()
    for m in _ACCOUNT.finditer(text):
        yield "account", *m.span()


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        row, kind, start, end = [], [], [], []
        for i, text in enumerate(batch.column(1)):
            for k, a, b in parts_of(text.as_py() or ""):
                row.append(batch.column(0)[i].as_py())
                kind.append(k)
                start.append(a)
                end.append(b)
        yield pa.record_batch({"row": pa.array(row, pa.int64()), "kind": pa.array(kind, pa.string()),
                               "start": pa.array(start, pa.int64()),
                               "end": pa.array(end, pa.int64())})


def find_parts(rows: DataFrame) -> DataFrame:
    """(row, kind, start, end) for rows (row long, text)."""
    return rows.mapInArrow(_scan, "row long, kind string, start long, end long")


def linked_parts(parts: DataFrame, reach: int = REACH) -> DataFrame:
    """``parts`` that are reported: all base kinds, and weak ones whose complement is near.

    The interval join: parts are listed once for each row and scope of ``reach`` code points
    that they touch, a weak part looks up the scopes that its reach touches, and the distance is
    then compared. Each weak part is reported once, however many complements it has.
    """
    roles = F.create_map(*[F.lit(x) for kv in ROLES.items() for x in kv])
    placed = parts.withColumn("role", roles[F.col("kind")])
    weak = placed.where(F.col("kind").isin(*NEEDS))
    strong = placed.where(~F.col("kind").isin(*NEEDS))
    # complements: base parts, and weak parts of another role
    scopes = (placed.select("row", "role", "start", "end", F.explode(F.sequence(
                  F.floor(F.col("start") / reach), F.floor((F.col("end") - 1) / reach)))
                  .alias("scope")).groupBy("row", "scope", "role")
              .agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("near")))
    needs = F.create_map(*[x for k, v in NEEDS.items()
                           for x in (F.lit(k), F.array(*map(F.lit, v)))])
    touched = weak.select(
        "row", "kind", "start", "end", F.explode(F.sequence(
            F.floor((F.col("start") - reach) / reach), F.floor((F.col("end") + reach) / reach)))
        .alias("scope"), needs[F.col("kind")].alias("needs"))
    met = touched.join(scopes, ["row", "scope"]).where(
        F.array_contains("needs", F.col("role")) & F.exists("near", lambda p: (
            (p["start"] - F.col("end") <= reach) & (F.col("start") - p["end"] <= reach)
            & ((p["end"] <= F.col("start")) | (p["start"] >= F.col("end"))))))
    named = met.select("row", "kind", "start", "end").distinct()
    return strong.select("row", "kind", "start", "end").unionByName(named)


def scan_credentials(docs: DataFrame, id_col: str, text_col: str, reach: int = REACH) -> DataFrame:
    """(id, spans array<struct<start, kind, end>>): reported spans by start, then kind.

    One row for each id; rows that repeat an id are taken together. A null text has no spans,
    neither has an empty one. Rows without an id give one row with a null id. Only the two
    named columns are read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("row"), F.col(text_col).alias("text"))
    found = linked_parts(cut_lineage(find_parts(rows)), reach)
    rank = F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)])
    spans = found.groupBy("row").agg(F.sort_array(F.collect_set(F.struct(
        "start", rank[F.col("kind")].alias("rank"), "kind", "end"))).alias("spans"))
    ids = docs.select(F.col(id_col).cast("long").alias("row")).distinct()
    return ids.join(spans, ids["row"].eqNullSafe(spans["row"]), "left").select(
        ids["row"].alias("id"), F.coalesce("spans", F.array().cast(spans.schema["spans"].dataType))
        .alias("spans"))
