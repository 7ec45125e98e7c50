"""The registered queries of the corpus operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteplan_spark.llm import (
    benchmark_edits,
    byte_cnn,
    credential_links,
    filter_audit,
    license_classifier,
    line_cleaning,
    simhash_links,
    soft_mixing,
    suffix_dedup,
    syncmers,
    token_records,
    url_markov,
    zone_clusters,
)
from siteplan_spark.llm.common import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(run):
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run
    return register


@query("op7_simhash_components")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents", "doc_id", "text")
    found = simhash_links.simhash_components(docs, "doc_id", "text")
    return found.select(F.col("id").alias("doc_id"),
                        F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"),
                        F.col("component").alias("component_id"))


@query("op3_benchmark_edits")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    found = benchmark_edits.find_leaks(
        read_table(spark, folder, "documents", "doc_id", "text"), "doc_id", "text",
        read_table(spark, folder, "benchmark"), "item_id", "text")
    return found.withColumnRenamed("id", "doc_id")


_OP6 = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS g
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d)),
rep AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
cov AS (SELECT doc_id, sum(coalesce(least(8, nxt - i), 8)) AS n
        FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM rep)
        GROUP BY doc_id),
lines AS (SELECT doc_id, l, len(regexp_extract_all(l, '[^\x20\x09-\x0D]+')) AS n
          FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d)),
judged AS (
  SELECT *, 2 * len(regexp_extract_all(l, '[#*$%&|<>{}~^]')) >= n
         OR n >= 3 AND 2 * len(regexp_extract_all(l, '[A-ZÀ-ÖØ-Þ]{2,}')) >= n
         OR len(regexp_extract_all(l, '[|•·»]')) >= 3
         OR n <= 20 AND regexp_matches(lower(l), 'all rights reserved|privacy policy|terms of (use|service)|cookie|javascript|click here|subscribe|log ?in|sign ?(in|up)|lorem ipsum')
         OR NOT regexp_matches(l, '[.!?:;…"”’»)\]][\x20\x09-\x0D]*\z') AS bad
  FROM lines WHERE n > 0),
per AS (SELECT doc_id, count(*) - count(DISTINCT l) AS dup,
               sum(CASE WHEN bad THEN n ELSE 0 END) AS lost
        FROM judged GROUP BY doc_id),
f AS (SELECT doc_id, t, len(w) AS n_words, coalesce(n, 0) AS n_rep, coalesce(dup, 0) AS dup,
             coalesce(lost, 0) AS lost
      FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN per USING (doc_id))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words,
       CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
       CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
       CAST(dup AS BIGINT) AS n_dup_lines, CAST(n_rep AS BIGINT) AS n_repeat_words,
       n_words < 20 OR 100 * n_rep > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_rep > 30 * n_words) AND 100 * lost <= 60 * n_words AS kept,
       CAST(lost AS BIGINT) AS n_lost
FROM f"""


@query("op6_line_cleaning", _OP6)
def op6(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents", "doc_id", "text")
    found = line_cleaning.measure_lines(docs, "text")
    names = ("n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept "
             "n_lost").split()
    return found.select("doc_id", *[F.col(f"line_cleaning.{n}") for n in names])


@query("op8_token_records")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents", "doc_id", "text")
    shards = token_records.write_token_records(
        docs, "doc_id", "text", public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return token_records.read_in_order(shards).withColumnRenamed("key", "doc_id")


#: Wanted shares of expected tokens.
MIXTURE = {"clean": 0.96, "low": 0.01, "toxic": 0.03}


@query("op1_soft_mixing")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents", "doc_id", "text")
    weights = soft_mixing.train(docs, "doc_id", "text", read_table(spark, folder, "labels"),
                                "doc_id", "quality", "toxic")
    found = soft_mixing.soft_mixing(docs, "doc_id", "text", weights, MIXTURE)
    return found.select(F.col("id").alias("doc_id"), F.col("tokens").alias("n_tokens"),
                        *[F.col("p")[i].alias(f"p_{d}") for i, d in enumerate(soft_mixing.DOMAINS)],
                        "rate", F.col("copies").alias("n_copies"))


@query("op4_suffix_dedup")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents", "doc_id", "text")
    found = suffix_dedup.remove_repeats(docs, "doc_id", "text")
    return found.select(
        F.col("id").alias("doc_id"), "n_bytes",
        (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query("op5_credential_links")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents", "doc_id", "text")
    found = credential_links.scan_credentials(docs, "doc_id", "text")

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(
            ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    base = F.filter("spans", lambda s: s["kind"].isin("assign", "access", "hex"))
    return found.select(F.col("id").alias("doc_id"), count("assign").alias("n_assign"),
                        count("access").alias("n_access"), count("hex").alias("n_hex"),
                        F.sha2(joined(base), 256).alias("base_sha256"),
                        joined(F.col("spans")).alias("spans"))


URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"),
             ("allow", "com/fr/"), ("block", "com/de/")]

def _smoothed(label: str) -> str:
    """SQL for (gram, p) of one label: Witten-Bell, from the empty context to three characters."""
    p, joins = "1.0e0 / 40", ""
    for k in range(4):
        joins += f"""
          LEFT JOIN ng n{k} ON n{k}.label = '{label}' AND n{k}.k = {k} AND n{k}.g = substr(gram, {4 - k})
          LEFT JOIN ctx c{k} ON c{k}.label = '{label}' AND c{k}.k = {k} AND c{k}.c = substr(gram, {4 - k}, {k})"""
        p = (f"(CASE WHEN c{k}.a IS NULL THEN {p} ELSE "
             f"(coalesce(n{k}.n, 0.0e0) + c{k}.t * {p}) / (c{k}.a + c{k}.t) END)")
    return f"SELECT gram, {p} AS p FROM (SELECT DISTINCT gram FROM grams) {joins}"


_OP10 = rf"""
WITH parts AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3)
                       ELSE '' END AS rest FROM pages),
hp AS (SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
              regexp_extract(substr(rest, length(h) + 1), '^[^?#]*') AS path
       FROM (SELECT *, regexp_extract(rest, '^[^/?#]*') AS h FROM parts)),
ruled AS (
  SELECT *, CASE
      WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
      WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
      WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
      WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
      WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/' END AS rule,
    '^^^' || regexp_replace(regexp_replace(lower(regexp_replace(host, '[^.]*\z', '') || path), '[0-9]+', '0', 'g'),
                            '[^a-z0./_%=+:,;-]', '~', 'g') || '$' AS folded
  FROM hp),
voted AS (
  SELECT *, CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS v
  FROM ruled),
labelled AS (
  SELECT *, coalesce(v, CASE WHEN regexp_matches(host, 'spam|pills|casino|viagra|porn|warez|adult|betting')
                             THEN 'block' END) AS label,
         substr(md5(regexp_extract(folded, '^[^/]*')), 1, 1) IN ('0', '1', '2') AS held
  FROM voted),
forms AS (SELECT folded, label, held, count(*) AS n FROM labelled GROUP BY ALL),
grams AS (SELECT folded, substr(folded, i, 4) AS gram
          FROM (SELECT folded, unnest(range(1, length(folded) - 2)) AS i
                FROM (SELECT DISTINCT folded FROM forms))),
ng AS (SELECT label, k, substr(gram, CAST(4 - k AS BIGINT)) AS g, CAST(sum(n) AS DOUBLE) AS n
       FROM forms JOIN grams USING (folded), range(4) AS r(k)
       WHERE label IS NOT NULL AND NOT held GROUP BY ALL),
ctx AS (SELECT label, k, substr(g, 1, CAST(k AS BIGINT)) AS c, sum(n) AS a, CAST(count(*) AS DOUBLE) AS t
        FROM ng GROUP BY ALL),
ratios AS (SELECT gram, CAST(round((ln(x.p) - ln(y.p)) * 1000000) AS BIGINT) AS units
           FROM ({_smoothed("allow")}) x JOIN ({_smoothed("block")}) y USING (gram)),
scores AS (SELECT folded, CAST(floor(CAST(sum(units) AS DOUBLE) / (count(*) * 10000)) AS BIGINT) AS score
           FROM grams JOIN ratios USING (gram) GROUP BY folded),
per AS (SELECT least(score, 0) AS score, sum(CASE WHEN label = 'allow' THEN n ELSE 0 END) AS good,
               sum(CASE WHEN label = 'block' THEN n ELSE 0 END) AS bad
        FROM forms JOIN scores USING (folded) WHERE held AND label IS NOT NULL GROUP BY 1),
lim AS (SELECT score FROM (
          SELECT score, sum(good) OVER () AS g, sum(bad) OVER () AS b,
                 coalesce(sum(good) OVER w, 0) AS bg, coalesce(sum(bad) OVER w, 0) AS bb
          FROM per WINDOW w AS (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
        WHERE g > 0 AND b > 0
        ORDER BY (g - bg) * b + bb * g DESC, score LIMIT 1)
SELECT page_id, host, path, rule, score,
       coalesce(v, CASE WHEN coalesce(score >= (SELECT score FROM lim), true)
                        THEN 'allow' ELSE 'block' END) AS verdict
FROM labelled JOIN scores USING (folded)"""


@query("op10_url_markov", _OP10)
def op10(spark: SparkSession, folder: str) -> DataFrame:
    pages = read_table(spark, folder, "pages", "page_id", "url")
    found = url_markov.filter_urls(pages, "page_id", "url", URL_RULES)
    return found.withColumnRenamed("id", "page_id")


@query("op9_byte_cnn")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents", "doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0,
                          F.lit(False))
    network = byte_cnn.train_network(docs.where(~held_out & F.col("doc_id").isNotNull()),
                                     "doc_id", "text", "lang")
    found = byte_cnn.identify_languages(docs, "doc_id", "text", network)
    return found.select(F.col("id").alias("doc_id"),
                        F.coalesce(F.crc32(F.col("id").cast("string").cast("binary")) % 5 == 0,
                                   F.lit(False)).alias("held_out"),
                        F.col("lang").alias("lang_pred"), "score")


@query("op2_license_classifier")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents", "doc_id", "text")
    model = license_classifier.train(docs, "doc_id", "text")
    return license_classifier.scan_licences(docs, "doc_id", "text", model).withColumnRenamed(
        "id", "doc_id")


@query("op11_closed_syncmers")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents", "doc_id", "text")
    found = syncmers.fingerprint_documents(docs, "doc_id", "text")
    return found.select(F.col("id").alias("doc_id"), "n_chars",
                        F.sha2("edited", 256).alias("edited_sha256"), "fingerprint",
                        "edited_fingerprint", "near_edited", "near_next")


_OP13 = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
lab AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good,
               max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY 1),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
             CASE WHEN len(w) < 200 THEN 1 ELSE 0 END
             + CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END
             + CASE WHEN 100 * len(regexp_extract_all(t, '[A-Z]')) > 2 * length(t) THEN 4 ELSE 0 END
             + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
             + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS bits
      FROM d LEFT JOIN lab USING (doc_id)),
c AS (SELECT part, bits, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY 1, 2),
one(l, b) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
orders AS (SELECT a.l || b.l || c.l || d.l || e.l AS filter_order, [a.b, b.b, c.b, d.b, e.b] AS x
           FROM one a, one b, one c, one d, one e WHERE a.b + b.b + c.b + d.b + e.b = 31
             AND a.b | b.b | c.b | d.b | e.b = 31),
steps AS (SELECT filter_order, step, x[step] AS bit,
                 CAST(coalesce(list_sum(x[1:step - 1]), 0) AS INTEGER) AS earlier
          FROM orders, range(1, 6) AS r(step)),
found AS (
  SELECT part, filter_order, step, bit,
         sum(CASE WHEN bits & (earlier | bit) = 0 THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN bits & earlier = 0 AND bits & bit > 0 THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN bits & earlier > 0 AND bits & bit > 0 THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN bits = bit THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN bits & earlier = 0 AND bits & bit > 0 THEN good ELSE 0 END) AS good_lost,
         sum(CASE WHEN bits & earlier = 0 AND bits & bit > 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM c, steps GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept,
       CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
       CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM found"""


@query("op13_filter_audit", _OP13)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    universe, failing = filter_audit.document_relations(
        read_table(spark, folder, "documents", "doc_id", "text", "source"), "doc_id", "text",
        "source", read_table(spark, folder, "labels"), "doc_id", "quality", "toxic")
    return filter_audit.audit_filters(universe, failing)


_VECTORS = """kept AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = 64
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h, v) - 1 AS k, v AS c
  FROM (SELECT v, sha256('1:' || vec_id) AS h FROM kept ORDER BY h, v LIMIT 16))"""


def _lloyd(i: int) -> str:
    """SQL for the assignment to the centroids of round i, and the centroids after it."""
    return f"""
a{i} AS MATERIALIZED (
  SELECT vec_id, any_value(v) AS v, min({{'d': d, 'k': k}}) AS m
  FROM (SELECT vec_id, v, k, CAST(list_sum(list_transform(list_zip(v, c),
               lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d FROM kept, c{i})
  GROUP BY vec_id),
c{i + 1} AS MATERIALIZED (
  SELECT k, coalesce(moved, c) AS c FROM c{i} LEFT JOIN (
    SELECT k, list(x ORDER BY j) AS moved FROM (
      SELECT m.k AS k, j, CAST(floor(sum(v[j]) / CAST(count(*) AS DOUBLE)) AS BIGINT) AS x
      FROM a{i}, range(1, 65) AS r(j) GROUP BY 1, 2) GROUP BY k) USING (k))"""


_OP12 = f"""
WITH {",".join([_VECTORS, *(_lloyd(i) for i in range(4))])}
SELECT vec_id, CAST(m.k AS INTEGER) AS cluster, m.d AS distance,
       CAST(sum(m.d) OVER (PARTITION BY m.k) AS BIGINT) AS cluster_inertia,
       CAST(sum(m.d) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a3 JOIN c3 ON c3.k = m.k"""


@query("op12_zone_clusters", _OP12)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    found = zone_clusters.cluster_vectors(
        read_table(spark, folder, "embeddings", "vec_id", "embedding"), "vec_id", "embedding")
    text = F.array_join(F.transform("centroid", lambda x: x.cast("string")), ",")
    return found.select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia",
                        "inertia", F.sha2(text, 256).alias("centroid_sha256"))
