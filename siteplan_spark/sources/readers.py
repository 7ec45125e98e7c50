"""Lossless readers: every column text, every row kept, nothing inferred."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siteplan_spark.sources.wkb import decode_batches


def read_delimited(spark: SparkSession, path: str, header: Sequence[str], delimiter: str = ",",
                   encoding: str = "UTF-8", quote: str = '"',
                   multiline: bool = False) -> DataFrame:
    """Delimited text with declared column names; blank cells become ``""``.

    A malformed row fails the read instead of being dropped, and an embedded quote is
    escaped by doubling it. ``multiline`` allows line breaks inside quoted cells, at the
    price of one task per file.
    """
    schema = T.StructType([T.StructField(h, T.StringType()) for h in header])
    df = (spark.read.schema(schema)
          .options(header=True, sep=delimiter, encoding=encoding, quote=quote, escape=quote,
                   mode="FAILFAST", multiLine=multiline, enforceSchema=True)
          .csv(path))
    return df.na.fill("")


def delimited_header(spark: SparkSession, path: str, delimiter: str = ",",
                     encoding: str = "UTF-8") -> list[str]:
    """The header verbatim, byte-order mark removed: only the first row is read."""
    row = spark.read.options(header=False, sep=delimiter, encoding=encoding).csv(path).first()
    return [str(v or "").removeprefix("﻿") for v in row]


def read_json_records(spark: SparkSession, path: str, record_path: str,
                      schema: str | T.StructType) -> DataFrame:
    """Records under a key path as flat text rows, columns in sorted order.

    ``schema`` declares the whole document; nested values are written back as JSON text.
    """
    doc = spark.read.schema(schema).json(path, multiLine=True)
    return flatten_records(doc, record_path)


def flatten_records(doc: DataFrame, record_path: str) -> DataFrame:
    rows = doc.select(F.explode(record_path).alias("_r")).select("_r.*")
    def text(field: T.StructField) -> Column:
        nested = isinstance(field.dataType, (T.StructType, T.ArrayType, T.MapType))
        value = F.to_json(field.name) if nested else F.col(field.name).cast("string")
        return F.coalesce(value, F.lit("")).alias(field.name)
    return rows.select(*[text(f) for f in sorted(rows.schema.fields, key=lambda f: f.name)])


def explode_nested(df: DataFrame, key: str, array_col: str,
                   ordinal: str = "record_ordinal") -> DataFrame:
    """One row per child with its ordinal and a synthetic key ``parent:ordinal``.

    Identical children stay separate rows.
    """
    rest = [c for c in df.columns if c != array_col]
    return df.select(*rest, F.posexplode(array_col).alias(ordinal, "child")).withColumn(
        "record_key", F.concat_ws(":", key, ordinal))


def explode_map_measures(df: DataFrame, map_col: str, name: str = "measure") -> DataFrame:
    """map<name, struct> per row to one row per entry; an absent entry gives no row."""
    rest = [c for c in df.columns if c != map_col]
    return df.select(*rest, F.explode(map_col).alias(name, "_m")).select(*rest, name, "_m.*")


def html_table_rows(df: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """The first HTML table of each document: (id, row_no, cells: map header -> text).

    Rows without cells are left out first, so the header is the first row that has any. Of a
    repeated header the last cell counts. Total rows are kept; a document without a table
    gives no row.
    """
    table = F.regexp_extract(html_col, r"(?is)<table[^>]*>(.*?)</table>", 1)
    trs = F.expr(r"regexp_extract_all(_t, '(?is)<tr[^>]*>(.*?)</tr>', 1)")
    cells = F.expr(
        r"filter(transform(_trs, r -> transform("
        r"regexp_extract_all(r, '(?is)<t[hd][^>]*>(.*?)</t[hd]>', 1), "
        r"c -> trim(regexp_replace(c, '(?s)<[^>]*>', '')))), r -> size(r) > 0)")
    rows = (df.select(id_col, table.alias("_t")).where("_t <> ''")
            .select(id_col, trs.alias("_trs")).select(id_col, cells.alias("_rows"))
            .select(id_col, F.get("_rows", F.lit(0)).alias("_head"),
                    F.posexplode("_rows").alias("row_no", "_cells")).where("row_no > 0"))
    n = F.least(F.size("_head"), F.size("_cells"))
    last = F.filter(F.sequence(F.lit(1), n), lambda i: ~F.array_contains(
        F.slice("_head", i + 1, n - i), F.get("_head", i - 1)))
    return rows.select(id_col, "row_no", F.map_from_arrays(
        F.transform(last, lambda i: F.get("_head", i - 1)),
        F.transform(last, lambda i: F.get("_cells", i - 1))).alias("cells"))


def merge_column_batches(batches: Sequence[DataFrame], key: Sequence[str]) -> DataFrame:
    """Extracts of the same keys with different columns to one wide table.

    The full joins keep any unmatched key, and a presence count finds it: a key missing
    from some batch makes the merge fail when the result is checked.
    """
    marked = [b.withColumn(f"_in{i}", F.lit(1)) for i, b in enumerate(batches)]
    wide = reduce(lambda a, b: a.join(b, list(key), "full"), marked)
    present = reduce(lambda a, b: a + b, [
        F.coalesce(F.col(f"_in{i}"), F.lit(0)) for i in range(len(batches))])
    return wide.withColumn("_batches", present).drop(*[f"_in{i}" for i in range(len(batches))])


def assert_same_keys(merged: DataFrame, batches: int) -> DataFrame:
    bad = merged.where(F.col("_batches") != batches).count()
    if bad:
        raise ValueError(f"{bad} key(s) are missing from at least one extract")
    return merged.drop("_batches")


def geoid_from_parts(*parts: str) -> Column:
    return F.concat(*[F.col(p).cast("string") for p in parts])


def union_tagged(frames: Sequence[DataFrame], tags: Mapping[str, Sequence[str]]) -> DataFrame:
    """Lossless union of like text tables; missing columns are ``""``; tags per input."""
    tagged = []
    for i, frame in enumerate(frames):
        tagged.append(frame.withColumns({t: F.lit(v[i]) for t, v in tags.items()}))
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    text = [f.name for f in out.schema.fields if isinstance(f.dataType, T.StringType)]
    return out.na.fill("", subset=text)


def rename_declared_key(df: DataFrame, declared: Mapping[str, str], scope: str,
                        out: str = "source_geography_id") -> DataFrame:
    """Copy the *declared* key column of each scope into one uniform column."""
    pick = reduce(lambda acc, kv: acc.when(F.col(scope) == kv[0], F.col(kv[1]).cast("string")),
                  list(declared.items())[1:],
                  F.when(F.col(scope) == next(iter(declared.items()))[0],
                         F.col(next(iter(declared.items()))[1]).cast("string")))
    return df.withColumn(out, pick)


def read_keyed_reference(spark: SparkSession, path: str, key: str, value: str,
                         delimiter: str = "\t", scale: float = 1.0) -> DataFrame:
    """(key, value x scale) from a reference file whose headers may be padded."""
    header = delimited_header(spark, path, delimiter)
    df = read_delimited(spark, path, header, delimiter)
    trimmed = df.toDF(*[h.strip() for h in header])
    return keyed_reference(trimmed, key, value, scale)


def keyed_reference(df: DataFrame, key: str, value: str, scale: float = 1.0) -> DataFrame:
    return df.select(F.trim(F.col(key).cast("string")).alias("key"),
                     (F.trim(F.col(value).cast("string")).try_cast("double") * scale)
                     .alias("value")).where("key <> '' AND value IS NOT NULL")


def read_ratio_crosswalk(df: DataFrame, json_col: str) -> DataFrame:
    """JSON ``{area: [{geoid, res_ratio}]}`` to edges (source, target, weight).

    Repeated targets are added up; areas whose ratios sum to zero stay; nothing is
    renormalised.
    """
    parsed = F.from_json(json_col, "map<string, array<struct<geoid: string, res_ratio: double>>>")
    return (df.select(F.explode(parsed).alias("source", "_l"))
            .select("source", F.inline("_l"))
            .groupBy("source", F.col("geoid").alias("target"))
            .agg(F.sum("res_ratio").alias("weight")))


def load_population_points(df: DataFrame, parts: Mapping[str, int], population: str, lat: str,
                           lon: str) -> DataFrame:
    """Points with validated key widths and castable numbers.

    ``parts``: key column to its required width, in order; keys are trimmed first. A blank
    population is zero and decimals such as ``12.0`` are read. Rows that fail are left out,
    and no row at all is an error.
    """
    keys = [F.trim(F.col(c)) for c in parts]
    ok = reduce(lambda a, b: a & b, [F.length(k) == n for k, n in zip(keys, parts.values(),
                                                                     strict=True)])
    count = F.trim(F.col(population).cast("string"))
    typed = df.where(ok).select(
        F.concat(*keys).alias("point_id"),
        F.concat(*keys[:-1]).alias("source_id"),
        F.when(F.coalesce(count, F.lit("")) == "", 0).otherwise(
            count.try_cast("double").try_cast("bigint")).cast("bigint").alias("population"),
        F.col(lat).try_cast("double").alias("lat"), F.col(lon).try_cast("double").alias("lon"))
    return assert_not_empty(
        typed.where("population IS NOT NULL AND lat IS NOT NULL AND lon IS NOT NULL"),
        "population points")


def assert_not_empty(df: DataFrame, what: str) -> DataFrame:
    if df.isEmpty():
        raise ValueError(f"{what} is empty")
    return df


# --- polylines ----------------------------------------------------------------------------

# Road classes kept for siting.
PRIMARY_SECONDARY = ("S1100", "S1200")


def decode_polylines(df: DataFrame, feature: str, geometry: str, road_class: str,
                     keep: Sequence[str] = PRIMARY_SECONDARY) -> tuple[DataFrame, DataFrame]:
    """(features, class counts) from a binary geometry column.

    The class filter runs before decoding; excluded classes are counted, and kept rows without a
    geometry as the class ``missing_geometry``. Each part of a multi-line becomes its own feature
    ``id#part``. A batch is decoded as a whole, its vertices are never Python objects.
    """
    wanted = F.col(road_class).isin(*keep)
    kind = F.when(wanted & F.col(geometry).isNull(), "missing_geometry").otherwise(
        F.col(road_class))
    counts = df.groupBy(kind.alias(road_class)).agg(F.count(F.lit(1)).alias("n")).withColumn(
        "is_kept", wanted)

    kept = df.where(wanted & F.col(geometry).isNotNull()).select(
        F.col(feature).cast("string").alias("feature"), geometry)
    return kept.mapInArrow(
        decode_batches, "feature string, vertices array<struct<lat: double, lon: double>>"), counts


# --- parameters -----------------------------------------------------------------------------

def read_parameters(spark: SparkSession, rows: Sequence[Mapping[str, object]],
                    schema: str) -> DataFrame:
    """A declared reference table; every row must carry its justification."""
    if not rows:
        raise ValueError("an empty parameter table would silently disable its rule")
    for row in rows:
        if not str(row.get("justification", "")).strip():
            raise ValueError(f"parameter without a justification: {row}")
    names = [f.split()[0] for f in schema.split(",")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema)
