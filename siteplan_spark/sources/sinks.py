"""Published artifacts: Parquet, JSON, CSV, GeoJSON text and the manifest."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteplan_spark.operators.quality import table_fingerprint
from siteplan_spark.sources.wkb import encode_batches

# Fixed value: rows per Parquet row group in published tables.
ROW_GROUP_ROWS = 8_192


def write_artifact(df: DataFrame, path: str, columns: Sequence[str],
                   not_null: Sequence[str] = (), sort_by: Sequence[str] = (),
                   row_group_bytes: int = 1 << 20) -> None:
    """ZSTD Parquet in declared column order; refuses empty or incomplete tables.

    One aggregate checks emptiness and completeness before anything is written.
    ``sort_by`` range-partitions, so readers can skip row groups by their statistics.
    """
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"artifact lacks columns {missing}")
    out = df.select(*columns)
    check = out.agg(F.count(F.lit(1)).alias("rows"), *[
        F.sum(F.when(F.col(c).isNull(), 1).otherwise(0)).alias(c) for c in not_null]).first()
    if check["rows"] == 0:
        raise ValueError("refusing to publish an empty artifact")
    holes = [c for c in not_null if check[c]]
    if holes:
        raise ValueError(f"refusing to publish nulls in {holes}")
    if sort_by:
        out = out.repartitionByRange(*sort_by).sortWithinPartitions(*sort_by)
    (out.write.mode("overwrite").option("compression", "zstd")
     .option("parquet.block.size", row_group_bytes).parquet(path))


def partitioned_json(df: DataFrame, group: str, point: Sequence[str], path: str,
                     rows_per_file: int = 1_000_000) -> None:
    """One folder per group with a JSON line per point, written where the rows are.

    A large group becomes several files rather than one collected document.
    """
    (df.select(group, *point).write.mode("overwrite")
     .option("maxRecordsPerFile", rows_per_file).partitionBy(group).json(path))


def export_csv(df: DataFrame, path: str, columns: Sequence[str]) -> None:
    """RFC 4180 quoting; provenance goes to the manifest, not into the rows."""
    (df.select(*columns).write.mode("overwrite")
     .options(header=True, quote='"', escape='"', emptyValue="").csv(path))


def geojson_feature(lat: str, lon: str, properties: Sequence[str]) -> Column:
    """A row as GeoJSON Feature text, coordinates in [lon, lat] order."""
    return F.to_json(F.struct(
        F.lit("Feature").alias("type"),
        F.struct(F.lit("Point").alias("type"),
                 F.array(F.col(lon), F.col(lat)).alias("coordinates")).alias("geometry"),
        F.struct(*properties).alias("properties")))


def write_geojson(df: DataFrame, path: str, lat: str, lon: str,
                  properties: Sequence[str]) -> None:
    """Line-delimited features; a bounded selection can be folded into a collection."""
    df.select(geojson_feature(lat, lon, properties).alias("value")).write.mode(
        "overwrite").text(path)


def encode_polylines(df: DataFrame, feature: str, vertices: str) -> DataFrame:
    """(feature, geometry): array<struct<lat, lon>> as WKB LineStrings; a null line is dropped."""
    lines = df.where(F.col(vertices).isNotNull()).select(
        F.col(feature).cast("string").alias("feature"), vertices)
    return lines.mapInArrow(encode_batches, "feature string, geometry binary")


def feature_collection(df: DataFrame, lat: str, lon: str, properties: Sequence[str],
                       limit: int = 10_000) -> DataFrame:
    """One FeatureCollection document from a selection of at most ``limit`` rows."""
    if df.limit(limit + 1).count() > limit:
        raise ValueError(f"a collection document holds at most {limit} features")
    feats = df.select(geojson_feature(lat, lon, properties).alias("f"))
    return feats.agg(F.concat(F.lit('{"type":"FeatureCollection","features":['),
                              F.concat_ws(",", F.array_sort(F.collect_list("f"))),
                              F.lit("]}")).alias("value"))


def build_manifest(artifacts: Mapping[str, DataFrame], vintages: Mapping[str, str],
                   generated_at: str) -> DataFrame:
    """One row per artifact: rows, columns, fingerprint, vintages, time."""
    parts = []
    for name, df in artifacts.items():
        fields = ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in df.schema.fields)
        parts.append(table_fingerprint(df, vintages=vintages).select(
            F.lit(name).alias("artifact"), "rows", F.lit(fields).alias("columns"),
            "fingerprint", F.lit(generated_at).alias("generated_at"),
            F.lit(",".join(f"{k}={v}" for k, v in sorted(vintages.items()))).alias("vintages")))
    return reduce(DataFrame.unionByName, parts)


def stage_provenance(df: DataFrame, source_id: str, vintage: str, retrieved_at: str,
                     sha256: str, endpoint: str) -> DataFrame:
    return df.withColumn("provenance", F.struct(
        F.lit(source_id).alias("source_id"), F.lit(vintage).alias("vintage"),
        F.lit(retrieved_at).alias("retrieved_at"), F.lit(sha256).alias("sha256"),
        F.lit(endpoint).alias("endpoint")))
