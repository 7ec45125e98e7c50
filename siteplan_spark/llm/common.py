"""What the corpus operators share: reading, shared folders, bytes of text columns."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siteplan_spark.session import cut_lineage, ensure_checkpoint_dir
from siteplan_spark.sources.tables import read_table

__all__ = ["cut_lineage", "read_table", "shared_folder", "text_bytes", "where_once"]


def shared_folder(spark: SparkSession, kind: str) -> str:
    """A new folder name under the checkpoint folder, which all machines can reach."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{kind}-{uuid.uuid4().hex}"


def text_bytes(column: pa.Array) -> Iterator[bytes]:
    """The UTF-8 bytes of each row, a null as no bytes."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    for value in column.cast(kind):
        yield value.as_py() or b""


def where_once(df: DataFrame, condition: Column) -> DataFrame:
    """Filter on computed columns without computing them twice.

    The optimizer moves a filter below the projection that computes its columns and repeats
    their expressions there. It does not move one past a column that depends on the place of
    the row, so such a column is put between.
    """
    fenced = df.withColumn("_fence", F.monotonically_increasing_id())
    return fenced.where(condition & (F.col("_fence") >= 0)).drop("_fence")
