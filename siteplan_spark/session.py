"""Session creation and the shared checkpoint folder the operators rely on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "siteplan", master: str | None = None,
                  shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are written for (AQE, UTC)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **{k.replace("__", "."): v for k, v in conf.items()},
    }
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder named in ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder; on a cluster a
    machine-local folder would be lost with the executor that wrote it.
    """
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        context.setCheckpointDir(shared)
    elif context.master.startswith("local"):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")


#: Rows that one file of a narrow table may have.
FILE_ROWS = 50_000


def cut_lineage(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Write the rows as a table in the shared checkpoint folder and read it back.

    It survives executor loss and computes the input once. A plain ``checkpoint()`` would
    also carry the constraints inferred so far into the next plan, which grow round by
    round in iterative jobs; a table starts clean and can be read column by column.

    Where ``rows`` is given, the table has about so many narrow rows at most and is written in as
    few files as they fill. Rounds over a few rows would else write and read a file for each
    shuffle partition.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    if rows is not None:
        df = df.coalesce(1 + rows // FILE_ROWS)
    df.write.option("compression", "lz4").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
