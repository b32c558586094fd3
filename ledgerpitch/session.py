"""Session settings, durable cuts and the size limits used by the operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

MAX_GROUP_ROWS_CONF = "spark.ledgerpitch.maxGroupRows"
MAX_BROADCAST_ROWS_CONF = "spark.ledgerpitch.maxBroadcastRows"
DEFAULT_MAX_GROUP_ROWS = 1_000_000
DEFAULT_MAX_BROADCAST_ROWS = 200_000


def build_session(app_name: str = "ledgerpitch", **conf: str) -> SparkSession:
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.sources.partitionOverwriteMode", "dynamic")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def max_group_rows(spark: SparkSession) -> int:
    """Rows of one group that a single task may sort before the group is split."""
    return int(spark.conf.get(MAX_GROUP_ROWS_CONF, str(DEFAULT_MAX_GROUP_ROWS)))


def max_broadcast_rows(spark: SparkSession) -> int:
    return int(spark.conf.get(MAX_BROADCAST_ROWS_CONF, str(DEFAULT_MAX_BROADCAST_ROWS)))


def shared_dir(spark: SparkSession) -> str:
    """The folder for checkpoints and written intermediates.

    A cluster names it in ``spark.checkpoint.dir``. Only a local master may fall back to a
    temporary folder, because there driver and executors share one disk.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get(
        "spark.checkpoint.dir"
    )
    if named:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(named)
        return named
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="ledgerpitch-checkpoint-"))
    return str(context.getCheckpointDir())


def durable(df: DataFrame) -> DataFrame:
    """Write the rows once as Parquet to the shared folder and go on from the files.

    The lineage ends there, lost executors cost nothing that was written, and later steps read
    only the columns they need.
    """
    path = f"{shared_dir(df.sparkSession)}/rows-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
