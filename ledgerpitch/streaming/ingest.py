"""Incremental ingestion: a file stream feeding the keyed upsert, with a ledger."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerpitch.operators.upsert import last_per_key, upsert_path, write_partitions
from ledgerpitch.session import durable


def _exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.parquet(path).schema  # noqa: B018
    except Exception as error:  # noqa: BLE001
        if "PATH_NOT_FOUND" in str(error) or "UNABLE_TO_INFER_SCHEMA" in str(error):
            return False
        raise
    return True


def ingest_available(
    spark: SparkSession,
    source: str,
    schema: T.StructType,
    target: str,
    checkpoint: str,
    keys: Sequence[str],
    sequence: Sequence[str],
    partitions: Sequence[str],
    prepare=lambda df: df,
    files_per_batch: int = 1000,
) -> None:
    """Read the files that arrived since the last run and upsert them, then stop.

    Every batch rewrites only the partitions it touches. A batch that is repeated after a failure
    or arrives late gives the same rows, because the upsert is keyed and keeps the newest row.
    """

    def apply(batch: DataFrame, number: int) -> None:
        # The batch is computed once; everything below reads what was written.
        batch = durable(batch)
        counts = batch.agg(F.count("*").alias("rows"), F.countDistinct(*keys).alias("keys")).select(
            F.lit(number).alias("batch"), "rows", "keys"
        )
        found = counts.first()
        if not found["rows"]:
            return
        counts = batch.sparkSession.createDataFrame([found], counts.schema)
        # The ledger says what is under way, so a run that dies is seen.
        write_partitions(counts.withColumn("status", F.lit("in_progress")), f"{target}_ledger", ["batch"])
        if _exists(batch.sparkSession, target):
            upsert_path(
                batch.sparkSession, target, batch, keys, sequence, partitions, keep_newest=True
            )
        else:
            write_partitions(last_per_key(batch, keys, sequence), target, partitions)
        write_partitions(counts.withColumn("status", F.lit("complete")), f"{target}_ledger", ["batch"])

    stream = (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", files_per_batch)
        .format("parquet")
        .load(source)
    )
    query = (
        prepare(stream)
        .writeStream.trigger(availableNow=True)
        .option("checkpointLocation", checkpoint)
        .foreachBatch(apply)
        .start()
    )
    query.awaitTermination()


def affected_entities(changed: DataFrame, key: str) -> DataFrame:
    """Entities whose later windows a late correction can change."""
    return changed.select(key).distinct()


def refresh_features(base: DataFrame, stored: DataFrame, changed: DataFrame, key: str, build) -> DataFrame:
    """Recompute all rows of the affected entities and keep the others as stored."""
    touched = affected_entities(changed, key)
    fresh = build(base.join(touched, key, "left_semi"))
    kept = stored.join(touched, key, "left_anti")
    return kept.unionByName(fresh)
