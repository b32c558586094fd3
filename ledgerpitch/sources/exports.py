"""Published files: ranking, diff, pending links and the manifest over them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerpitch.sources.lists import file_identity


def export_ranking(ranking: DataFrame, root: str) -> None:
    """CSV and Parquet in role order, dearest first; a range sort keeps every file ordered."""
    ordered = ranking.orderBy(F.col("role"), F.col("suggested_credits").desc(), F.col("fantacalcio_id"))
    ordered.write.mode("errorifexists").option("header", True).csv(f"{root}/ranking_csv")
    ordered.write.mode("errorifexists").parquet(f"{root}/ranking_parquet")


def export_diff(diff: DataFrame, root: str) -> None:
    """Diff with JSON-encoded values, so that text and missing values stay distinct.

    Without a change the file holds one header line, ``change_type``.
    """
    if diff.isEmpty():
        diff.sparkSession.createDataFrame([], "change_type string").coalesce(1).write.mode("errorifexists").option(
            "header", True
        ).csv(f"{root}/diff_csv")
        return
    encoded = diff.orderBy("change_type", "role", "name").select(
        *[
            F.coalesce(F.to_json(F.array(name)).substr(F.lit(2), F.length(F.to_json(F.array(name))) - 2), F.lit("null"))
            .alias(name)
            for name in diff.columns
        ]
    )
    encoded.write.mode("errorifexists").option("header", True).option("quote", "").csv(f"{root}/diff_csv")


def export_pending(pending: DataFrame, root: str) -> None:
    pending.orderBy("season", "fantacalcio_name").write.mode("errorifexists").option(
        "header", True
    ).csv(f"{root}/pending_csv")


def manifest(spark: SparkSession, root: str, build: DataFrame) -> DataFrame:
    """Name, hash and size of every exported file next to the build's metadata."""
    files = file_identity(spark, f"{root}/*/part-*").select(
        F.regexp_extract("path", r"([^/]+/[^/]+)$", 1).alias("file"), "sha256", "bytes"
    )
    meta = build.select(F.to_json(F.struct("*")).alias("build")).scalar()
    return files.withColumn("build", meta)


def write_manifest(rows: DataFrame, root: str) -> None:
    rows.write.mode("errorifexists").json(f"{root}/manifest_json")


def publish_verified(spark: SparkSession, root: str, write: Callable[[str], None], build: DataFrame) -> DataFrame:
    """Write files and their manifest, read both back, and mark them published only if they agree.

    Readers go by the mark (``read_published``), so a file that was cut or changed on the way is
    never seen; a difference raises.
    """
    write(root)
    write_manifest(manifest(spark, root, build), root)
    if wrong := differences(spark, root):
        raise ValueError(f"published files differ from their manifest: {wrong}")
    spark.createDataFrame([(root,)], "root string").coalesce(1).write.mode("errorifexists").text(f"{root}/published")
    return spark.read.json(f"{root}/manifest_json")


def differences(spark: SparkSession, root: str, most: int = 20) -> list[str]:
    """Names of files whose bytes are not what the manifest says, ``most`` of them."""
    listed = spark.read.json(f"{root}/manifest_json").select("file", F.col("sha256").alias("_sha"), F.col("bytes").alias("_bytes"))
    name = F.regexp_extract("path", r"([^/]+/[^/]+)$", 1)
    there = file_identity(spark, f"{root}/*/part-*").select(name.alias("file"), "sha256", "bytes")
    there = there.filter(~F.col("file").startswith("manifest_json/") & ~F.col("file").startswith("published/"))
    same = F.col("sha256").eqNullSafe(F.col("_sha")) & F.col("bytes").eqNullSafe(F.col("_bytes"))
    return sorted(r["file"] for r in there.join(listed, "file", "full").filter(~same).select("file").limit(most).collect())


def read_published(spark: SparkSession, root: str, output: str) -> DataFrame:
    """The rows of a published CSV output; fails where there is no mark."""
    spark.read.text(f"{root}/published").count()
    return spark.read.option("header", True).csv(f"{root}/{output}")
