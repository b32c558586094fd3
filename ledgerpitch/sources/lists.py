"""Price lists, curated CSVs and their checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerpitch.functions import casts
from ledgerpitch.functions.text import season_in_text
from ledgerpitch.operators.upsert import upsert, without

# List headers with their column names, list sheets and file pattern.
LIST_HEADERS = {
    "Id": "fantacalcio_id",
    "R": "classic_role",
    "RM": "mantra_roles",
    "Nome": "name",
    "Squadra": "team",
    "Qt.A": "quote_current",
    "Qt.I": "quote_initial",
    "Diff.": "quote_diff",
    "Qt.A M": "mantra_quote_current",
    "Qt.I M": "mantra_quote_initial",
    "Diff.M": "mantra_quote_diff",
    "FVM": "fvm",
    "FVM M": "fvm_mantra",
}
SHEETS = {"Tutti": "active", "Ceduti": "ceduto"}
LIST_PATTERN = "Quotazioni_Fantacalcio_Stagione_*"
TEXT_COLUMNS = ("classic_role", "mantra_roles", "name", "team")
NUMBER_COLUMNS = tuple(name for name in LIST_HEADERS.values() if name not in TEXT_COLUMNS)
ROLES = ("P", "D", "C", "A")
MAPPING_REQUIRED = ("fantacalcio_id", "api_player_id", "season")
OVERRIDE_REQUIRED = ("fantacalcio_id", "season", "valid_from", "source", "author")


def discover(spark: SparkSession, directory: str, pattern: str = LIST_PATTERN) -> DataFrame:
    """Distinct matching files with the season named in their path; contents are not read."""
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", "true")
        .load(directory)
        .select("path", "modificationTime", "length")
        .dropDuplicates(["path"])
        .withColumn("season", season_in_text(F.element_at(F.split("path", "/"), -1)))
    )


def file_identity(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """sha256 and size per file."""
    return (
        spark.read.format("binaryFile")
        .load(paths)
        .select(
            "path",
            "modificationTime",
            F.col("length").alias("bytes"),
            F.sha2("content", 256).alias("sha256"),
        )
    )


def strict_csv(spark: SparkSession, path: str, headers: Sequence[str]) -> DataFrame:
    """All columns as text; a header that differs from ``headers`` fails the read."""
    schema = T.StructType([T.StructField(name, T.StringType()) for name in headers])
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("enforceSchema", False)
        .option("mode", "FAILFAST")
        .csv(path)
    )


def read_sheet(spark: SparkSession, path: str, sheet: str) -> DataFrame:
    raw = strict_csv(spark, path, list(LIST_HEADERS))
    named = raw.select(*[F.trim(F.col(f"`{h}`")).alias(n) for h, n in LIST_HEADERS.items()])
    some_value = F.coalesce(*[F.nullif(F.col(name), F.lit("")) for name in named.columns])
    return named.filter(some_value.isNotNull()).select(
        "*", F.lit(SHEETS[sheet]).alias("status"), F.lit(sheet).alias("source_sheet")
    )


def typed_list(rows: DataFrame, roles: Sequence[str] = ROLES) -> DataFrame:
    """Typed columns plus a ``violations`` array; an empty array means the row is sound."""
    numbers = {name: casts.to_int(F.col(name)) for name in NUMBER_COLUMNS}
    checks: list[Column] = [
        F.when(value.isNull(), F.lit(f"{name} is not an integer")) for name, value in numbers.items()
    ]
    checks.append(
        F.when(~F.coalesce(F.col("classic_role").isin(*roles), F.lit(False)), F.lit("unknown role"))
    )
    for prefix in ("", "mantra_"):
        current, initial, diff = (
            numbers[f"{prefix}quote_{part}"] for part in ("current", "initial", "diff")
        )
        checks.append(F.when(current - initial != diff, F.lit(f"{prefix}quote_diff is inconsistent")))
    others = [name for name in rows.columns if name not in numbers]
    return rows.select(
        *[value.alias(name) for name, value in numbers.items()],
        *others,
        F.array_compact(F.array(*checks)).alias("violations"),
    )


def cross_sheet_duplicates(rows: DataFrame, key: str = "fantacalcio_id") -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("copies")).filter(F.col("copies") > 1)


def _refuse(df: DataFrame, message: str) -> None:
    examples = [str(tuple(row)) for row in df.limit(5).collect()]
    if examples:
        raise ValueError(f"{message}: {'; '.join(examples)}")


def read_price_list(spark: SparkSession, active_path: str, sold_path: str) -> DataFrame:
    """Both sheets of one list, refused as a whole if any row or key is wrong."""
    rows = typed_list(
        read_sheet(spark, active_path, "Tutti").unionByName(read_sheet(spark, sold_path, "Ceduti"))
    )
    _refuse(
        rows.filter(F.size("violations") > 0).select("fantacalcio_id", "violations"),
        "rows of the price list are wrong",
    )
    _refuse(cross_sheet_duplicates(rows), "ids occur more than once over both sheets")
    return rows.drop("violations")


def snapshot_header(rows: DataFrame, files: DataFrame, season: str) -> DataFrame:
    """Snapshot id from the content of the files, with the counts of the list."""
    combined = files.agg(
        F.sha2(F.array_join(F.sort_array(F.collect_list("sha256")), ""), 256).alias("checksum"),
        F.max("modificationTime").alias("source_modified_at"),
    )
    counts = rows.agg(
        F.count("*").alias("record_count"),
        F.count_if(F.col("status") == "active").alias("active_count"),
        F.count_if(F.col("status") == "ceduto").alias("ceduti_count"),
    )
    # Both sides are single rows by construction.
    return counts.select(
        *counts.columns,
        combined.select("checksum").scalar().alias("checksum"),
        combined.select("source_modified_at").scalar().alias("source_modified_at"),
    ).select(
        F.concat_ws("-", F.lit("listone"), F.lit(season.replace("/", "-")), F.substring("checksum", 1, 16))
        .alias("snapshot_id"),
        F.lit(season).alias("season"),
        "checksum",
        "source_modified_at",
        F.current_timestamp().alias("imported_at"),
        "record_count",
        "active_count",
        "ceduti_count",
    )


def insert_snapshot(
    snapshots: DataFrame, players: DataFrame, header: DataFrame, rows: DataFrame
) -> tuple[DataFrame, DataFrame, bool]:
    """Add a snapshot unless its id is known; returns both tables and whether it was added."""
    fresh = header.join(snapshots.select("snapshot_id"), "snapshot_id", "left_anti").first()
    if fresh is None:
        return snapshots, players, False
    stamped = rows.withColumns(
        {"snapshot_id": F.lit(fresh["snapshot_id"]), "season": F.lit(fresh["season"])}
    )
    return (
        snapshots.unionByName(header.select(*snapshots.columns)),
        players.unionByName(stamped.select(*players.columns)),
        True,
    )


def _csv_with(spark: SparkSession, path: str, required: Sequence[str]) -> DataFrame:
    rows = spark.read.option("header", True).csv(path)
    # A byte-order mark may precede the first header.
    rows = rows.toDF(*[name.lstrip("﻿").strip() for name in rows.columns])
    absent = sorted(set(required) - set(rows.columns))
    if absent:
        raise ValueError(f"the file lacks the columns {absent}")
    return rows


def _optional(rows: DataFrame, name: str) -> Column:
    return casts.blank_to_null(F.col(name)) if name in rows.columns else F.lit(None).cast("string")


def read_mapping_decisions(spark: SparkSession, path: str, note: str = "manual CSV") -> DataFrame:
    rows = _csv_with(spark, path, MAPPING_REQUIRED)
    status = F.lower(F.coalesce(_optional(rows, "status"), F.lit("accepted")))
    typed = rows.select(
        casts.to_int(F.col("fantacalcio_id")).alias("fantacalcio_id"),
        F.when(casts.blank_to_null(F.col("api_player_id")).isNull(), 0)
        .otherwise(casts.to_int(F.col("api_player_id")))
        .alias("api_player_id"),
        F.col("season"),
        F.lit("manual").alias("method"),
        F.lit(1.0).alias("confidence"),
        status.alias("status"),
        F.coalesce(_optional(rows, "note"), F.lit(note)).alias("note"),
        F.current_timestamp().alias("updated_at"),
    )
    wrong = (
        F.col("fantacalcio_id").isNull()
        | F.col("api_player_id").isNull()
        | ~F.col("status").isin("accepted", "excluded")
        | ((F.col("status") == "accepted") & (F.col("api_player_id") <= 0))
    )
    _refuse(typed.filter(wrong), "mapping decisions are wrong")
    return typed


def apply_mapping_decisions(mappings: DataFrame, decisions: DataFrame) -> DataFrame:
    """Undecided rows of the decided players go, then decisions replace rows with their key."""
    players = ["fantacalcio_id", "season"]
    stale = mappings.filter(F.col("status") != "accepted").join(
        decisions.select(*players).distinct(), players, "left_semi"
    )
    key = ["fantacalcio_id", "api_player_id", "season"]
    return upsert(
        without(mappings, stale, [*key]), decisions, key, ["updated_at", "note"]
    )


def read_overrides(spark: SparkSession, path: str) -> DataFrame:
    rows = _csv_with(spark, path, OVERRIDE_REQUIRED)
    raw = {
        "valid_to": _optional(rows, "valid_to"),
        "expected_start_share": _optional(rows, "expected_start_share"),
        "penalty_rank": _optional(rows, "penalty_rank"),
        "set_piece_rank": _optional(rows, "set_piece_rank"),
        "risk_modifier": _optional(rows, "risk_modifier"),
    }
    kinds = {
        "valid_to": casts.to_date,
        "expected_start_share": casts.to_double,
        "penalty_rank": casts.to_int,
        "set_piece_rank": casts.to_int,
        "risk_modifier": casts.to_double,
    }
    unreadable = F.lit(False)
    for name, text in raw.items():
        unreadable = unreadable | casts.unreadable(text, kinds[name](text))
    typed = rows.select(
        casts.to_int(F.col("fantacalcio_id")).alias("fantacalcio_id"),
        "season",
        casts.to_date(F.col("valid_from")).alias("valid_from"),
        *[kinds[name](text).alias(name) for name, text in raw.items()],
        _optional(rows, "note").alias("note"),
        "source",
        "author",
        unreadable.alias("_unreadable"),
    ).withColumn("risk_modifier", F.coalesce("risk_modifier", F.lit(0.0)))
    wrong = (
        F.col("_unreadable")
        | F.col("fantacalcio_id").isNull()
        | F.col("valid_from").isNull()
        | ~F.coalesce(F.col("expected_start_share").between(0, 1), F.lit(True))
        | ~F.col("risk_modifier").between(-1, 1)
    )
    _refuse(typed.filter(wrong), "overrides are wrong")
    return typed.drop("_unreadable")


def apply_overrides(stored: DataFrame, new: DataFrame) -> DataFrame:
    return upsert(stored, new, ["fantacalcio_id", "season", "valid_from"], ["source", "note"])
