"""From stored tables to a published build: projections, prices, identity and persistence."""

from __future__ import annotations

import dataclasses
import datetime as dt
import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerpitch.config import ROLES, League
from ledgerpitch.functions.hashing import ordered_fingerprint, row_set_fingerprint
from ledgerpitch.operators import allocate, asof, forecast, history, latest, report_tables, valuation
from ledgerpitch.operators.upsert import without
from ledgerpitch.session import durable

# Kinds of builds; a benchmark build does without the list's own value.
KINDS = ("preseason", "september", "benchmark")


@dataclass(frozen=True)
class Warehouse:
    """The stored tables a build reads."""

    players: DataFrame
    mappings: DataFrame
    season_stats: DataFrame
    loads: DataFrame
    backfills: DataFrame
    mart: DataFrame
    overrides: DataFrame
    injuries: DataFrame
    sidelined: DataFrame


def train_and_project(
    tables: Warehouse,
    season: str,
    as_of: dt.date,
    league: League,
    *,
    use_list_anchor: bool = True,
    availability_trees: forecast.TreeSettings = forecast.AVAILABILITY_TREES,
    outcome_trees: forecast.TreeSettings = forecast.OUTCOME_TREES,
) -> tuple[DataFrame, list[dict]]:
    """Published projections of all active players and the metrics of every gate."""
    start = int(season.split("/")[0])
    day = F.lit(as_of)
    spark = tables.players.sparkSession
    players = durable(tables.players)
    actuals = durable(
        history.season_actuals(tables.mappings, tables.season_stats, tables.loads, tables.backfills)
    )
    examples = durable(history.build_examples(players, actuals))
    target = durable(history.target_rows(players, examples, actuals, season))
    if target.isEmpty():
        raise ValueError(f"no active players for {season}")
    past = examples.filter(F.col("season_start") < start)
    outcomes = past.filter(F.col("realized_score").isNotNull())

    train, validation = forecast.temporal_split(tables.mart, start)
    current = durable(
        asof.current_state(asof.state_as_of(tables.mart, day), tables.mappings, season)
    )
    forecasts, checked = forecast.availability_forecasts(
        train, validation, current, availability_trees
    )
    metrics = _availability_metrics(checked)
    if forecasts is None:
        forecasts = spark.createDataFrame(
            [],
            "fantacalcio_id int, forecast_start double, forecast_minutes double,"
            "used_start_model boolean, used_minutes_model boolean",
        )

    counts = {
        row["classic_role"]: row["n"]
        for row in outcomes.groupBy("classic_role").agg(F.count("*").alias("n")).collect()
    }
    scored = forecast.out_of_fold(outcomes, forecast.backtest_folds(outcomes), outcome_trees)
    gates = {}
    if scored is not None:
        gates = {
            row["classic_role"]: row.asDict()
            for row in forecast.outcome_gate(durable(scored)).collect()
        }
    weights = {role: gate["ml_weight"] for role, gate in gates.items() if gate["use_ml"]}
    predicted = forecast.outcome_predictions(outcomes, target, weights, outcome_trees) if weights else None
    if predicted is None:
        predicted = spark.createDataFrame([], "fantacalcio_id int, raw_outcome double, ml_weight double")
    for role in ROLES:
        gate = gates.get(role, {})
        metrics.append(
            {
                "role": role,
                "train_count": counts.get(role, 0),
                "validation_count": gate.get("validation_count", 0),
                "baseline_mae": gate.get("baseline_mae"),
                "ml_mae": gate.get("ml_mae"),
                "baseline_spearman": gate.get("baseline_spearman"),
                "ml_spearman": gate.get("ml_spearman"),
                "use_ml": gate.get("use_ml", False),
                "ml_weight": gate.get("ml_weight", 0.0),
            }
        )
    links = report_tables.accepted_links(tables.mappings, season)
    projections = valuation.project(
        target,
        valuation.role_ratios(past),
        scoring=league.scoring,
        overrides=latest.current_overrides(tables.overrides, season, day),
        injured=report_tables.unavailable_players(links, tables.injuries, tables.sidelined, start, day),
        forecasts=forecasts,
        outcomes=predicted,
        use_list_anchor=use_list_anchor,
    )
    return durable(valuation.published(projections)), metrics


def _availability_metrics(gates: list[forecast.Gate]) -> list[dict]:
    return [
        {
            "role": gate.label,
            "train_count": gate.trained,
            "validation_count": gate.checked,
            "baseline_mae": gate.baseline,
            "ml_mae": gate.model,
            "baseline_spearman": None,
            "ml_spearman": None,
            "use_ml": gate.used,
            "ml_weight": float(gate.used),
        }
        for gate in gates
    ]


def joined_text(*columns: Column) -> Column:
    return F.concat_ws(":", *[F.coalesce(column.cast("string"), F.lit("")) for column in columns])


def mapping_fingerprint(mappings: DataFrame) -> DataFrame:
    names = ("season", "fantacalcio_id", "api_player_id", "status", "method")
    return ordered_fingerprint(
        mappings,
        joined_text(*[F.col(name) for name in names]),
        [F.col(name) for name in names[:3]],
    )


def override_fingerprint(overrides: DataFrame) -> DataFrame:
    names = ("season", "fantacalcio_id", "valid_from")
    return ordered_fingerprint(
        overrides, joined_text(*[F.col(n) for n in names], F.col("note")), [F.col(n) for n in names]
    )


def raw_fingerprint(index: DataFrame) -> DataFrame:
    return ordered_fingerprint(
        index, joined_text(F.col("response_id"), F.col("payload_sha256")), [F.col("response_id")]
    )


def result_fingerprint(projections: DataFrame, key: str = "fantacalcio_id") -> DataFrame:
    """Digest of all result rows; columns in name order, so their position does not matter."""
    text = F.to_json(F.struct(*sorted(projections.columns)), {"ignoreNullFields": "false"})
    return ordered_fingerprint(projections, text, [F.col(key)])


def _only(df: DataFrame) -> str | None:
    row = df.first()
    return None if row is None else row[0]


def build_identity(
    spark: SparkSession,
    *,
    season: str,
    as_of: dt.date,
    kind: str,
    snapshot_id: str,
    league: League,
    metrics: list[dict],
    code_version: str,
    raw: DataFrame | None,
    mappings: DataFrame,
    overrides: DataFrame,
    projections: DataFrame,
) -> DataFrame:
    """One row: build id and data fingerprint from four digests and the build's parameters.

    Only digests reach the driver, never rows.
    """
    if kind not in KINDS:
        raise ValueError(f"the kind of a build is one of {KINDS}")

    def stable(value: object) -> str:
        return json.dumps(value, sort_keys=True, separators=(",", ":"))

    data = {
        "raw": None if raw is None else _only(raw_fingerprint(raw)),
        "mappings": _only(mapping_fingerprint(mappings)),
        "overrides": _only(override_fingerprint(overrides)),
        "metrics": metrics,
        "result": _only(result_fingerprint(projections)),
    }
    material = spark.range(1).select(F.sha2(F.lit(stable(data)), 256).alias("data_fingerprint"))
    parameters = {
        "season": season,
        "as_of": as_of.isoformat(),
        "kind": kind,
        "listone": snapshot_id,
        "config": league.as_dict(),
        "version": code_version,
    }
    identity = F.sha2(F.concat(F.lit(stable(parameters)), F.col("data_fingerprint")), 256)
    return material.select(
        F.concat(F.lit("build-"), F.substring(identity, 1, 20)).alias("build_id"),
        F.lit(season).alias("season"),
        F.lit(as_of).alias("as_of"),
        F.lit(kind).alias("snapshot_kind"),
        F.lit(snapshot_id).alias("listone_snapshot_id"),
        F.lit(stable(league.as_dict())).alias("config_json"),
        F.lit(stable(metrics)).alias("model_metrics_json"),
        F.lit(code_version).alias("code_version"),
        "data_fingerprint",
        F.current_timestamp().alias("created_at"),
    )


def persist_build(
    builds: DataFrame, values: DataFrame, build: DataFrame, ranking: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Add a build and its rows; an earlier run of the same build is replaced."""
    build_id = build.select("build_id").first()[0]
    stamped = ranking.withColumn("build_id", F.lit(build_id))
    kept_builds = without(builds, build, ["build_id"])
    kept_values = values.filter(F.col("build_id") != build_id)
    return (
        kept_builds.unionByName(build.select(*builds.columns)),
        kept_values.unionByName(stamped.select(*values.columns)),
    )


def season_fingerprints(values: DataFrame, keys: list[str]) -> DataFrame:
    """Order-free digest of the rows of every build or season in one pass."""
    text = F.to_json(F.struct(*sorted(values.columns)), {"ignoreNullFields": "false"})
    return row_set_fingerprint(values, keys, text)


def price(projections: DataFrame, league: League) -> DataFrame:
    return allocate.allocate_prices(projections, league)


def as_config(league: League) -> dict:
    return dataclasses.asdict(league)
