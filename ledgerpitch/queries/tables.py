"""Driver tables read as the engine's own inputs, in Spark and as SQL text."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def rounded(df: DataFrame, places: int = 6, special: Mapping[str, int] | None = None) -> DataFrame:
    """Round doubles so that summation order cannot show in the result."""
    special = special or {}
    return df.select(
        *[
            F.round(field.name, special.get(field.name, places)).alias(field.name)
            if isinstance(field.dataType, T.DoubleType)
            else F.col(field.name)
            for field in df.schema.fields
        ]
    )


def sql_rounded(names: Iterable[str], places: int = 6) -> str:
    return ", ".join(f"round({name}, {places}) AS {name}" for name in names)


#: Supplier keys stay below this, so order and supplier make one number.
MATCH_BASE = 10_000_000


def season_fixtures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order and supplier as a fixture: customer nation at home, supplier nation away.

    All lines that a supplier has in an order make up the match, since an order can hold a line
    number more than once. Lines returned with flag A score for the home side, with flag R for the
    away side.
    """
    # Dealt by order alone, the lines need not move again to meet their orders.
    lines = (
        read(spark, sf_dir, "lineitem")
        .select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_suppkey").alias("suppkey"), "l_quantity", "l_discount", "l_returnflag", "l_linestatus")
        .repartition("o_orderkey")
        .groupBy("o_orderkey", "suppkey")
        .agg(
            F.sum("l_quantity").cast("long").alias("quantity"),
            F.count("*").alias("lines"),
            F.max(F.abs("l_discount")).alias("discount"),
            F.count_if(F.col("l_returnflag") == "A").alias("home_goals"),
            F.count_if(F.col("l_returnflag") == "R").alias("away_goals"),
            F.count_if(F.col("l_returnflag") == "N").alias("quiet"),
            F.count_if(F.col("l_linestatus") == "O").alias("open_lines"),
        )
    )
    orders = read(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority"
    )
    customers = read(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("home_team_id")
    )
    suppliers = read(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("suppkey"), F.col("s_nationkey").alias("supplier_nation")
    )
    return (
        lines.join(orders.join(customers, "o_custkey"), "o_orderkey")
        .join(suppliers, "suppkey")
        .select(
            (F.col("o_orderkey").cast("long") * MATCH_BASE + F.col("suppkey")).alias("fixture_id"),
            F.lit(135).alias("league_id"),
            F.year("o_orderdate").alias("season_start"),
            F.col("o_orderdate").alias("kickoff_at"),
            F.when(F.col("o_orderstatus") == "F", "FT")
            .when(F.col("o_orderstatus") == "O", "AET")
            .otherwise("NS")
            .alias("status_short"),
            "home_team_id",
            F.when(
                F.col("supplier_nation") == F.col("home_team_id"),
                (F.col("supplier_nation") + 1) % 25,
            )
            .otherwise(F.col("supplier_nation"))
            .alias("away_team_id"),
            "home_goals",
            "away_goals",
            F.col("o_custkey").alias("home_player"),
            (-1 - F.col("suppkey")).alias("away_player"),
            "quantity",
            "lines",
            "discount",
            "quiet",
            "open_lines",
            "o_orderpriority",
        )
    )


def season_lineups(fixtures: DataFrame) -> DataFrame:
    """The customer plays for the home side, the supplier for the away side."""
    starter = lambda rule: F.when(rule, "starter").otherwise("substitute")
    return fixtures.select(
        "fixture_id",
        F.explode(
            F.array(
                F.struct(
                    F.col("home_team_id").alias("team_id"),
                    F.col("home_player").alias("api_player_id"),
                    starter(F.col("quantity") >= 20).alias("lineup_type"),
                ),
                F.struct(
                    F.col("away_team_id").alias("team_id"),
                    F.col("away_player").alias("api_player_id"),
                    starter(F.col("quantity") > 30).alias("lineup_type"),
                ),
            )
        ).alias("entry"),
    ).select("fixture_id", "entry.*")


def season_stats(fixtures: DataFrame) -> DataFrame:
    """Player statistics; orders of the lowest priority have none."""
    shared = [
        F.when(F.col("o_orderpriority") != "1-URGENT", F.col("o_orderpriority")).alias("position"),
        F.least(F.col("quantity"), F.lit(90).cast("long")).alias("minutes"),
        (F.col("discount") * 100).alias("rating"),
        F.col("quiet").alias("assists"),
        F.col("lines").alias("shots_on"),
        F.col("open_lines").alias("key_passes"),
        (F.col("quantity") % 2).alias("yellow_cards"),
        F.when(F.col("quantity") % 17 == 0, 1).otherwise(0).cast("long").alias("red_cards"),
    ]
    home = F.struct(
        F.col("home_team_id").alias("team_id"),
        F.col("home_player").alias("api_player_id"),
        F.col("home_goals").alias("goals"),
        *shared,
    )
    away = F.struct(
        F.col("away_team_id").alias("team_id"),
        F.col("away_player").alias("api_player_id"),
        F.col("away_goals").alias("goals"),
        *shared,
    )
    return (
        fixtures.filter(F.col("o_orderpriority") != "5-LOW")
        .select("fixture_id", F.explode(F.array(home, away)).alias("entry"))
        .select("fixture_id", "entry.*")
    )


SEASON_SQL = f"""
fixtures AS (
  SELECT CAST(o_orderkey AS BIGINT) * {MATCH_BASE} + s_suppkey AS fixture_id, 135 AS league_id,
         CAST(year(any_value(o_orderdate)) AS INTEGER) AS season_start,
         any_value(o_orderdate) AS kickoff_at,
         CASE any_value(o_orderstatus) WHEN 'F' THEN 'FT' WHEN 'O' THEN 'AET' ELSE 'NS' END
           AS status_short,
         any_value(c_nationkey) AS home_team_id,
         CAST(any_value(CASE WHEN s_nationkey = c_nationkey THEN (s_nationkey + 1) % 25
                             ELSE s_nationkey END) AS INTEGER) AS away_team_id,
         CAST(count_if(l_returnflag = 'A') AS BIGINT) AS home_goals,
         CAST(count_if(l_returnflag = 'R') AS BIGINT) AS away_goals,
         any_value(o_custkey) AS home_player, -1 - s_suppkey AS away_player,
         CAST(sum(l_quantity) AS BIGINT) AS quantity, count(*) AS lines,
         max(abs(l_discount)) AS discount, CAST(count_if(l_returnflag = 'N') AS BIGINT) AS quiet,
         CAST(count_if(l_linestatus = 'O') AS BIGINT) AS open_lines,
         any_value(o_orderpriority) AS o_orderpriority
  FROM lineitem
  JOIN orders ON o_orderkey = l_orderkey
  JOIN customer ON c_custkey = o_custkey
  JOIN supplier ON s_suppkey = l_suppkey
  GROUP BY o_orderkey, s_suppkey
), lineups AS (
  SELECT fixture_id, home_team_id AS team_id, home_player AS api_player_id,
         CASE WHEN quantity >= 20 THEN 'starter' ELSE 'substitute' END AS lineup_type FROM fixtures
  UNION ALL
  SELECT fixture_id, away_team_id, away_player,
         CASE WHEN quantity > 30 THEN 'starter' ELSE 'substitute' END FROM fixtures
), stats AS (
  SELECT fixture_id, team_id, api_player_id, goals, position, minutes, rating, assists, shots_on,
         key_passes, yellow_cards, red_cards
  FROM (
    SELECT *, CASE WHEN o_orderpriority <> '1-URGENT' THEN o_orderpriority END AS position,
           least(quantity, 90) AS minutes, discount * 100 AS rating, quiet AS assists,
           lines AS shots_on, open_lines AS key_passes, quantity % 2 AS yellow_cards,
           CASE WHEN quantity % 17 = 0 THEN 1 ELSE 0 END AS red_cards,
           unnest([home_team_id, away_team_id]) AS team_id,
           unnest([home_player, away_player]) AS api_player_id,
           unnest([home_goals, away_goals]) AS goals
    FROM fixtures WHERE o_orderpriority <> '5-LOW'
  )
)"""
