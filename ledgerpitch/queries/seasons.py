"""Customers and orders read as listed players, provider statistics, links and rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerpitch.functions.text import season_key
from ledgerpitch.queries.tables import read

AS_OF = "2001-08-01"


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with orders in a year, listed once per year."""
    year = F.year("o_orderdate")
    # 2^31 exceeds every order of a customer in a day, so the newest order decides the status.
    yearly = (
        read(spark, sf_dir, "orders")
        .groupBy(F.col("o_custkey").alias("c_custkey"), year.alias("start"))
        .agg(
            F.count("*").alias("orders"),
            F.count_if(F.month("o_orderdate") <= 6).alias("early"),
            F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("cents"),
            F.max("o_orderpriority").alias("team"),
            F.max_by("o_orderstatus", F.struct("o_orderdate", "o_orderkey")).alias("newest_status"),
        )
    )
    customers = read(spark, sf_dir, "customer").select("c_custkey", "c_name")
    roles = F.array(*[F.lit(role) for role in ("P", "D", "C", "A")])
    return yearly.join(customers, "c_custkey").select(
        season_key(F.col("start"), F.col("start") + 1).alias("season"),
        F.col("c_custkey").alias("fantacalcio_id"),
        F.get(roles, (F.col("orders") % 4).cast("int")).alias("classic_role"),
        F.col("c_name").alias("name"),
        "team",
        F.col("orders").alias("quote_current"),
        F.col("early").alias("quote_initial"),
        (F.col("orders") - F.col("early")).alias("quote_diff"),
        F.floor(F.col("cents") / 100000).alias("fvm"),
        F.when(F.col("newest_status") == "P", "ceduto").otherwise("active").alias("status"),
    )


LISTINGS_SQL = """
yearly AS (
  SELECT o_custkey AS c_custkey, CAST(year(o_orderdate) AS INTEGER) AS start, count(*) AS orders,
         CAST(count_if(month(o_orderdate) <= 6) AS BIGINT) AS early,
         CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents,
         max(o_orderpriority) AS team,
         arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS newest_status
  FROM orders GROUP BY ALL
), listings AS (
  SELECT start || '/' || lpad(CAST((start + 1) % 100 AS VARCHAR), 2, '0') AS season,
         c_custkey AS fantacalcio_id, ['P', 'D', 'C', 'A'][orders % 4 + 1] AS classic_role,
         c_name AS name, team, orders AS quote_current, early AS quote_initial,
         orders - early AS quote_diff, CAST(floor(cents / 100000) AS BIGINT) AS fvm,
         CASE WHEN newest_status = 'P' THEN 'ceduto' ELSE 'active' END AS status
  FROM yearly JOIN customer USING (c_custkey)
)"""


def season_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines per customer, year and priority as provider season statistics."""
    orders = read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"),
        F.col("o_custkey").alias("api_player_id"),
        F.year("o_orderdate").alias("season_start"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("league_id"),
    )
    lines = read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_quantity", "l_discount", "l_returnflag", "l_linestatus"
    )
    return (
        lines.join(orders, "l_orderkey")
        .groupBy("api_player_id", "season_start", "league_id")
        .agg(
            F.sum("l_quantity").cast("long").alias("minutes"),
            F.count_if(F.col("l_returnflag") == "A").alias("goals"),
            F.count_if(F.col("l_returnflag") == "N").alias("assists"),
            F.count_if(F.col("l_returnflag") == "R").alias("yellow_cards"),
            F.count_if((F.col("l_linestatus") == "F") & (F.col("l_quantity") > 45)).alias("red_cards"),
            (F.max(F.abs("l_discount")) * 100).alias("rating"),
        )
    )


STATS_SQL = """
season_stats AS (
  SELECT o_custkey AS api_player_id, CAST(year(o_orderdate) AS INTEGER) AS season_start,
         CAST(left(o_orderpriority, 1) AS INTEGER) AS league_id,
         CAST(sum(l_quantity) AS BIGINT) AS minutes,
         CAST(count_if(l_returnflag = 'A') AS BIGINT) AS goals,
         CAST(count_if(l_returnflag = 'N') AS BIGINT) AS assists,
         CAST(count_if(l_returnflag = 'R') AS BIGINT) AS yellow_cards,
         CAST(count_if(l_linestatus = 'F' AND l_quantity > 45) AS BIGINT) AS red_cards,
         max(abs(l_discount)) * 100 AS rating
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL
)"""


def loads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Load status per year and priority."""
    return (
        read(spark, sf_dir, "orders")
        .select(
            F.year("o_orderdate").alias("season_start"),
            F.substring("o_orderpriority", 1, 1).cast("int").alias("league_id"),
        )
        .distinct()
        .select(
            F.lit("/players").alias("endpoint"),
            "season_start",
            "league_id",
            F.when((F.col("season_start") + F.col("league_id")) % 3 != 0, "complete")
            .otherwise("in_progress")
            .alias("status"),
        )
    )


def backfills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Backfill status per customer and year."""
    return (
        read(spark, sf_dir, "orders")
        .select(F.col("o_custkey").alias("api_player_id"), F.year("o_orderdate").alias("season_start"))
        .distinct()
        .withColumn(
            "status",
            F.when((F.col("api_player_id") + F.col("season_start")) % 4 == 0, "complete").otherwise(
                "paused"
            ),
        )
    )


LOADS_SQL = """
loads AS (
  SELECT DISTINCT '/players' AS endpoint, CAST(year(o_orderdate) AS INTEGER) AS season_start,
         CAST(left(o_orderpriority, 1) AS INTEGER) AS league_id,
         CASE WHEN (year(o_orderdate) + CAST(left(o_orderpriority, 1) AS INTEGER)) % 3 <> 0
              THEN 'complete' ELSE 'in_progress' END AS status
  FROM orders
), backfills AS (
  SELECT DISTINCT o_custkey AS api_player_id, CAST(year(o_orderdate) AS INTEGER) AS season_start,
         CASE WHEN (o_custkey + year(o_orderdate)) % 4 = 0 THEN 'complete' ELSE 'paused' END AS status
  FROM orders
)"""


def links(spark: SparkSession, sf_dir: str, season: str = "2000/01") -> DataFrame:
    """Customers linked to themselves; the nation decides how far the decision is."""
    nation = F.col("c_nationkey") % 5
    return read(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("fantacalcio_id"),
        F.col("c_custkey").alias("api_player_id"),
        F.lit(season).alias("season"),
        F.when(nation == 0, "pending").when(nation == 1, "excluded").otherwise("accepted").alias("status"),
        F.lit("exact_name").alias("method"),
        (F.lit(0.7) + F.col("c_nationkey") / 100.0).alias("confidence"),
    )


def links_sql(season: str = "2000/01") -> str:
    return f"""
links AS (
  SELECT c_custkey AS fantacalcio_id, c_custkey AS api_player_id, '{season}' AS season,
         CASE c_nationkey % 5 WHEN 0 THEN 'pending' WHEN 1 THEN 'excluded' ELSE 'accepted' END
           AS status,
         'exact_name' AS method, CAST(0.7 AS DOUBLE) + c_nationkey / 100.0 AS confidence
  FROM customer
)"""


def ranking(spark: SparkSession, sf_dir: str, season: str) -> DataFrame:
    """The listings of one year as a published ranking."""
    return (
        listings(spark, sf_dir)
        .filter(F.col("season") == season)
        .select(
            "fantacalcio_id",
            "name",
            "team",
            F.col("classic_role").alias("role"),
            "status",
            F.col("quote_current").alias("official_quote"),
            F.col("fvm").alias("official_fvm"),
            (F.col("fvm") % 97 + 1).alias("suggested_credits"),
            (F.col("fvm") / 10.0).alias("projected_score"),
            (F.col("quote_current") >= 2).alias("rosterable"),
            (F.col("quote_initial") / F.col("quote_current")).alias("expected_start_share"),
            (35 + 12 * F.least(F.col("quote_current"), F.lit(4))).alias("reliability"),
        )
    )


def ranking_sql(season: str, name: str) -> str:
    return f"""
{name} AS (
  SELECT fantacalcio_id, name, team, classic_role AS role, status,
         quote_current AS official_quote, fvm AS official_fvm, fvm % 97 + 1 AS suggested_credits,
         CAST(fvm AS DOUBLE) / 10 AS projected_score, quote_current >= 2 AS rosterable,
         CAST(quote_initial AS DOUBLE) / quote_current AS expected_start_share,
         CAST(35 + 12 * least(quote_current, 4) AS BIGINT) AS reliability
  FROM listings WHERE season = '{season}'
)"""


def injuries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returned order lines as injuries on their ship date."""
    orders = read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("api_player_id")
    )
    return (
        read(spark, sf_dir, "lineitem")
        .filter(F.col("l_returnflag") == "R")
        .select("l_orderkey", "l_shipdate", "l_linestatus", "l_linenumber")
        .join(orders, "l_orderkey")
        .select(
            "api_player_id",
            F.year("l_shipdate").alias("season_start"),
            F.when(F.col("l_linenumber") < 3, F.concat(F.lit("line "), F.col("l_linenumber"))).alias("reason"),
            F.when(F.col("l_linestatus") == "F", "late").otherwise("").alias("injury_type"),
            F.col("l_shipdate").alias("fixture_date"),
            F.col("l_shipdate").alias("updated_at"),
        )
    )


def sidelined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error events as sidelined episodes, moved into the years of the orders."""
    events = read(spark, sf_dir, "events").filter(F.col("event_type") == "error")
    k = F.get_json_object("props", "$.k").cast("int")
    start = F.date_sub(F.to_date("ts"), 8200)
    return events.select(
        F.col("user_id").alias("api_player_id"),
        F.when(k % 2 == 0, F.concat(F.lit("error "), k)).otherwise("").alias("sidelined_type"),
        start.alias("start_date"),
        F.when(k % 3 == 0, F.date_add(start, k)).alias("end_date"),
        F.col("ts").alias("observed_at"),
    )


SIGNALS_SQL = """
notices AS (
  SELECT o_custkey AS api_player_id,
         CASE WHEN l_linenumber < 3 THEN 'line ' || l_linenumber
              WHEN l_linestatus = 'F' THEN 'late' ELSE 'Infortunio' END AS detail,
         CAST(l_shipdate AS DATE) AS start_date, CAST(NULL AS DATE) AS end_date,
         l_shipdate AS observed_at, CAST(l_shipdate AS DATE) - 45 AS shown_from,
         CAST(l_shipdate AS DATE) + 7 AS shown_to
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey
  WHERE l_returnflag = 'R' AND year(l_shipdate) = 2001
  UNION ALL
  SELECT user_id, CASE WHEN k % 2 = 0 THEN 'error ' || k ELSE 'Indisponibile' END, began, ended, ts,
         began, coalesce(ended, began + 180)
  FROM (SELECT user_id, ts, k, CAST(ts AS DATE) - 8200 AS began,
               CASE WHEN k % 3 = 0 THEN CAST(ts AS DATE) - 8200 + k END AS ended
        FROM (SELECT user_id, ts, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k
              FROM events WHERE event_type = 'error'))
), signals AS (
  SELECT fantacalcio_id, detail, start_date, end_date, observed_at
  FROM notices JOIN links USING (api_player_id)
  WHERE status = 'accepted' AND DATE '2001-08-01' BETWEEN shown_from AND shown_to
), newest_signals AS (
  SELECT fantacalcio_id, unnest(list({'detail': detail, 'start_date': start_date,
           'end_date': end_date, 'observed_at': observed_at}
         ORDER BY start_date DESC, observed_at DESC, detail, end_date DESC NULLS LAST)[1])
  FROM signals GROUP BY fantacalcio_id
)"""


def transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as transfers; odd order keys go to another nation."""
    orders = read(spark, sf_dir, "orders")
    customers = read(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("o_custkey"), "c_nationkey"
    )
    target = (F.col("c_nationkey") + F.col("o_orderkey") % 2) % 25
    return orders.join(customers, "o_custkey").select(
        F.col("o_custkey").alias("api_player_id"),
        F.to_date("o_orderdate").alias("transfer_date"),
        F.col("o_orderpriority").alias("transfer_type"),
        F.concat(F.lit("AC Nation "), target).alias("team_in_name"),
        F.concat(F.lit("nation_"), F.col("c_nationkey")).alias("team_out_name"),
        F.col("o_orderkey").alias("observed_at"),
    )


def nation_ranking(spark: SparkSession, sf_dir: str, season: str) -> DataFrame:
    """The ranking with the customer's nation as team."""
    nations = read(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    teams = (
        read(spark, sf_dir, "customer")
        .join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(F.col("c_custkey").alias("fantacalcio_id"), F.col("n_name").alias("team"))
    )
    return ranking(spark, sf_dir, season).drop("team").join(teams, "fantacalcio_id")


TRANSFERS_SQL = """
transfers AS (
  SELECT o_custkey AS api_player_id, CAST(o_orderdate AS DATE) AS transfer_date,
         o_orderpriority AS transfer_type,
         'AC Nation ' || ((c_nationkey + o_orderkey % 2) % 25) AS team_in_name,
         'nation_' || c_nationkey AS team_out_name, o_orderkey AS observed_at
  FROM orders JOIN customer ON c_custkey = o_custkey
)"""


def squads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a year as squad rows refreshed on the order date."""
    return read(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("api_player_id"),
        F.year("o_orderdate").alias("season_start"),
        F.col("o_orderpriority").alias("team_name"),
        F.col("o_orderdate").alias("updated_at"),
    )
