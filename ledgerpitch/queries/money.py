"""Apportionment, tiers and prices on the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerpitch.config import ROLES, League, RoleRule
from ledgerpitch.operators import allocate
from ledgerpitch.queries.tables import read, rounded

#: Units to split and cap of a customer, for each customer of a segment; so caps bind at any scale.
UNITS_EACH = 20
CAP = 30
SLOTS = 100
#: Two leagues of the customers, by nation, that buy two players or four of each role.
LEAGUE = League(
    rules={"P": RoleRule(1, 0.1, 30), "D": RoleRule(2, 0.2, 30), "C": RoleRule(2, 0.3, 50), "A": RoleRule(1, 0.4, 60)},
    teams=2,
    budget=100,
)


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = read(spark, sf_dir, "customer").select(
        "c_mktsegment", "c_custkey", F.greatest(F.col("c_acctbal"), F.lit(0.0)).alias("weight")
    )
    sizes = customers.groupBy("c_mktsegment").agg((F.count("*") * UNITS_EACH).alias("total"))
    return customers.join(sizes, "c_mktsegment")


def largest_remainder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return allocate.largest_remainder(
        _customers(spark, sf_dir), ["c_mktsegment"], "c_custkey", "weight", "total"
    ).select("c_mktsegment", "c_custkey", "units")


# Balances are whole cents, so shares are exact fractions of integers.
LARGEST_REMAINDER_SQL = f"""
WITH cents AS (
  SELECT c_mktsegment, c_custkey, CAST(round(greatest(c_acctbal, 0) * 100) AS HUGEINT) AS cents
  FROM customer
), segments AS (
  SELECT c_mktsegment, CAST(sum(cents) AS HUGEINT) AS all_cents, count(*) * {UNITS_EACH} AS total
  FROM cents GROUP BY c_mktsegment
), shares AS (
  SELECT c_mktsegment, c_custkey, total, CAST(total * cents // all_cents AS BIGINT) AS whole,
         total * cents % all_cents AS remainder
  FROM cents JOIN segments USING (c_mktsegment)
), served AS (
  SELECT c_mktsegment, unnest(list(c_custkey ORDER BY remainder DESC, c_custkey)
           [1:any_value(total) - CAST(sum(whole) AS BIGINT)]) AS c_custkey
  FROM shares GROUP BY c_mktsegment
)
SELECT c_mktsegment, c_custkey,
       whole + CAST((c_mktsegment, c_custkey) IN (FROM served) AS BIGINT) AS units
FROM shares"""


def tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = allocate.tiers(
        read(spark, sf_dir, "customer").select("c_mktsegment", "c_custkey", "c_acctbal"),
        ["c_mktsegment"],
        "c_acctbal",
        "c_custkey",
        F.lit(SLOTS),
    )
    return rounded(ranked)


TIERS_SQL = f"""
WITH ranked AS (
  SELECT c_mktsegment, c_custkey, c_acctbal,
         row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS rank
  FROM customer
)
SELECT *, rank <= {SLOTS} AS rosterable,
       CASE WHEN rank > {SLOTS} THEN 'E' WHEN rank / {SLOTS} <= 0.10 THEN 'S'
            WHEN rank / {SLOTS} <= 0.30 THEN 'A' WHEN rank / {SLOTS} <= 0.60 THEN 'B'
            WHEN rank / {SLOTS} <= 0.85 THEN 'C' ELSE 'D' END AS tier,
       max(CASE WHEN rank = {SLOTS} THEN c_acctbal END) OVER (PARTITION BY c_mktsegment)
         AS replacement
FROM ranked"""


def _capped_sql(source: str) -> str:
    """Units of ``source`` (grp, id, weight, cap, total): rounds of largest remainders over the rows
    below their cap, until a group has nothing left to give."""
    return f"""
rounds AS (
  SELECT 0 AS round, grp, id, weight, cap, CAST(0 AS BIGINT) AS units, CAST(total AS BIGINT) AS rest
  FROM {source}
  UNION ALL
  SELECT round + 1, grp, id, weight, cap, units + given,
         rest - CAST(sum(given) OVER (PARTITION BY grp) AS BIGINT)
  FROM (
    SELECT *, least(whole + CAST(place <= rest - all_whole AS BIGINT), cap - units) * is_open AS given
    FROM (
      SELECT *, CAST(floor(share) AS BIGINT) AS whole,
             CAST(sum(CAST(floor(share) AS BIGINT)) OVER (PARTITION BY grp) AS BIGINT) AS all_whole,
             row_number() OVER (PARTITION BY grp ORDER BY is_open DESC, share - floor(share) DESC, id)
               AS place
      FROM (
        SELECT *, is_open * rest * CASE WHEN open_weight > 0 THEN weight / open_weight
                                        ELSE 1 / open_rows END AS share
        FROM (
          SELECT *, CAST(units < cap AS BIGINT) AS is_open,
                 sum(CASE WHEN units < cap THEN weight END) OVER (PARTITION BY grp) AS open_weight,
                 sum(CASE WHEN units < cap THEN 1.0 END) OVER (PARTITION BY grp) AS open_rows
          FROM rounds WHERE rest > 0))))
), capped AS (
  SELECT grp, id, max(units) AS units FROM rounds GROUP BY grp, id
)"""


def capped_allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _customers(spark, sf_dir).withColumn("cap", F.lit(CAP))
    return allocate.capped_allocation(
        rows, ["c_mktsegment"], "c_custkey", "weight", "cap", "total"
    ).select("c_mktsegment", "c_custkey", "units")


CAPPED_SQL = f"""
WITH RECURSIVE source AS (
  SELECT c_mktsegment AS grp, c_custkey AS id, CAST(greatest(c_acctbal, 0) AS DOUBLE) AS weight,
         CAST({CAP} AS BIGINT) AS cap, {UNITS_EACH} * count(*) OVER (PARTITION BY c_mktsegment) AS total
  FROM customer
), {_capped_sql("source")}
SELECT grp AS c_mktsegment, id AS c_custkey, units FROM capped"""


def price_allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    roles = F.array(*[F.lit(role) for role in ROLES])
    projections = read(spark, sf_dir, "customer").select(
        (F.col("c_nationkey") % 2).alias("league"),
        F.get(roles, (F.col("c_custkey") % 4).cast("int")).alias("role"),
        F.col("c_custkey").alias("fantacalcio_id"),
        F.col("c_acctbal").alias("projected_score"),
    )
    return rounded(allocate.allocate_prices(projections, LEAGUE, ["league"]))


def _price_sql() -> str:
    pool, caps, spare = LEAGUE.pool(), LEAGUE.each("cap"), allocate.role_budgets(LEAGUE)
    rules = ", ".join(f"('{role}', {pool[role]}, {caps[role]}, {spare[role]})" for role in ROLES)
    return f"""
WITH RECURSIVE rules(role, needed, cap, spare) AS (VALUES {rules}), players AS (
  SELECT c_nationkey % 2 AS league, ['P', 'D', 'C', 'A'][c_custkey % 4 + 1] AS role,
         c_custkey AS fantacalcio_id, c_acctbal AS projected_score
  FROM customer
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY league, role
                               ORDER BY projected_score DESC, fantacalcio_id) AS rank
  FROM players
), source AS (
  SELECT league || r.role AS grp, fantacalcio_id AS id, CAST(cap - 1 AS BIGINT) AS cap, spare AS total,
         greatest(projected_score - (SELECT projected_score FROM ranked l
           WHERE l.league = r.league AND l.role = r.role AND l.rank = needed), 0.01)
           ^ {LEAGUE.price_curve_gamma} AS weight
  FROM ranked r JOIN rules ON rules.role = r.role WHERE rank <= needed
), {_capped_sql("source")}
SELECT league, ranked.role, fantacalcio_id, round(projected_score, 6) AS projected_score, rank,
       rank <= needed AS rosterable,
       CASE WHEN rank > needed THEN 'E' WHEN rank <= 0.10 * needed THEN 'S'
            WHEN rank <= 0.30 * needed THEN 'A' WHEN rank <= 0.60 * needed THEN 'B'
            WHEN rank <= 0.85 * needed THEN 'C' ELSE 'D' END AS tier,
       coalesce(units, 0) + 1 AS suggested_credits
FROM ranked JOIN rules ON rules.role = ranked.role LEFT JOIN capped ON id = fantacalcio_id"""


QUERIES = {
    "largest_remainder": largest_remainder,
    "tiers": tiers,
    "capped_allocation": capped_allocation,
    "price_allocation": price_allocation,
}
ORACLES = {
    "largest_remainder": LARGEST_REMAINDER_SQL,
    "tiers": TIERS_SQL,
    "capped_allocation": CAPPED_SQL,
    "price_allocation": _price_sql(),
}
