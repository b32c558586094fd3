"""Keyed changes, loads, exports, fingerprints and incremental ingestion on the driver tables."""

from __future__ import annotations

import datetime as dt
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerpitch.config import League
from ledgerpitch.functions import casts, hashing
from ledgerpitch.functions.text import season_in_text, season_key, season_start
from ledgerpitch.operators import build, normalize, upsert
from ledgerpitch.queries import seasons
from ledgerpitch.queries.seasons import LISTINGS_SQL, links_sql, ranking_sql
from ledgerpitch.queries.states import NOW
from ledgerpitch.queries.tables import read, rounded, sql_rounded
from ledgerpitch.session import durable, shared_dir
from ledgerpitch.sources import exports, lists
from ledgerpitch.streaming.ingest import ingest_available


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def upsert_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    changed = orders.filter(F.col("o_orderstatus") == "P").withColumns(
        {"o_orderstatus": F.lit("first"), "seq": F.lit(1)}
    )
    again = changed.filter(F.col("o_orderkey") % 2 == 0).withColumns(
        {"o_orderstatus": F.lit("second"), "seq": F.lit(2)}
    )
    added = orders.filter(F.col("o_orderstatus") == "F").withColumns(
        {"o_orderkey": -1 - F.col("o_orderkey"), "o_orderstatus": F.lit("new"), "seq": F.lit(1)}
    )
    batch = changed.unionByName(again).unionByName(added)
    return upsert.upsert(orders.withColumn("seq", F.lit(0)), batch, ["o_orderkey"], ["seq"])


UPSERT_SQL = """
SELECT o_orderkey, o_custkey, CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus
         WHEN o_orderkey % 2 = 0 THEN 'second' ELSE 'first' END AS o_orderstatus,
       CAST(CASE WHEN o_orderstatus <> 'P' THEN 0 WHEN o_orderkey % 2 = 0 THEN 2 ELSE 1 END AS INTEGER) AS seq
FROM orders
UNION ALL SELECT -1 - o_orderkey, o_custkey, 'new', 1 FROM orders WHERE o_orderstatus = 'F'"""


def insert_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    old = orders.filter(F.col("o_orderstatus") != "O")
    new = orders.withColumn("o_orderstatus", F.lit("late"))
    doubled = new.unionByName(new.withColumn("o_orderstatus", F.lit("later")))
    return upsert.insert_ignore(old, doubled, ["o_orderkey"], [F.col("o_orderstatus").asc()])


INSERT_IGNORE_SQL = """SELECT o_orderkey, o_custkey,
  CASE WHEN o_orderstatus = 'O' THEN 'late' ELSE o_orderstatus END AS o_orderstatus FROM orders"""


def replace_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    parents = (
        read(spark, sf_dir, "orders")
        .filter(F.col("o_orderstatus") == "P")
        .select(F.col("o_orderkey").alias("l_orderkey"))
    )
    merged = (
        lines.join(upsert.hashed_keys(parents, "l_orderkey"), "l_orderkey", "left_semi")
        .groupBy("l_orderkey")
        .agg(F.lit(0).alias("l_linenumber"), F.sum("l_quantity").alias("l_quantity"))
    )
    return upsert.replace_children(lines, merged, parents, "l_orderkey")


REPLACE_SQL = """
SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem JOIN orders ON o_orderkey = l_orderkey
WHERE o_orderstatus <> 'P'
UNION ALL
SELECT l_orderkey, CAST(0 AS INTEGER), sum(l_quantity) FROM lineitem JOIN orders ON o_orderkey = l_orderkey
WHERE o_orderstatus = 'P' GROUP BY l_orderkey"""

YEARS = tuple(range(1995, 2002))
BUDGET = 500


def _plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("api_player_id"))
    done = read(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("api_player_id"), F.year("o_orderdate").alias("season_start")
    )
    return upsert.work_plan(customers, "api_player_id", YEARS, "season_start", done)


def todo_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upsert.within_budget(_plan(spark, sf_dir), ["api_player_id", "season_start"], BUDGET)


TODO_SQL = f"""
SELECT c_custkey AS api_player_id, CAST(y AS INTEGER) AS season_start
FROM customer, (SELECT unnest(range(1995, 2002)) AS y)
WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND year(o_orderdate) = y)
ORDER BY 1, 2 LIMIT {BUDGET}"""


def ingest_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = ["api_player_id", "season_start"]
    statuses = seasons.backfills(spark, sf_dir)
    customers = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("api_player_id"))
    planned = customers.withColumn("season_start", F.explode(F.array(*[F.lit(y) for y in YEARS])))
    return upsert.ingest_summary(
        planned,
        statuses.filter(F.col("status") == "complete"),
        statuses.filter(F.col("status") == "paused"),
        key,
    )


SUMMARY_SQL = """
WITH statuses AS (
  SELECT DISTINCT o_custkey AS c, year(o_orderdate) AS y, (o_custkey + year(o_orderdate)) % 4 = 0 AS done
  FROM orders
), planned AS (SELECT c_custkey AS c, unnest(range(1995, 2002)) AS y FROM customer)
SELECT count(*) AS planned, CAST(count_if(done) AS BIGINT) AS already_complete,
       CAST(count_if(NOT done) AS BIGINT) AS failed, CAST(count_if(done IS NULL) AS BIGINT) AS deferred
FROM planned LEFT JOIN statuses USING (c, y)"""


def json_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns packed as nested JSON with one entry per line, then read back and flattened."""
    line = T.StructType([T.StructField("text", T.StringType()), T.StructField("chars", T.StringType())])
    schema = T.StructType(
        [
            T.StructField("turn", T.StructType([T.StructField(n, T.StringType()) for n in ("conv", "number", "role")])),
            T.StructField("lines", T.ArrayType(line)),
        ]
    )
    packed = read(spark, sf_dir, "conversations").select(
        F.to_json(
            F.struct(
                F.struct(
                    F.col("conv_id").alias("conv"), F.col("turn").alias("number"), "role"
                ).alias("turn"),
                F.transform(
                    F.split("text", "\n"),
                    lambda x: F.struct(x.alias("text"), F.length(x).cast("string").alias("chars")),
                ).alias("lines"),
            )
        ).alias("body")
    )
    return (
        packed.select(F.from_json("body", schema).alias("b"))
        .select("b.turn", F.posexplode("b.lines").alias("line_index", "line"))
        .select(
            casts.to_long(F.col("turn.conv")).alias("conv_id"),
            casts.to_long(F.col("turn.number")).alias("turn"),
            F.col("turn.role").alias("role"),
            "line_index",
            F.col("line.text").alias("line"),
            casts.to_long(F.col("line.chars")).alias("chars"),
        )
    )


JSON_FLATTEN_SQL = """
SELECT conv_id, turn, role, CAST(i - 1 AS INTEGER) AS line_index, lines[i] AS line,
       CAST(length(lines[i]) AS BIGINT) AS chars
FROM (SELECT *, unnest(range(1, len(lines) + 1)) AS i
      FROM (SELECT *, string_split(text, chr(10)) AS lines FROM conversations))"""


def kv_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event properties as a list of type and value; the last of equal types wins."""
    k = F.from_json("props", T.MapType(T.StringType(), T.StringType()))["k"]

    def pair(kind: str, value):
        return F.struct(F.lit(kind).alias("type"), value.cast("string").alias("value"))

    pairs = F.array(
        pair("K value", F.lit("0")),
        pair("K value", k),
        pair("K share", F.concat(k, F.lit("%"))),
        pair("Amount", F.col("value") * 2),
        pair("Other", F.col("event_type")),
    )
    names = {"K value": "k_value", "K share": "k_share", "Amount": "amount"}
    return read(spark, sf_dir, "events").select(
        "event_id", *normalize.pivot_pairs(pairs, names, ("k_share",))
    )


KV_PIVOT_SQL = """
SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k_value,
       CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k_share,
       CAST(trunc(value * 2) AS INTEGER) AS amount
FROM events"""


def content_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select(
        "o_orderkey",
        hashing.content_id(
            F.col("o_custkey"),
            F.col("o_orderstatus"),
            F.to_date("o_orderdate"),
            F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")),
        ).alias("episode_id"),
    )


CONTENT_ID_SQL = """
SELECT o_orderkey, sha256(o_custkey || '|' || o_orderstatus || '|' || CAST(o_orderdate AS DATE) || '|'
  || CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderpriority ELSE '' END) AS episode_id
FROM orders"""


def table_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return hashing.ordered_fingerprint(
        orders, F.concat_ws(":", "o_orderkey", "o_custkey", "o_orderstatus"), [F.col("o_orderkey")]
    )


def _tree_sql(source: str, text: str, order: str, name: str = "fingerprint") -> str:
    """The digest tree of any height: digests of runs of 1000, until a single one is left."""
    return f"""
WITH RECURSIVE tree AS (
  SELECT 0 AS level, row_number() OVER (ORDER BY {order}) - 1 AS place, {text} AS digest FROM {source}
  UNION ALL
  SELECT any_value(level) + 1, place // 1000, md5(string_agg(digest, ',' ORDER BY place))
  FROM tree WHERE level = 0 OR (SELECT count(*) FROM tree) > 1
  GROUP BY place // 1000
)
SELECT digest AS {name} FROM tree ORDER BY level DESC LIMIT 1"""


def row_set_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders")
    return hashing.row_set_fingerprint(
        orders, ["o_orderstatus"], F.concat_ws(":", "o_orderkey", "o_custkey")
    )


_LANES = " || ':' || ".join(
    f"sum(CAST(('0x' || substr(h, {1 + 12 * i}, 12)) AS UBIGINT))" for i in range(4)
)
ROW_SET_SQL = f"""
SELECT o_orderstatus, count(*) AS rows, sha256(count(*) || ':' || {_LANES}) AS fingerprint
FROM (SELECT o_orderstatus, sha256(o_orderkey || ':' || o_custkey) AS h FROM orders)
GROUP BY o_orderstatus"""


def checked_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A season's listings written as list sheets with some wrong rows, then read and checked."""
    key = F.col("fantacalcio_id")
    listed = seasons.listings(spark, sf_dir).filter(F.col("season") == NOW)
    diff = F.col("quote_diff") + F.when(key % 50 == 0, 1).otherwise(0)
    sheet = listed.select(
        key.cast("string").alias("Id"),
        F.when(key % 61 == 0, "X").otherwise(F.col("classic_role")).alias("R"),
        F.lit("").alias("RM"),
        F.concat(F.lit(" "), "name", F.lit(" ")).alias("Nome"),
        F.col("team").alias("Squadra"),
        F.col("quote_current").alias("Qt.A"),
        F.col("quote_initial").alias("Qt.I"),
        diff.alias("Diff."),
        F.col("quote_current").alias("Qt.A M"),
        F.col("quote_initial").alias("Qt.I M"),
        F.col("quote_diff").alias("Diff.M"),
        F.when(key % 77 == 0, "n/a").otherwise(F.col("fvm").cast("string")).alias("FVM"),
        F.col("fvm").alias("FVM M"),
        "status",
    )
    root = scratch(spark, "lists")
    sold = (F.col("status") == "ceduto") | (F.col("Id").cast("bigint") % 40 == 0)
    sheet.filter(F.col("status") == "active").drop("status").write.option("header", True).csv(f"{root}/active")
    sheet.filter(sold).drop("status").write.option("header", True).csv(f"{root}/sold")
    rows = durable(
        lists.typed_list(
            lists.read_sheet(spark, f"{root}/active", "Tutti").unionByName(
                lists.read_sheet(spark, f"{root}/sold", "Ceduti")
            )
        )
    )
    twice = lists.cross_sheet_duplicates(rows)
    return rows.join(twice, "fantacalcio_id", "left").select(
        "fantacalcio_id",
        "name",
        "status",
        "quote_diff",
        "fvm",
        F.array_join("violations", "; ").alias("violations"),
        F.coalesce("copies", F.lit(1)).cast("long").alias("copies"),
    )


CHECKED_LOAD_SQL = f"""WITH {LISTINGS_SQL}, season AS (
  SELECT * FROM listings WHERE season = '{NOW}'
), sheets AS (
  SELECT *, 'active' AS sheet FROM season WHERE status = 'active'
  UNION ALL SELECT *, 'ceduto' FROM season WHERE status = 'ceduto' OR fantacalcio_id % 40 = 0
)
SELECT CAST(fantacalcio_id AS INTEGER) AS fantacalcio_id, name, sheet AS status,
       CAST(quote_diff + CASE WHEN fantacalcio_id % 50 = 0 THEN 1 ELSE 0 END AS INTEGER) AS quote_diff,
       CAST(CASE WHEN fantacalcio_id % 77 <> 0 THEN fvm END AS INTEGER) AS fvm,
       array_to_string(list_filter([
         CASE WHEN fantacalcio_id % 77 = 0 THEN 'fvm is not an integer' END,
         CASE WHEN fantacalcio_id % 61 = 0 THEN 'unknown role' END,
         CASE WHEN fantacalcio_id % 50 = 0 THEN 'quote_diff is inconsistent' END],
         lambda v: v IS NOT NULL), '; ') AS violations,
       count(*) OVER (PARTITION BY fantacalcio_id) AS copies
FROM sheets"""


def new_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders").select(
        "o_orderkey", F.year("o_orderdate").alias("year"), F.lit("new").alias("origin")
    )
    path = scratch(spark, "snapshots")
    upsert.write_partitions(
        orders.filter(F.col("year") < 1998).withColumn("origin", F.lit("base")), path, ["year"]
    )
    upsert.insert_new_partitions(spark, path, orders, "year")
    return spark.read.parquet(path)


def refresh_mart(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("orders"))
    root = scratch(spark, "mart")
    upsert.publish_version(orders.withColumn("orders", F.lit(0).cast("long")), root, "0001")
    upsert.publish_version(orders, root, "0002")
    return upsert.newest_version(spark, root)


def upsert_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders").select(
        "o_orderkey", F.year("o_orderdate").alias("year"), F.lit(0).alias("seq"), "o_orderpriority"
    )
    path = scratch(spark, "orders")
    upsert.write_partitions(orders, path, ["year"])
    changed = orders.filter((F.col("year") > 1999) & (F.col("o_orderkey") % 3 == 0)).withColumns(
        {"seq": F.lit(1), "o_orderpriority": F.lit("changed")}
    )
    upsert.upsert_path(spark, path, changed, ["year", "o_orderkey"], ["seq"], ["year"])
    return spark.read.parquet(path)


def season_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    year = F.year("o_orderdate")
    end = year + F.when(F.col("o_orderkey") % 10 == 0, 2).otherwise(1)
    title = F.concat_ws("_", F.lit("Quotazioni_Stagione"), (year + 10).cast("string"), F.lpad(((end + 10) % 100).cast("string"), 2, "0"))
    season = season_key(year, end)
    return read(spark, sf_dir, "orders").select(
        "o_orderkey",
        season.alias("season"),
        season_start(season).alias("start"),
        season_in_text(title).alias("from_title"),
    )


SEASON_KEYS_SQL = """
SELECT o_orderkey,
       CASE WHEN o_orderkey % 10 <> 0 THEN y || '/' || lpad(CAST((y + 1) % 100 AS VARCHAR), 2, '0') END AS season,
       CASE WHEN o_orderkey % 10 <> 0 THEN CAST(y AS INTEGER) END AS start,
       CASE WHEN o_orderkey % 10 <> 0 AND y + 10 >= 2000
            THEN (y + 10) || '/' || lpad(CAST((y + 11) % 100 AS VARCHAR), 2, '0') END AS from_title
FROM (SELECT o_orderkey, year(o_orderdate) AS y FROM orders)"""


BUILD = {"season": NOW, "as_of": dt.date(2001, 8, 1), "kind": "benchmark", "snapshot_id": "list-1", "code_version": "v1"}


def persist_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The identity of a build from its digests and parameters, and the rows it replaces."""
    links = seasons.links(spark, sf_dir)
    ranking = durable(seasons.ranking(spark, sf_dir, NOW).drop("projected_score", "expected_start_share"))
    none = spark.createDataFrame([], "season string, fantacalcio_id long, valid_from date, note string")
    identity = durable(
        build.build_identity(
            spark, **BUILD, league=League(), metrics=[], raw=None, mappings=links, overrides=none, projections=ranking
        ).drop("created_at")
    )
    earlier = ranking.withColumn("build_id", identity.select("build_id").scalar())
    other = ranking.withColumn("build_id", F.lit("build-other"))
    _, values = build.persist_build(identity, earlier.unionByName(other), identity, ranking)
    return values.groupBy("build_id").agg(F.count("*").alias("rows"), F.sum("official_fvm").alias("fvm"))


def _persist_sql() -> str:
    stable = lambda value: json.dumps(value, sort_keys=True, separators=(",", ":"))
    parameters = {
        "season": NOW, "as_of": BUILD["as_of"].isoformat(), "kind": BUILD["kind"], "listone": BUILD["snapshot_id"],
        "config": League().as_dict(), "version": BUILD["code_version"],
    }
    numbers = ("fantacalcio_id", "official_fvm", "official_quote", "reliability", "rosterable", "suggested_credits")
    fields = sorted([*numbers, "name", "role", "status", "team"])
    text = " || ',".join(
        f"""\"{f}\":' || {f}""" if f in numbers else f"""\"{f}\":"' || {f} || '"'""" for f in fields
    ).replace("\\", "")
    return f"""WITH {LISTINGS_SQL}, {ranking_sql(NOW, "ranking")}, {links_sql()}, m AS (
  {_tree_sql("links", "season || ':' || fantacalcio_id || ':' || api_player_id || ':' || status || ':' || method", "season, fantacalcio_id, api_player_id", "mappings")}
), r AS (
  {_tree_sql("ranking", "'{" + text + " || '}'", "fantacalcio_id", "result")}
), d AS (
  SELECT sha256('{{"mappings":"' || mappings || '","metrics":[],"overrides":null,"raw":null,"result":"'
                || result || '"}}') AS data FROM m, r
), i AS (
  SELECT 'build-' || left(sha256('{stable(parameters)}' || data), 20) AS build_id FROM d
  UNION ALL SELECT 'build-other'
)
SELECT build_id, count(*) AS rows, CAST(sum(official_fvm) AS BIGINT) AS fvm FROM ranking, i GROUP BY build_id"""


PERSIST_SQL = _persist_sql()


def export_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = scratch(spark, "export")
    ranking = durable(seasons.ranking(spark, sf_dir, NOW))
    exports.export_ranking(ranking, root)
    written = spark.read.schema(ranking.schema).option("header", True).csv(f"{root}/ranking_csv")
    return rounded(written)


EXPORT_SQL = f"""WITH {LISTINGS_SQL}, {ranking_sql(NOW, "ranking")}
SELECT * REPLACE ({sql_rounded(["expected_start_share"])}) FROM ranking"""


def incremental_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest event per user and day, kept by a stream over the event files, run twice."""
    root = scratch(spark, "events")
    source = read(spark, sf_dir, "events")
    # The stream reads a folder, so the files are landed in two deliveries.
    half = F.col("event_id") % 2 == 0
    for accepted in (half, ~half):
        source.filter(accepted).write.mode("append").parquet(f"{root}/landed")
        ingest_available(
            spark,
            f"{root}/landed",
            source.schema,
            f"{root}/target",
            f"{root}/progress",
            ["day", "user_id"],
            ["ts", "event_id"],
            ["day"],
            prepare=lambda df: df.withColumn("day", F.to_date("ts")),
        )
    return spark.read.parquet(f"{root}/target").select(
        "event_id", "user_id", "day", "event_type", "value"
    )


INCREMENTAL_SQL = """
SELECT event_id, user_id, day, event_type, value
FROM (SELECT *, CAST(ts AS DATE) AS day,
             row_number() OVER (PARTITION BY CAST(ts AS DATE), user_id ORDER BY ts DESC, event_id DESC) AS rn
      FROM events) WHERE rn = 1"""


LEDGER_KEYS = ("season_start", "league_id")


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order reports on its year and priority; the newest report of a unit stands."""
    states = F.create_map(F.lit("O"), F.lit("in_progress"), F.lit("P"), F.lit("paused"), F.lit("F"), F.lit("incomplete"))
    reports = read(spark, sf_dir, "orders").select(
        F.year("o_orderdate").alias("season_start"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("league_id"),
        F.when(F.col("o_orderkey") % 4 == 0, "complete").otherwise(F.try_element_at(states, F.col("o_orderstatus"))).alias("status"),
        F.concat(F.lit("order "), "o_orderkey").alias("detail"),
        F.col("o_orderkey").alias("updated_at"),
    )
    early = F.col("updated_at") % 3 == 0
    first = upsert.record_states(reports.limit(0), reports.filter(early), LEDGER_KEYS, ["updated_at"])
    return upsert.record_states(first, reports.filter(~early), LEDGER_KEYS, ["updated_at"])


LEDGER_SQL = """
SELECT CAST(year(o_orderdate) AS INTEGER) AS season_start,
       CAST(left(o_orderpriority, 1) AS INTEGER) AS league_id,
       CASE WHEN max(o_orderkey) % 4 = 0 THEN 'complete'
            ELSE CASE arg_max(o_orderstatus, o_orderkey) WHEN 'O' THEN 'in_progress'
                 WHEN 'P' THEN 'paused' ELSE 'incomplete' END END AS status,
       'order ' || max(o_orderkey) AS detail, max(o_orderkey) AS updated_at
FROM orders GROUP BY 1, 2"""


QUERIES = {
    "ledger": ledger,
    "upsert": upsert_orders,
    "insert_ignore": insert_ignore,
    "replace_children": replace_children,
    "upsert_partitions": upsert_partitions,
    "todo_plan": todo_plan,
    "ingest_summary": ingest_summary,
    "json_flatten": json_flatten,
    "kv_pivot": kv_pivot,
    "content_id": content_id,
    "table_fingerprint": table_fingerprint,
    "row_set_fingerprint": row_set_fingerprint,
    "checked_load": checked_load,
    "new_snapshots": new_snapshots,
    "refresh_mart": refresh_mart,
    "season_keys": season_keys,
    "persist_build": persist_build,
    "export_ranking": export_ranking,
    "incremental_ingest": incremental_ingest,
}
ORACLES = {
    "ledger": LEDGER_SQL,
    "upsert": UPSERT_SQL,
    "insert_ignore": INSERT_IGNORE_SQL,
    "replace_children": REPLACE_SQL,
    "upsert_partitions": """
        SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS year,
               CAST(CASE WHEN year(o_orderdate) > 1999 AND o_orderkey % 3 = 0 THEN 1 ELSE 0 END AS INTEGER) AS seq,
               CASE WHEN year(o_orderdate) > 1999 AND o_orderkey % 3 = 0 THEN 'changed'
                    ELSE o_orderpriority END AS o_orderpriority
        FROM orders""",
    "todo_plan": TODO_SQL,
    "ingest_summary": SUMMARY_SQL,
    "json_flatten": JSON_FLATTEN_SQL,
    "kv_pivot": KV_PIVOT_SQL,
    "content_id": CONTENT_ID_SQL,
    "table_fingerprint": _tree_sql(
        "orders", "o_orderkey || ':' || o_custkey || ':' || o_orderstatus", "o_orderkey"
    ),
    "row_set_fingerprint": ROW_SET_SQL,
    "checked_load": CHECKED_LOAD_SQL,
    "new_snapshots": """
        SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS year,
               CASE WHEN year(o_orderdate) < 1998 THEN 'base' ELSE 'new' END AS origin FROM orders""",
    "refresh_mart": "SELECT o_custkey, count(*) AS orders FROM orders GROUP BY o_custkey",
    "season_keys": SEASON_KEYS_SQL,
    "persist_build": PERSIST_SQL,
    "export_ranking": EXPORT_SQL,
    "incremental_ingest": INCREMENTAL_SQL,
}
