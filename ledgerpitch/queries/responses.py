"""The response normalisers on driver tables packed as nested responses, landed and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerpitch import schemas
from ledgerpitch.operators import normalize
from ledgerpitch.queries.tables import read, rounded
from ledgerpitch.session import shared_dir
from ledgerpitch.sources import raw

#: Keys of one landed file, so that a file stays small whatever the table's size.
KEYS_PER_FILE = 2000


def _text(value) -> Column:
    return (value if isinstance(value, Column) else F.col(value)).cast("string")


def _struct(**fields) -> Column:
    return F.struct(*[v.alias(k) for k, v in fields.items()])


def _landed(spark: SparkSession, rows: DataFrame, schema, name: str) -> DataFrame:
    """Entries of responses; ``rows`` has an entry and the key that deals it to a file, or that file.

    Responses are mostly names of fields, so they are stored as gzip.
    """
    folder = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    file = F.col("file") if "file" in rows.columns else _file("key").alias("file")
    answers = rows.groupBy(file).agg(F.collect_list("entry").alias("response"))
    body = F.to_json(
        F.array(_struct(results=F.size("response"), paging=_struct(current=F.lit(1), total=F.lit(1)), response=F.col("response")))
    )
    answers.select(body.alias("value")).write.option("maxRecordsPerFile", 1).option("compression", "gzip").text(folder)
    return normalize.entries(raw.read_responses(spark, folder, schemas.response(schema)))


def _file(key: str) -> Column:
    return F.floor(F.col(key) / KEYS_PER_FILE)


def _lines(spark: SparkSession, sf_dir: str, wanted: str = "true") -> DataFrame:
    """Each wanted order with its lines in a fixed order and the file it goes to.

    Orders and lines are dealt once, by that file, so that neither their join nor the landing has to
    move what is made of them.
    """
    line = F.struct("l_linenumber", "l_suppkey", "l_partkey", "l_returnflag", "l_linestatus", "l_quantity", "l_discount")
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), line.alias("line"))
    orders = read(spark, sf_dir, "orders").select("o_orderkey", F.struct("o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority").alias("order"))
    return (
        lines.unionByName(orders, allowMissingColumns=True)
        .filter(F.col("o_orderkey").isNotNull() & F.expr(wanted))
        .withColumn("file", _file("o_orderkey"))
        .repartition("file")
        .groupBy("file", "o_orderkey")
        .agg(F.sort_array(F.collect_list("line")).alias("lines"), F.collect_list("order").alias("orders"))
        .filter(F.size("lines") > 0)
        .select("file", "o_orderkey", "lines", F.explode("orders").alias("order"))
        .select("file", "o_orderkey", "order.*", "lines")
    )


def player_season_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    yearly = (
        read(spark, sf_dir, "orders")
        .groupBy("o_custkey", F.substring("o_orderpriority", 1, 1).alias("league"))
        .agg(F.count("*").alias("n"), F.round(F.max("o_totalprice")).cast("long").alias("top"))
    )
    one = _struct(
        league=_struct(id=F.when(F.col("league") != "3", F.col("league"))),
        team=_struct(id=_text(F.col("o_custkey") % 20), name=F.concat(F.lit("Team "), F.col("o_custkey") % 20)),
        games=_struct(appearences=_text("n"), minutes=_text(F.col("n") * 90), rating=F.concat(F.col("n") % 10, F.lit(".5")), position=F.col("league")),
        goals=_struct(total=F.when(F.col("n") > 1, _text("top")), assists=F.lit("n/a")),
        cards=_struct(yellow=_text(F.col("top") % 3)),
    )
    players = yearly.groupBy("o_custkey").agg(F.collect_list(one).alias("statistics")).join(
        read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_nationkey"), "o_custkey"
    )
    entry = _struct(
        player=_struct(id=_text("o_custkey"), name=F.col("c_name"), nationality=_text("c_nationkey"), birth=_struct(date=F.lit("1990-05-17"))),
        statistics=F.col("statistics"),
    )
    rows = _landed(spark, players.select(F.col("o_custkey").alias("key"), entry.alias("entry")), schemas.PLAYER_SEASON, "players")
    return rounded(normalize.player_seasons(rows.withColumn("season_start", F.lit(2000))))


PLAYER_SEASON_SQL = """
SELECT CAST(o_custkey AS INTEGER) AS api_player_id, 2000 AS season_start, CAST(league AS INTEGER) AS league_id,
       CAST(o_custkey % 20 AS INTEGER) AS team_id, any_value(c_name) AS player_name,
       'Team ' || (o_custkey % 20) AS team_name, DATE '1990-05-17' AS birth_date,
       CAST(any_value(c_nationkey) AS VARCHAR) AS nationality, league AS position,
       CAST(count(*) AS INTEGER) AS appearances, CAST(NULL AS INTEGER) AS lineups,
       CAST(90 * count(*) AS INTEGER) AS minutes, CAST(count(*) % 10 + 0.5 AS DOUBLE) AS rating,
       CASE WHEN count(*) > 1 THEN CAST(round(max(o_totalprice)) AS INTEGER) END AS goals,
       CAST(NULL AS INTEGER) AS assists, CAST(NULL AS INTEGER) AS shots, CAST(NULL AS INTEGER) AS shots_on,
       CAST(CAST(round(max(o_totalprice)) AS BIGINT) % 3 AS INTEGER) AS yellow_cards,
       CAST(NULL AS INTEGER) AS red_cards, CAST(NULL AS INTEGER) AS penalties_scored,
       CAST(NULL AS INTEGER) AS penalties_missed, CAST(NULL AS INTEGER) AS goals_conceded,
       CAST(NULL AS INTEGER) AS saves
FROM (SELECT *, left(o_orderpriority, 1) AS league FROM orders) JOIN customer ON c_custkey = o_custkey
WHERE league <> '3' AND o_custkey % 20 <> 0
GROUP BY o_custkey, league"""


def squad_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    person = _struct(id=_text("c_custkey"), name=F.when(F.col("c_custkey") % 5 != 0, F.col("c_name")), age=_text(F.col("c_custkey") % 40), number=F.lit("x"), position=F.substring("c_mktsegment", 1, 1))
    groups = read(spark, sf_dir, "customer").withColumn("squad", F.floor(F.col("c_custkey") / 25)).groupBy("squad").agg(F.collect_list(person).alias("players"))
    # Every third squad leaves out its team, which then is the requested one.
    team = F.when(F.col("squad") % 3 != 0, _struct(id=_text(F.col("squad") + 1), name=F.concat(F.lit("Squad "), "squad")))
    entry = _struct(team=team, players=F.col("players"))
    rows = _landed(spark, groups.select(F.col("squad").alias("key"), entry.alias("entry")), schemas.SQUAD, "squads")
    asked = {"season_start": F.lit(2001), "requested_team_id": F.lit("900"), "requested_team_name": F.lit("Asked")}
    return normalize.squads(rows.withColumns(asked))


SQUAD_SQL = """
SELECT CAST(c_custkey AS INTEGER) AS api_player_id, 2001 AS season_start,
       CAST(CASE WHEN squad % 3 <> 0 THEN squad + 1 ELSE 900 END AS INTEGER) AS team_id,
       CASE WHEN c_custkey % 5 <> 0 THEN c_name ELSE '' END AS player_name,
       CASE WHEN squad % 3 <> 0 THEN 'Squad ' || squad ELSE 'Asked' END AS team_name,
       CAST(c_custkey % 40 AS INTEGER) AS age, CAST(NULL AS INTEGER) AS number,
       left(c_mktsegment, 1) AS position
FROM (SELECT *, c_custkey // 25 AS squad FROM customer)"""


def profile_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = dict(id=_text("c_custkey"), name=F.col("c_name"), lastname=F.col("c_mktsegment"), nationality=_text("c_nationkey"), birth=_struct(date=F.when(F.col("c_custkey") % 4 != 0, F.lit("1999-02-28")).otherwise(F.lit("soon"))))
    inside = F.col("c_custkey") % 2 == 0
    # Half of the entries hold the player, the other half are the player.
    entry = _struct(player=F.when(inside, _struct(**own)), **{k: F.when(~inside, v) for k, v in own.items()})
    rows = _landed(spark, read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), entry.alias("entry")), schemas.PROFILE, "profiles")
    return normalize.profiles(rows)


PROFILE_SQL = """
SELECT CAST(c_custkey AS INTEGER) AS api_player_id, c_name AS player_name, CAST(NULL AS VARCHAR) AS firstname,
       c_mktsegment AS lastname, CASE WHEN c_custkey % 4 <> 0 THEN DATE '1999-02-28' END AS birth_date,
       CAST(c_nationkey AS VARCHAR) AS nationality, CAST(NULL AS VARCHAR) AS height,
       CAST(NULL AS VARCHAR) AS weight
FROM customer"""


def injury_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    entry = _struct(
        player=_struct(id=_text("o_custkey"), name=F.lit("Someone"), type=F.col("o_orderstatus"), reason=F.col("o_orderpriority")),
        team=_struct(id=_text(F.col("o_custkey") % 20)),
        fixture=_struct(id=_text("o_orderkey"), date=F.date_format("o_orderdate", "yyyy-MM-dd'T'12:30:00+02:00")),
        league=_struct(id=F.when(F.col("o_orderkey") % 3 == 0, F.lit("0")).otherwise(F.lit("136"))),
    )
    rows = _landed(spark, read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), entry.alias("entry")), schemas.INJURY, "injuries")
    return normalize.injuries(rows.withColumn("season_start", F.lit(1999))).withColumn("fixture_date", F.date_format("fixture_date", "yyyy-MM-dd HH:mm"))


INJURY_SQL = """
SELECT CAST(o_custkey AS INTEGER) AS api_player_id, 1999 AS season_start,
       CASE WHEN o_orderkey % 3 = 0 THEN 135 ELSE 136 END AS league_id,
       CAST(o_custkey % 20 AS INTEGER) AS team_id, CAST(o_orderkey AS INTEGER) AS fixture_id,
       'Someone' AS player_name, '' AS team_name, o_orderstatus AS injury_type,
       o_orderpriority AS reason, strftime(o_orderdate, '%Y-%m-%d 10:30') AS fixture_date
FROM orders"""


def transfer_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    def move(day: Column, name: str, target: Column) -> Column:
        return _struct(date=day, type=F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")), teams=F.struct(
            _struct(id=_text(target), name=F.lit(name)).alias("in"), _struct(id=F.lit("7"), name=F.lit("Old")).alias("out")))

    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    target = F.col("o_orderkey") % 4
    # The second move repeats the key of the first, the third has no date; target 0 is no club.
    moves = F.array(move(day, "First", target), move(day, "Last", target), move(F.lit(""), "Never", target))
    entry = _struct(player=_struct(id=_text("o_orderkey"), name=F.lit("Mover")), update=F.lit("2001-01-01"), transfers=moves)
    rows = _landed(spark, read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), entry.alias("entry")), schemas.TRANSFER, "transfers")
    return normalize.transfers(rows)


TRANSFER_SQL = """
SELECT CAST(o_orderkey AS INTEGER) AS api_player_id, 'Mover' AS player_name,
       CAST(o_orderdate AS DATE) AS transfer_date,
       CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus ELSE 'unknown' END AS transfer_type,
       CAST(o_orderkey % 4 AS INTEGER) AS team_in_id, 'Last' AS team_in_name, 7 AS team_out_id,
       'Old' AS team_out_name, '2001-01-01' AS provider_updated_at
FROM orders WHERE o_orderkey % 4 <> 0 AND o_orderkey <> 0"""


def sidelined_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    begin = F.date_format("ts", "yyyy-MM-dd")
    spell = _struct(type=F.when(F.col("event_id") % 3 != 0, F.col("event_type")).otherwise(F.lit("")), start=begin, end=F.when(F.col("event_id") % 2 == 0, F.date_format(F.date_add(F.to_date("ts"), 9), "yyyy-MM-dd")))
    empty = _struct(type=F.lit("lost"), start=F.lit(None).cast("string"), end=F.lit(None).cast("string"))
    entry = _struct(id=_text("event_id"), sidelined=F.array(empty, spell))
    rows = _landed(spark, read(spark, sf_dir, "events").select(F.col("event_id").alias("key"), entry.alias("entry")), schemas.SIDELINED, "sidelined")
    return normalize.sidelined(rows)


SIDELINED_SQL = """
SELECT sha256(event_id || '|' || kind || '|' || began || '|' || coalesce(ended, '')) AS episode_id,
       CAST(event_id AS INTEGER) AS api_player_id, kind AS sidelined_type, CAST(began AS DATE) AS start_date,
       CAST(ended AS DATE) AS end_date
FROM (SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN event_type ELSE 'unknown' END AS kind,
             strftime(ts, '%Y-%m-%d') AS began,
             CASE WHEN event_id % 2 = 0 THEN strftime(CAST(ts AS DATE) + 9, '%Y-%m-%d') END AS ended
      FROM events)"""


def _details(team: Column) -> dict[str, Column]:
    """The four detail lists of a match, one element per line of the order."""

    def each(make) -> Column:
        return F.transform("lines", make)

    def on_pitch(kind: str) -> Column:
        return F.transform(
            F.filter("lines", lambda x: (x["l_linestatus"] == "F") == F.lit(kind == "start")),
            lambda x: _struct(player=_struct(id=_text(x["l_partkey"]), name=F.concat(F.lit("P"), x["l_partkey"]), number=_text(x["l_partkey"] % 99), pos=F.lit(kind))),
        )

    return {
        "events": each(lambda x: _struct(time=_struct(elapsed=_text(x["l_linenumber"])), team=_struct(id=_text(x["l_suppkey"])), player=_struct(id=_text(x["l_partkey"])), type=x["l_returnflag"], detail=x["l_linestatus"])),
        "lineups": F.array(_struct(team=_struct(id=team), formation=F.lit("4-4-2"), coach=_struct(id=team, name=F.lit("Coach")), startXI=on_pitch("start"), substitutes=on_pitch("bench"))),
        "statistics": F.array(_struct(team=_struct(id=team), statistics=F.array(
            _struct(type=F.lit("Fouls"), value=F.lit("1")), _struct(type=F.lit("Ball Possession"), value=F.concat(F.size("lines"), F.lit("%"))), _struct(type=F.lit("Fouls"), value=_text(F.size("lines")))))),
        "players": F.array(_struct(team=_struct(id=team), players=each(lambda x: _struct(player=_struct(id=_text(x["l_partkey"]), name=F.lit("Q")), statistics=F.array(
            _struct(games=_struct(minutes=_text(x["l_linenumber"]), rating=_text(x["l_suppkey"]), captain=F.when(x["l_linestatus"] == "F", "true").otherwise("false")), passes=_struct(accuracy=F.concat(x["l_linenumber"], F.lit("%"))))))))),
    }


def _matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order as a match; even ones hold all lists, every fourth all but one, others none."""
    key = F.col("o_orderkey")
    lists = _details(_text(F.lit(5)))
    shown = {
        name: F.when((key % 2 == 0) | ((key % 4 == 1) & F.lit(name != "players")), value) for name, value in lists.items()
    }
    entry = _struct(
        fixture=_struct(id=_text(key), date=F.date_format("o_orderdate", "yyyy-MM-dd'T'20:45:00Z"), timezone=F.lit("UTC"), venue=_struct(id=F.lit("x"), name=F.lit("Ground")), status=_struct(short=F.col("o_orderstatus"), elapsed=F.lit("90"))),
        league=_struct(id=F.when(key % 3 != 0, F.lit("136")), season=F.when(key % 5 != 0, F.lit("2002")), round=F.col("o_orderpriority")),
        teams=_struct(home=_struct(id=_text(F.col("o_custkey")), name=F.lit("Home")), away=_struct(id=_text(F.col("o_custkey") + 1))),
        goals=_struct(home=_text(F.size("lines")), away=F.lit("0")),
        score=_struct(halftime=_struct(home=F.lit(None).cast("string"), away=F.lit("1"))),
        **shown,
    )
    return _landed(spark, _lines(spark, sf_dir).select("file", entry.alias("entry")), schemas.FIXTURE, "matches")


def fixture_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _matches(spark, sf_dir).withColumns({"season_start": F.lit(1990), "league_id": F.lit(1)})
    return normalize.fixtures(rows).withColumn("kickoff_at", F.date_format("kickoff_at", "yyyy-MM-dd HH:mm"))


FIXTURE_SQL = """
SELECT CAST(o_orderkey AS INTEGER) AS fixture_id, CASE WHEN o_orderkey % 3 <> 0 THEN 136 ELSE 1 END AS league_id,
       CASE WHEN o_orderkey % 5 <> 0 THEN 2002 ELSE 1990 END AS season_start, o_orderpriority AS round,
       strftime(o_orderdate, '%Y-%m-%d 20:45') AS kickoff_at, 'UTC' AS timezone,
       o_orderstatus AS status_short, 90 AS elapsed, CAST(NULL AS VARCHAR) AS referee,
       CAST(NULL AS INTEGER) AS venue_id, 'Ground' AS venue_name, CAST(NULL AS VARCHAR) AS venue_city,
       CAST(o_custkey AS INTEGER) AS home_team_id, 'Home' AS home_team_name,
       CAST(o_custkey + 1 AS INTEGER) AS away_team_id, '' AS away_team_name,
       CAST((SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS INTEGER) AS home_goals,
       0 AS away_goals, CAST(NULL AS INTEGER) AS halftime_home, 1 AS halftime_away,
       CAST(NULL AS INTEGER) AS fulltime_home, CAST(NULL AS INTEGER) AS fulltime_away
FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)"""


def _chosen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detail lists by source: odd matches take those of the separate responses, of team 6."""
    lists = _details(_text(F.lit(6)))
    entry = _struct(fixture=_struct(id=_text("o_orderkey")), **lists)
    apart = _landed(spark, _lines(spark, sf_dir, "o_orderkey % 2 = 1").select("file", entry.alias("entry")), schemas.FIXTURE, "details")
    separate = apart.select(F.col("fixture.id").cast("int").alias("fixture_id"), *normalize.DETAILS)
    return normalize.fixture_details(_matches(spark, sf_dir), separate)


def source_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chosen(spark, sf_dir).select("fixture_id", "source_mode", *[F.size(name).alias(name) for name in normalize.DETAILS])


SOURCE_SQL = """
SELECT CAST(l_orderkey AS INTEGER) AS fixture_id,
       CASE WHEN l_orderkey % 2 = 0 THEN 'embedded' ELSE 'per_fixture' END AS source_mode,
       CAST(count(*) AS INTEGER) AS events, 1 AS lineups, 1 AS statistics, 1 AS players
FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY l_orderkey"""


def event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize.fixture_events(_chosen(spark, sf_dir))


EVENT_SQL = """
SELECT CAST(l_orderkey AS INTEGER) AS fixture_id,
       CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_partkey,
         l_returnflag, l_linestatus) - 1 AS INTEGER) AS event_index,
       CAST(l_linenumber AS INTEGER) AS elapsed, CAST(NULL AS INTEGER) AS elapsed_extra,
       CAST(l_suppkey AS INTEGER) AS team_id, CAST(l_partkey AS INTEGER) AS api_player_id,
       CAST(NULL AS VARCHAR) AS player_name, CAST(NULL AS INTEGER) AS assist_player_id,
       CAST(NULL AS VARCHAR) AS assist_player_name, l_returnflag AS event_type, l_linestatus AS detail,
       CAST(NULL AS VARCHAR) AS comments
FROM lineitem JOIN orders ON o_orderkey = l_orderkey"""


def lineup_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize.fixture_lineups(_chosen(spark, sf_dir))


LINEUP_SQL = """
SELECT CAST(l_orderkey AS INTEGER) AS fixture_id, CASE WHEN l_orderkey % 2 = 0 THEN 5 ELSE 6 END AS team_id,
       CAST(l_partkey AS INTEGER) AS api_player_id, 'P' || l_partkey AS player_name,
       CASE WHEN bool_or(l_linestatus = 'F') THEN 'starter' ELSE 'substitute' END AS lineup_type,
       CASE WHEN bool_or(l_linestatus = 'F') THEN 'start' ELSE 'bench' END AS position,
       CAST(NULL AS VARCHAR) AS grid, CAST(l_partkey % 99 AS INTEGER) AS shirt_number,
       '4-4-2' AS formation, CASE WHEN l_orderkey % 2 = 0 THEN 5 ELSE 6 END AS coach_id,
       'Coach' AS coach_name
FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_partkey <> 0 GROUP BY l_orderkey, l_partkey"""


def team_statistic_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize.team_statistics(_chosen(spark, sf_dir)).select("fixture_id", "team_id", "fouls", "ball_possession", "offsides")


TEAM_STATISTIC_SQL = """
SELECT CAST(l_orderkey AS INTEGER) AS fixture_id, CASE WHEN l_orderkey % 2 = 0 THEN 5 ELSE 6 END AS team_id,
       CAST(count(*) AS INTEGER) AS fouls, CAST(count(*) AS DOUBLE) AS ball_possession,
       CAST(NULL AS INTEGER) AS offsides
FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY l_orderkey"""


def player_match_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = ("fixture_id", "team_id", "api_player_id", "player_name", "minutes", "rating", "captain", "pass_accuracy", "goals")
    return rounded(normalize.player_matches(_chosen(spark, sf_dir)).select(*wanted))


PLAYER_MATCH_SQL = """
SELECT CAST(l_orderkey AS INTEGER) AS fixture_id, CASE WHEN l_orderkey % 2 = 0 THEN 5 ELSE 6 END AS team_id,
       CAST(l_partkey AS INTEGER) AS api_player_id, 'Q' AS player_name, first.l AS minutes,
       CAST(first.s AS DOUBLE) AS rating, first.f = 'F' AS captain, CAST(first.l AS DOUBLE) AS pass_accuracy,
       CAST(NULL AS INTEGER) AS goals
FROM (SELECT l_orderkey, l_partkey,
             list({'l': CAST(l_linenumber AS INTEGER), 's': l_suppkey, 'f': l_linestatus}
                  ORDER BY l_linenumber, l_suppkey, l_returnflag, l_linestatus)[1] AS first
      FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_partkey <> 0
      GROUP BY l_orderkey, l_partkey)"""


QUERIES = {
    "player_season_rows": player_season_rows,
    "squad_rows": squad_rows,
    "profile_rows": profile_rows,
    "injury_rows": injury_rows,
    "transfer_rows": transfer_rows,
    "sidelined_rows": sidelined_rows,
    "fixture_rows": fixture_rows,
    "source_choice": source_choice,
    "event_rows": event_rows,
    "lineup_rows": lineup_rows,
    "team_statistic_rows": team_statistic_rows,
    "player_match_rows": player_match_rows,
}
ORACLES = {
    "player_season_rows": PLAYER_SEASON_SQL,
    "squad_rows": SQUAD_SQL,
    "profile_rows": PROFILE_SQL,
    "injury_rows": INJURY_SQL,
    "transfer_rows": TRANSFER_SQL,
    "sidelined_rows": SIDELINED_SQL,
    "fixture_rows": FIXTURE_SQL,
    "source_choice": SOURCE_SQL,
    "event_rows": EVENT_SQL,
    "lineup_rows": LINEUP_SQL,
    "team_statistic_rows": TEAM_STATISTIC_SQL,
    "player_match_rows": PLAYER_MATCH_SQL,
}
