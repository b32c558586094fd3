"""Orders and lines as landed responses."""

from __future__ import annotations

import datetime as dt
import glob

from ledgerpitch.queries import responses

DAY = dt.datetime(2001, 3, 4)
LINE = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_discount double, l_returnflag string, l_linestatus string"
ORDER = "o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate timestamp, o_orderpriority string"


def tables(spark, path):
    lines = [(k, 10 * k + n, 3, n, 5.0, None, "A", "F") for k in (1, 2, 5000) for n in (2, 1)] + [(None, 1, 1, 1, 1.0, 0.0, "A", "F"), (77, 1, 1, 1, 1.0, 0.0, "A", "F")]
    # Order 2 comes twice, 9 has no line, 77 no order.
    orders = [(k, c, "F", DAY, "2-HIGH") for k, c in ((1, 10), (2, 20), (2, 21), (9, 90), (5000, None), (None, 5))]
    spark.createDataFrame(lines, LINE).write.parquet(f"{path}/lineitem.parquet")
    spark.createDataFrame(orders, ORDER).write.parquet(f"{path}/orders.parquet")
    return str(path)


def test_orders_and_lines_are_dealt_once(spark, tmp_path):
    path = tables(spark, tmp_path)
    rows = responses._lines(spark, path)
    found = sorted((r["o_orderkey"], r["o_custkey"] or 0, [x["l_linenumber"] for x in r["lines"]]) for r in rows.collect())
    assert found == [(1, 10, [1, 2]), (2, 20, [1, 2]), (2, 21, [1, 2]), (5000, 0, [1, 2])]
    by_file = rows.groupBy("file").count()
    assert by_file._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert sorted(r["o_orderkey"] for r in responses._lines(spark, path, "o_orderkey % 2 = 1").collect()) == [1]


def test_matches_land_compressed(spark, tmp_path, monkeypatch):
    path = tables(spark, tmp_path)
    monkeypatch.setattr(responses, "shared_dir", lambda _: f"{tmp_path}/landed")
    found = {(r["fixture_id"], r["home_team_id"]): r["home_goals"] for r in responses.fixture_rows(spark, path).collect()}
    assert found == {(1, 10): 2, (2, 20): 2, (2, 21): 2, (5000, None): 2}
    assert glob.glob(f"{tmp_path}/landed/*/*.txt.gz")
