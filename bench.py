"""Headline queries, timed: prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from ledgerpitch.queries import all_queries  # noqa: E402

HEADLINE = (
    "pit_history",
    "pit_rolling",
    "side_unpivot_form",
    "feature_mart",
    "asof_state",
    "latest_per_key",
    "lagged_examples",
    "mapped_actuals",
    "projection",
    "snapshot_diff",
    "report_tables",
    "coverage",
    "spearman",
    "part_medians",
    "largest_remainder",
    "capped_allocation",
    "tiers",
    "link_entities",
    "link_fuzzy",
    "name_keys",
    "json_flatten",
    "upsert",
    "table_fingerprint",
    "row_set_fingerprint",
    "price_allocation",
    "persist_build",
    "checked_load",
    "incremental_ingest",
    "ledger",
    "fixture_rows",
    "player_match_rows",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    wanted = os.environ.get("BENCH_QUERIES")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries()
    names = wanted.split(",") if wanted else HEADLINE
    seconds: dict[str, float] = {}
    for name in names:
        times = []
        # The first run warms code generation and is not counted.
        for run in range(runs + 1):
            started = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            if run:
                times.append(time.perf_counter() - started)
        seconds[name] = round(statistics.median(times), 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "sum of median warm seconds over the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(os.path.basename(sf_dir.rstrip("/")).removeprefix("sf") or 0),
            }
        )
    )


if __name__ == "__main__":
    main()
