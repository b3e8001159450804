"""Time the headline queries and print one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

HEADLINE = [
    "event_sequence", "life_streak", "trade_outcomes", "player_trade_rates",
    "player_trade_percentiles", "trade_triplets", "trade_success", "alive_flags",
    "manpower_state", "state_shifts", "time_at_advantage", "player_time_alive",
    "trade_situation", "box_stats", "expected_kills_added", "player_war",
    "season_stats", "year_over_year_corr", "win_model", "xkill_model",
    "trade_attempted_model", "coef_percentiles", "impact_vs_actual", "triplet_model",
    "talent_log_loss", "shot_quality_model", "shot_quality_grid", "pace_model",
]


def main() -> None:
    path = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "12g")
        # Small test data: let every core have a share of a shuffle.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
    from checks.registry import all_queries

    queries = all_queries()
    wanted = sys.argv[1:] or HEADLINE
    # Start the engine; not timed.
    queries["player_trade_rates"](spark, path).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in wanted:
        start = time.perf_counter()
        queries[name](spark, path).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(path.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
