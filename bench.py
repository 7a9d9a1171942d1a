"""Time the headline queries and print one JSON line.

Reads BENCH_SF_DIR (default /root/testdata/sf0.1) on local[BENCH_CPUS]. Each
query runs once to warm up and is then timed; its rows are counted by an
aggregate over all columns, so nothing can be pruned away.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import DataFrame

from checks import QUERIES
from updraft.session import build_session

HEADLINE = (
    "predict_grid", "parse_beacons", "climb_index", "climb_prior", "under_tow", "cluster_climbs",
    "history_samples", "with_agl", "live_snapshots", "positions_since", "current_segment",
    "weather_join", "upsample_terrain", "grid_features", "grouped_auc", "bootstrap_ci",
    "igc_kinematics", "thin_cells", "solar_incidence", "frozen_split",
)


def consume(df: DataFrame) -> None:
    """Run a query to the end, every column included, without collecting it."""
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g",
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in names:
        consume(QUERIES[name](spark, sf_dir))
        start = time.perf_counter()
        consume(QUERIES[name](spark, sf_dir))
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_total_seconds", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
