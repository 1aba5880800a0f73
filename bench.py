"""Time the headline queries: prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8). `ingest` is the typing of the raw events, which
every query reads; each query then computes everything else it needs, except that those working on existing
fight_sides (pokes, quality, type and conversion sweeps) read the stored table, timed as `build_fight_sides`.
"""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession

from skirmish.catalog.queries import QUERIES
from skirmish.catalog.telemetry import Telemetry

HEADLINE = [
    "d1_team_at", "d2_hit_distances", "d17_interpolated", "f1_gap_segments", "g2_group_fights", "h2_outcome_events", "h5_fight_sides",
    "h9_pokes", "h12_pieces", "k3_chronological_split", "k5_rolling_membership", "l7_quality_report", "m1_segmentation_sweep",
    "m2_type_sweep", "m3_convert_sweep", "m6_third_party_links", "m7_merge_windows", "n1_resolve_players", "a8_ledger",
]


def timed(work) -> float:
    start = time.time()
    work()
    return round(time.time() - start, 3)


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus)
             .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g")).config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    small = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    if os.path.isdir(small):  # starts the JVM's and Python's workers
        run(QUERIES["h5_fight_sides"](spark, small))
    t = Telemetry.of(spark, sf_dir)
    seconds = {"ingest": timed(lambda: (t.ev, t.split)), "build_fight_sides": timed(lambda: t.sides)}
    for name in HEADLINE:
        seconds[name] = timed(lambda: run(QUERIES[name](spark, sf_dir)))
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
