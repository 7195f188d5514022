"""Times the headline queries and prints one JSON line.

Every query runs over its whole tables; results go to the ``noop`` sink, so all
columns are computed and nothing is collected.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "first_trigger",
    "frame_features",
    "class_posteriors",
    "frame_decisions",
    "response_timeline",
    "telemetry_series",
    "trial_summary",
    "metrics_report",
    "scenario_peaks",
    "active_spans",
    "emitted_messages",
    "bus_audit",
    "command_frames",
    "hazard_warnings",
    "decode_sensors_status",
    "window_stats",
    "majority_labels",
    "body_vectors",
    "pulse_trajectories",
    "spanning_trajectories",
    "replay_modes",
    "seizure_energy_ratio",
    "posture_vectors",
    "ecg_windows",
    "interval_pairs",
    "beat_vectors",
    "classification_report",
    "stratified_split_sizes",
)


def session() -> SparkSession:
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("vitalframe-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false")
        # call-site capture on every Column call costs more than planning does
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.local.dir", tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main() -> None:
    from vitalframe.catalog import registry

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session()
    queries = registry()
    events = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    names = sys.argv[1:] or HEADLINE
    # one untimed query starts the JVM compiler and the Python workers
    queries["first_trigger"][0](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        begin = time.perf_counter()
        queries[name][0](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - begin, 3)
    result = {
        "metric": "total_query_seconds",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }
    if "frame_decisions" in times:
        result["frames"] = events
        result["detect_frames_per_sec"] = round(events / times["frame_decisions"])
        result["detect_ms_per_frame"] = round(1000 * times["frame_decisions"] / events, 5)
    print(json.dumps(result))
    spark.stop()


if __name__ == "__main__":
    main()
