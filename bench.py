"""Headline queries, timed; prints one JSON line.

Folder and cores come from BENCH_SF_DIR and BENCH_CPUS. Stored inputs (the racing
tables, features, predictions, evaluations) are written before the timing starts,
as in a running system; their own cost is listed as ``stage_*`` and counts. Every query runs
once to warm up and then BENCH_RUNS times; the median counts. Results are fully
computed but not collected.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from furlong.session import local_session
from workload import stages
from workload.queries import QUERIES

HEADLINE = (
    "features_wide",
    "features_long",
    "horse_features",
    "jockey_features",
    "latest_features",
    "scores_v1",
    "version_scores",
    "predictions_ranked",
    "latest_predictions",
    "evaluations",
    "analytics_by_version",
    "version_comparison",
    "feature_contribution",
    "race_card",
    "races_page",
    "prediction_detail",
    "reason_summary",
    "validate_rows",
    "upsert_natural_key",
    "upsert_snapshots",
)


def seconds(run) -> float:
    started = time.perf_counter()
    run()
    return time.perf_counter() - started


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = local_session(cores, shuffle_partitions=int(cores) if cores.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")

    timings: dict[str, float] = {}
    for name, build in (
        ("stage_tables", stages.tables),
        ("stage_features", stages.feature_rows),
        ("stage_predictions", stages.prediction_rows),
        ("stage_evaluations", stages.evaluation_rows),
    ):
        timings[name] = round(seconds(lambda build=build: build(spark, folder)), 3)
    total = sum(timings.values())
    for name in HEADLINE:

        def run(build=QUERIES[name]) -> None:
            build(spark, folder).write.format("noop").mode("overwrite").save()

        run()
        median = statistics.median(seconds(run) for _ in range(runs))
        timings[name] = round(median, 3)
        total += median
    print(
        json.dumps(
            {
                "metric": "stored inputs and headline queries, sum of medians",
                "value": round(total, 3),
                "unit": "sec",
                "queries": timings,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
                "cpus": cores,
            }
        )
    )


if __name__ == "__main__":
    main()
