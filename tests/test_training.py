"""The training table against feature jobs at single instants; near distances against a plain loop."""

import pytest
from pyspark.sql import functions as F

from furlong import registry
from furlong.plans import analytics, features
from furlong.sources import star_schema

KNOWN = "1999-01-01"


@pytest.fixture(scope="module")
def tables(spark, small):
    return star_schema.load(spark, small)


@pytest.fixture(scope="module")
def split_tables(spark, small):
    return star_schema.load(spark, small, hot_rows=4)


def collected(rows):
    return sorted(map(str, rows.collect()))


def test_equals_the_job_of_every_instant(tables):
    """At twenty starts spread over the table, each row equals what a job at that instant gives for its race."""
    starts = [r["at"] for r in tables.races.select(F.col("scheduled_start_at").alias("at")).distinct().orderBy("at").collect()]
    before = [at for at in starts if str(at) < KNOWN]
    chosen = before[len(before) // 3 :: len(before) // 30][:20]
    assert len(chosen) == 20
    columns = ["entry_id", "race_id", "horse_id", "jockey_id", "as_of_at", *[f.column for f in registry.ALL]]
    jobs = features.feature_rows(tables, chosen).join(tables.races.select("race_id", "scheduled_start_at"), "race_id")
    want = collected(jobs.filter("as_of_at = scheduled_start_at").select(columns))
    found = features.training_rows(tables, KNOWN).filter(F.col("as_of_at").isin(chosen))
    assert len(want) > 40 and collected(found.select(columns)) == want


def test_one_shuffle_per_entity_and_no_copies(tables):
    plan = features.training_rows(tables, KNOWN)._jdf.queryExecution().executedPlan().toString()
    for entity in ("horse_id", "jockey_id"):
        moves = [line for line in plan.splitlines() if "Exchange hashpartitioning(" + entity in line]
        assert len(moves) == 1, plan


def test_hot_keys_change_nothing(tables, split_tables):
    assert collected(features.training_rows(tables, KNOWN)) == collected(features.training_rows(split_tables, KNOWN))
    assert collected(features.near_distance_rows(tables, [KNOWN])) == collected(features.near_distance_rows(split_tables, [KNOWN]))


def test_labels(tables):
    rows = features.training_rows(tables, KNOWN)
    results = tables.results.filter(F.col("available_at") <= F.lit(KNOWN).cast("timestamp")).select("entry_id", "finish_position")
    joined = rows.join(results.withColumn("known", F.lit(True)), "entry_id", "left")
    assert joined.filter("not (label_finish_position <=> finish_position)").count() == 0
    assert joined.filter("(label_is_win is null) <> (known is null) or coalesce(label_is_win, false) <> coalesce(finish_position = 1, false)").count() == 0


@pytest.mark.parametrize("meters", [0, 200, 1000])
def test_near_distances(tables, meters):
    rows = features.visible_rows(tables, [KNOWN]).collect()
    past = {}
    for r in rows:
        if r["result_available_at"] and r["finish_status"] == "finished" and r["finish_time_milliseconds"] is not None:
            past.setdefault(r["horse_id"], []).append(r)
    want = {}
    for r in rows:
        times = [
            p["finish_time_milliseconds"] for p in past.get(r["horse_id"], ())
            if p["scheduled_start_at"] < r["scheduled_start_at"] and p["surface_class"] == r["surface_class"]
            and abs(p["distance_meters"] - r["distance_meters"]) <= meters
        ]
        want[r["entry_id"]] = (min(times, default=None), len(times))
    found = features.near_distance_rows(tables, [KNOWN], meters).collect()
    assert {r["entry_id"]: (r["horse_best_time_near_distance_ms"], r["horse_best_time_near_distance_count"]) for r in found} == want
    assert len(found) == len(want) and (meters == 0 or any(n > 1 for _, n in want.values()))


def test_medians(spark):
    for diffs, want in (([3], 3.0), ([1, 2], 1.5), ([0, 0, 5], 0.0), ([4, 1, 1, 9], 2.5), ([None, 7], 7.0)):
        base = spark.createDataFrame([("v", d) for d in diffs], "model_version string, rank_diff int")
        row = analytics.rank_diff_median(base).first()
        assert row["median_rank_diff"] == want
