"""Slices by instant, clean-up, and jobs that meet."""

import os
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from furlong.operators.latest import latest_feature_rows
from furlong.sources.store import StaleTable, Store

SCHEMA = "k int, as_of_at timestamp, v string"
DAYS = [datetime(2026, 6, day, tzinfo=UTC) for day in (1, 2, 3)]


def rows_of(spark, day, *values):
    return spark.createDataFrame([(k, day, v) for k, v in values], SCHEMA)


def put(store, rows):
    store.switch({"t": store.prepare_slices("t", rows)})


def files_of(root):
    found = {}
    for folder, _, names in os.walk(root):
        for name in names:
            if name.endswith(".parquet"):
                path = os.path.join(folder, name)
                found[path] = os.stat(path).st_mtime_ns
    return found


def content(frame):
    return sorted(map(tuple, frame.select("k", "v").collect()))


@pytest.fixture
def filled(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    for nth, day in enumerate(DAYS):
        put(store, rows_of(spark, day, (1, f"a{nth}"), (2, f"b{nth}")))
    return store


def test_a_second_run_leaves_other_instants_alone(spark, filled):
    before = files_of(filled.root)
    put(filled, rows_of(spark, DAYS[1], (1, "new")))
    after = files_of(filled.root)
    assert before.items() <= after.items() and len(after) > len(before)
    assert content(Store(spark, filled.root).table("t", SCHEMA)) == [(1, "a0"), (1, "a2"), (1, "new"), (2, "b0"), (2, "b2")]


def test_limits_are_partition_filters(spark, filled):
    rows = filled.slices("t", SCHEMA, until=DAYS[1])
    assert content(rows) == [(1, "a0"), (1, "a1"), (2, "b0"), (2, "b1")]
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(instant" in plan
    micros = int(DAYS[2].timestamp()) * 10**6
    assert content(filled.slices("t", SCHEMA, among=[micros])) == [(1, "a2"), (2, "b2")]
    assert filled.slices("t", SCHEMA, among=[5]).count() == 0
    assert filled.slices("absent", SCHEMA).count() == 0 and filled.instants("t")[2] == micros
    newest = latest_feature_rows(filled.slices("t", "entry_id int, as_of_at timestamp, v string", until=DAYS[1]).withColumn("feature_version", F.lit(1)))
    assert newest.count() <= 2


def test_jobs_on_other_instants_do_not_disturb_each_other(spark, filled):
    one, two, three = (Store(spark, filled.root) for _ in range(3))
    micros = [int(day.timestamp()) * 10**6 for day in DAYS]
    for store, at in ((one, micros[0]), (two, micros[1]), (three, micros[0])):
        store.slices("t", SCHEMA, among=[at])
    put(one, rows_of(spark, DAYS[0], (1, "one")))
    put(two, rows_of(spark, DAYS[1], (1, "two")))
    with pytest.raises(StaleTable):
        put(three, rows_of(spark, DAYS[0], (1, "three")))
    assert content(Store(spark, filled.root).table("t", SCHEMA)) == [(1, "a2"), (1, "one"), (1, "two"), (2, "b2")]


def test_clean_keeps_what_readers_and_jobs_need(spark, filled):
    """An old reader, a job that has prepared but not switched, and a table that is not sliced."""
    long_ago, soon = datetime.now(UTC) - timedelta(days=1), datetime.now(UTC) + timedelta(days=1)
    filled.replace({"whole": rows_of(spark, DAYS[0], (1, "old"))})
    reader = Store(spark, filled.root).table("t", SCHEMA)
    put(filled, rows_of(spark, DAYS[0], (1, "x")))
    filled.replace({"whole": rows_of(spark, DAYS[0], (1, "new"))})
    filled.append_history("import_batches", {"batch_id": "b", "status": "running"})
    assert filled.clean(long_ago) == []
    assert content(reader) == [(1, "a0"), (1, "a1"), (1, "a2"), (2, "b0"), (2, "b1"), (2, "b2")]

    other = Store(spark, filled.root)
    pending = other.prepare_slices("t", rows_of(spark, DAYS[2], (9, "later")))
    old = datetime.now().timestamp() - 3 * 86400
    for folder, names, found in os.walk(filled.root):
        if next(iter(pending.values())) not in folder:
            for name in [*names, *found]:
                if next(iter(pending.values())) not in name:
                    os.utime(os.path.join(folder, name), (old, old))
    deleted = filled.clean(long_ago)
    assert len(deleted) == 2 and {path.split("/")[0] for path in deleted} == {"t", "whole"}
    assert content(Store(spark, filled.root).table("t", SCHEMA)) == [(1, "a1"), (1, "a2"), (1, "x"), (2, "b1"), (2, "b2")]
    assert content(Store(spark, filled.root).table("whole", SCHEMA)) == [(1, "new")]
    assert filled.history("import_batches").count() == 1
    other.switch({"t": pending})
    assert (9, "later") in content(Store(spark, filled.root).table("t", SCHEMA))
    assert filled.clean(soon) and content(Store(spark, filled.root).table("whole", SCHEMA)) == [(1, "new")]


def test_half_replaced_versions_lose_only_dead_slices(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    both = rows_of(spark, DAYS[0], (1, "a")).unionByName(rows_of(spark, DAYS[1], (1, "b")))
    put(store, both)
    put(store, rows_of(spark, DAYS[0], (1, "c")))
    deleted = store.clean(datetime.now(UTC) + timedelta(days=1))
    assert len(deleted) == 1 and "/instant=" in deleted[0]
    assert content(Store(spark, store.root).table("t", SCHEMA)) == [(1, "b"), (1, "c")]
