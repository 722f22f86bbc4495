"""Shuffle files of tables that are written and read back go as soon as the table is complete."""

import time

from furlong.session import written_once
from furlong.sources.store import Store
from workload import stages

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shuffle_files(spark):
    found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().toArray
    files = found(spark._jvm.scala.reflect.ClassTag.apply(spark._jvm.java.lang.Class.forName("java.io.File")))
    return {f.getName() for f in files if f.getName().startswith("shuffle_")}


def left_over(spark, before):
    for _ in range(50):
        left = shuffle_files(spark) - before
        if not left:
            return left
        time.sleep(0.2)
    return left


def test_a_setting_lasts_as_long_as_the_writing(spark):
    earlier = spark.conf.get(CLEANUP, None)
    with written_once(spark):
        assert spark.conf.get(CLEANUP) == "true"
    assert spark.conf.get(CLEANUP, None) == earlier


def test_stages_and_stores_leave_no_shuffle_files(spark, tmp_path):
    rows = spark.range(1000).repartition(4, "id").selectExpr("id", "timestamp_seconds(id % 2) as as_of_at")
    before = shuffle_files(spark)
    stages.stage(spark, str(tmp_path), "dealt", lambda: rows)
    store = Store(spark, str(tmp_path / "store"))
    store.replace({"races": rows})
    store.prepare_slices("sliced", rows)
    assert not left_over(spark, before)
