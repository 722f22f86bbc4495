"""Pages bound by the key of the row before them."""

import pytest
from pyspark.sql import functions as F

from furlong.operators.paging import page, page_after

ORDER = (("day", False), ("n", True), ("id", True))


@pytest.fixture
def rows(spark):
    return spark.range(97).select((F.col("id") % 7).alias("day"), (F.col("id") % 3).alias("n"), "id")


def test_pages_follow_each_other(rows):
    last, nth = None, 0
    ordered = [F.desc("day"), F.asc("n"), F.asc("id")]
    while True:
        nth += 1
        found = page_after(rows, ORDER, last, 10).collect()
        assert found == page(rows, ordered, nth, 10).collect()
        if not found:
            break
        last = found[-1].asDict()
    assert nth == 11


def test_earlier_rows_are_not_read(spark, rows, tmp_path):
    """The bound on the first column reaches the scan; sorted files before it give no rows."""
    path = str(tmp_path / "sorted")
    spark.range(100_000).select("id").repartitionByRange(10, "id").sortWithinPartitions("id").write.parquet(path)
    stored = spark.read.parquet(path)
    found = page_after(stored, (("id", True),), {"id": 89_999}, 10)
    assert [r["id"] for r in found.collect()] == list(range(90_000, 90_010))
    plan = found._jdf.queryExecution().executedPlan()
    assert "GreaterThanOrEqual(id,89999)" in plan.toString()
