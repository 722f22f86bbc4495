"""Every registered query equals its SQL counterpart."""

import pytest

from compare import compare, connect
from workload.oracle import ORACLES
from workload.queries import QUERIES


@pytest.fixture(scope="module")
def database(small):
    return connect(small)


def test_every_query_has_a_counterpart():
    assert sorted(QUERIES) == sorted(ORACLES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches(spark, database, small, name):
    outcome, _, _ = compare(spark, database, small, name, QUERIES[name], ORACLES[name])
    assert outcome.startswith("ok"), outcome
    assert outcome != "ok 0 rows"


def test_entry_ranks_without_gaps(spark):
    from pyspark.sql import functions as F

    from __spark_entry__ import entry

    rows = entry(spark)
    broken = rows.groupBy("race_id").agg(
        F.min("rank_in_race").alias("low"), F.max("rank_in_race").alias("high"), F.count_distinct("rank_in_race").alias("n"),
        F.count("*").alias("rows"),
    ).filter("low <> 1 or high <> rows or n <> rows")
    assert rows.limit(1).count() == 1
    assert broken.count() == 0
