"""Splitting hot keys changes plans, never results."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from furlong.operators.history import Measure, strict_past
from furlong.operators.hotkeys import find_hot, hot_keys, mark_quantiles, number_rows
from furlong.plans import evaluation, features, predictions
from furlong.sources import star_schema
from furlong.sources.scoring_config import BUILT_IN

AS_OF = "1999-01-01"


def collected(rows):
    return sorted(map(str, rows.collect()))


@pytest.fixture(scope="module")
def plain_tables(spark, small):
    return star_schema.load(spark, small)


@pytest.fixture(scope="module")
def split_tables(spark, small):
    tables = star_schema.load(spark, small, hot_rows=4)
    assert set(tables.hot) == {"race_id", "horse_id", "jockey_id"}
    return tables


def test_only_crowded_keys_are_hot(spark):
    rows = spark.createDataFrame([("a",)] * 5 + [("b",)] * 2 + [(None,)] * 9, "k string")
    assert [r["k"] for r in hot_keys(rows, "k", 3).collect()] == ["a"]
    assert list(find_hot(rows, ["k"], 3)) == ["k"]
    assert find_hot(rows, ["k"], 5) == {}


def test_tables_are_the_same(plain_tables, split_tables):
    for name in ("entries", "results"):
        assert collected(getattr(plain_tables, name)) == collected(getattr(split_tables, name))


@pytest.mark.parametrize("as_of", [[AS_OF], ["1998-01-01", AS_OF]])
def test_features_are_the_same(plain_tables, split_tables, as_of):
    assert collected(features.feature_rows(plain_tables, as_of)) == collected(
        features.feature_rows(split_tables, as_of)
    )


def test_chunks_of_any_width_agree(spark):
    rows = spark.range(3000).select(
        F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 50).cast("string"))).alias("who"),
        (F.col("id") % 4).alias("part"),
        ((F.col("id") * 7919) % 997).alias("at"),
        F.when(F.col("id") % 5 > 0, F.lit(1)).alias("one"),
        F.when(F.col("id") % 5 > 0, F.col("id") % 100).alias("value"),
        "id",
    )
    families = {
        ("who",): [Measure("n", "sum", "one"), Measure("low", "min", "value")],
        ("who", "part"): [Measure("part_n", "sum", "one"), Measure("part_low", "min", "value")],
    }
    expected = collected(strict_past(rows, "who", "at", families).select("id", "n", "low", "part_n", "part_low"))
    hot = hot_keys(rows, "who", 500)
    for width in (1, 10, 250, 5000):
        split = strict_past(rows, "who", "at", families, hot, chunk_micros=width)
        assert collected(split.select("id", "n", "low", "part_n", "part_low")) == expected


def skewed(spark):
    """One key with all rows on one day, half of them in one instant; another with all rows in one instant."""
    day = (F.col("id") * 7919) % 86_400_000_000
    return spark.range(8000).select(
        F.when(F.col("id") % 4 > 0, "day").when(F.col("id") % 8 == 0, "instant").otherwise(F.concat(F.lit("k"), (F.col("id") % 60).cast("string"))).alias("who"),
        F.when(F.col("id") % 8 == 0, F.lit(5)).when(F.col("id") % 2 == 0, F.lit(777)).otherwise(day).cast("long").alias("at"),
        (F.col("id") % 3).alias("part"),
        F.lit(1).alias("one"),
        (F.col("id") % 100).alias("value"),
        "id",
    )


@pytest.mark.parametrize("upto", [-1, 0])
def test_chunks_follow_the_rows(spark, upto):
    rows = skewed(spark)
    families = {
        ("who",): [Measure("n", "sum", "one"), Measure("low", "min", "value")],
        ("who", "part"): [Measure("part_n", "sum", "one"), Measure("part_low", "min", "value")],
    }
    names = ["id", "n", "low", "part_n", "part_low"]
    expected = collected(strict_past(rows, "who", "at", families, upto=upto).select(names))
    hot = hot_keys(rows, "who", 500)
    assert hot.count() == 2
    split = strict_past(rows, "who", "at", families, hot, upto=upto, chunk_rows=200)
    assert collected(split.select(names)) == expected


def test_no_chunk_is_large_and_chunks_are_few(spark):
    rows = skewed(spark)
    marked = mark_quantiles(rows, "who", hot_keys(rows, "who", 500), F.col("at"), chunk_rows=200, ties=True)
    sizes = marked.filter("_chunk is not null").groupBy("who", "_chunk", "_part").count().collect()
    assert {r["who"] for r in sizes} == {"day", "instant"}
    assert max(r["count"] for r in sizes) <= 450 and len(sizes) <= 2 * 7000 / 200
    # Chunks ascend with the value, and equal values share one.
    spans = marked.filter("_chunk is not null").groupBy("who", "_chunk").agg(F.min("at").alias("low"), F.max("at").alias("high"))
    for who in ("day", "instant"):
        found = [(r["low"], r["high"]) for r in spans.filter(F.col("who") == who).orderBy("_chunk").collect()]
        assert all(a[1] < b[0] for a, b in zip(found, found[1:]))


def test_numbering_by_quantiles_is_the_same(spark):
    rows = spark.range(3000).select(F.lit("g").alias("group"), ((F.col("id") * 31) % 7).alias("value"), "id")
    order = [F.desc("value"), F.asc("id")]
    expected = collected(number_rows(rows, ["group"], order, "nth").select("id", "nth"))
    found = number_rows(rows, ["group"], order, "nth", hot_keys(rows, "group", 100), value=-F.col("value"), chunk_rows=50)
    assert collected(found.select("id", "nth")) == expected


def test_numbering_is_the_same(spark):
    rows = spark.range(2000).select(
        (F.col("id") % 2 * F.col("id") % 40).alias("group"), ((F.col("id") * 31) % 503).alias("value"), "id"
    )
    order = [F.desc("value"), F.asc("id")]
    expected = collected(number_rows(rows, ["group"], order, "nth").select("id", "nth"))
    hot = hot_keys(rows, "group", 100)
    assert hot.count() == 1
    coarse = F.struct(-F.col("value"), F.floor(F.col("id") / 16))
    assert collected(number_rows(rows, ["group"], order, "nth", hot, coarse).select("id", "nth")) == expected


def test_predictions_and_evaluations_are_the_same(plain_tables, split_tables):
    configs = list(BUILT_IN.values())
    wide = features.feature_rows(plain_tables, [AS_OF])
    plain = predictions.generate_predictions(plain_tables, wide, AS_OF, configs)
    split = predictions.generate_predictions(split_tables, wide, AS_OF, configs)
    columns = ["prediction_id", "prediction_score", "rank_in_race"]
    assert collected(plain.select(*columns)) == collected(split.select(*columns))
    runs = plain.select("run_id", F.lit("succeeded").alias("status")).distinct()
    rows = evaluation.predictions_with_results(plain, runs, plain_tables.results)
    assert collected(evaluation.evaluate(rows)) == collected(evaluation.evaluate(rows, crowded_races=True))


def test_null_jockeys_have_no_history_and_do_not_meet(spark, plain_tables):
    from dataclasses import replace

    tables = replace(plain_tables, entries=plain_tables.entries.withColumn(
        "jockey_id", F.when(F.col("jockey_id") % 2 == 0, F.col("jockey_id"))))
    rows = features.jockey_features(tables, [AS_OF]).filter("jockey_id is null")
    assert rows.count() > 100
    assert rows.filter(
        "jockey_venue_starts <> 0 or jockey_distance_top3 <> 0 or jockey_venue_win_rate is not null "
        "or jockey_distance_available_until is not null"
    ).count() == 0


def test_plans_hold_no_python_and_no_product(plain_tables):
    wide = features.feature_rows(plain_tables, [AS_OF])
    ranked = predictions.generate_predictions(plain_tables, wide, AS_OF, list(BUILT_IN.values()))
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    for unwanted in ("Python", "Cartesian", "NestedLoop"):
        assert unwanted not in plan
