"""Rules and components are evaluated once per row, and whole components are listed."""

from datetime import UTC, datetime

from pyspark.sql import functions as F

from furlong.plans import analytics, predictions, reports, scoring
from furlong.session import METHOD_LIMIT, use_utc
from workload.queries import QUERIES
from workload.stages import CONFIGS

AT = datetime(1999, 1, 1, tzinfo=UTC)


def ranked(spark):
    """Two versions of two entries, one of them without any feature."""
    names = predictions.component_columns(CONFIGS)
    values = {name: "true" if name.split("_")[1] in ("has", "is") else "0.5" if name.endswith("rate") else "20" for name in names}
    known = spark.range(1).select(*[F.expr(value).alias(name) for name, value in values.items()])
    blank = known.select(*[F.lit(None).cast(kind).alias(name) for name, kind in known.dtypes])
    rows = known.withColumn("entry_id", F.lit(1)).unionByName(blank.withColumn("entry_id", F.lit(2)))
    versions = F.explode(F.array(*[F.lit(c.model_version) for c in CONFIGS])).alias("model_version")
    return rows.select("*", versions).withColumn("rank_in_race", F.lit(1)).withColumn(
        "prediction_id", F.concat("model_version", F.lit(":"), F.col("entry_id").cast("string"))
    )


def test_rules_are_evaluated_once_and_not_by_a_generator(spark):
    rows = predictions.with_components(ranked(spark), CONFIGS)
    plan = analytics.contribution_by_version(rows)._jdf.queryExecution().optimizedPlan().toString()
    lines = plan.splitlines()
    # ``floor`` belongs to the rules: one projection has them, no generator and no filter does.
    assert sum("floor" in line.lower() and "Project" in line for line in lines) >= 1
    assert not [line for line in lines if "floor" in line.lower() and ("Generate" in line or "Filter" in line)]
    assert {row["n"] for row in rows.select(F.size("score_components.components").alias("n")).collect()} == {0, len(scoring.LABELS)}


def test_reasons_are_sorted_without_a_comparing_function(spark):
    rows = reports.reason_rows(predictions.with_components(ranked(spark), CONFIGS))
    assert "array_sort(" not in rows._jdf.queryExecution().optimizedPlan().toString()
    places = rows.groupBy("prediction_id", "direction").agg(F.sort_array(F.collect_list("place")).alias("places")).collect()
    assert places and all(row["places"] == list(range(1, len(row["places"]) + 1)) for row in places)


def test_large_methods_are_left_to_single_operators(spark):
    use_utc(spark)
    assert spark.conf.get("spark.sql.codegen.hugeMethodLimit") == METHOD_LIMIT


def test_prediction_detail_lists_whole_components(spark, small):
    rows = QUERIES["prediction_detail"](spark, small)
    parts = F.transform(F.split("score_components", ";"), lambda item: F.size(F.split(item, r"\|")))
    shapes = rows.filter("score_components <> ''").select(F.explode(parts).alias("n")).distinct().collect()
    assert [row["n"] for row in shapes] == [6]
    bases = {(row["model_version"], row["base_score"], row["disclaimer"]) for row in rows.select(
        F.split_part("run_id", F.lit("@"), F.lit(1)).alias("model_version"), "base_score", "disclaimer").distinct().collect()}
    assert bases == {(c.model_version, c.base, scoring.DISCLAIMER) for c in CONFIGS}
