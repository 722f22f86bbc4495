"""Accuracy and feature contribution per model version."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from furlong.functions.scalars import rate, round_ties_up, surface_class, tokyo_day

# --- fixed values ------------------------------------------------------------
PREFERRED_BASE = "rule-based-v1"
PREFERRED_CANDIDATE = "rule-based-v1.1"
SMALL_SAMPLE_RACES = 30
UNKNOWN_KEY = "unknown"
DEFAULT_LABEL = "特徴量"
DEFAULT_REASON = "スコアに影響しました"
# -----------------------------------------------------------------------------

# Metres from which a race is of middle length, and long.
MIDDLE_FROM, LONG_FROM = 1400, 2000

RAW_COMPONENT = "array<struct<key:string,label:string,adjustment:string,reason:string>>"


# What analytics read of an evaluation.
EVALUATED = (
    "finish_position", "rank_diff", "is_predicted_top1", "top_prediction_is_top3", "actual_winner_in_predicted_top3",
)


def analytics_base(
    predictions: DataFrame,
    runs: DataFrame,
    evaluations: DataFrame | None,
    model_version: str | None = None,
    as_of_day: str | None = None,
    evaluation_status: str = "all",
    key: Sequence[str] = ("prediction_id",),
    carried: Sequence[str] = ("score_components",),
) -> DataFrame:
    """Predictions with run and evaluation, filtered; absent filters keep all.

    ``as_of_day`` is a calendar day in Tokyo; ``evaluation_status`` is one of
    all, evaluated, unevaluated. ``key`` names the columns by which predictions
    and evaluations meet, where shorter ones than the id tell them apart. Without
    ``evaluations``, the predictions carry the columns of theirs and ``is_evaluated``.
    """
    conditions: list[Column] = []
    if model_version is not None:
        conditions.append(F.col("model_version") == model_version)
    if as_of_day is not None:
        conditions.append(tokyo_day(F.col("as_of_at"), as_of_day))
    kept = reduce(lambda left, right: left & right, conditions, F.lit(True))
    run_columns = runs.select("run_id", "model_version", "as_of_at").filter(kept).drop("as_of_at")
    shown = [*key, "prediction_id", "run_id", "race_id", "rank_in_race", "prediction_score", *carried]
    if evaluations is None:
        rows = predictions.select(*dict.fromkeys([*shown, *EVALUATED, "is_evaluated"])).join(run_columns, "run_id")
    else:
        evaluated = evaluations.select(*key, *EVALUATED, F.lit(True).alias("is_evaluated"))
        rows = predictions.select(*dict.fromkeys(shown)).join(run_columns, "run_id").join(evaluated, list(key), "left")
    rows = rows.withColumn("is_evaluated", F.coalesce("is_evaluated", F.lit(False)))
    if evaluation_status == "evaluated":
        return rows.filter("is_evaluated")
    if evaluation_status == "unevaluated":
        return rows.filter("not is_evaluated")
    return rows


def _metrics() -> list[Column]:
    compared = F.col("rank_diff").isNotNull()
    top = F.coalesce(F.col("is_predicted_top1"), F.lit(False))
    top_known = top & F.col("top_prediction_is_top3").isNotNull()
    winner_known = top & F.col("actual_winner_in_predicted_top3").isNotNull()
    races = F.count_distinct(F.when(compared, F.struct("run_id", "race_id")))
    return [
        F.count("*").alias("prediction_count"),
        F.count_if(compared).alias("evaluated_prediction_count"),
        races.alias("evaluated_race_count"),
        F.count_if(top_known).alias("top1_evaluated_race_count"),
        round_ties_up(
            rate(F.count_if(top_known & F.col("top_prediction_is_top3")), F.count_if(top_known)), 4
        ).alias("top1_top3_rate"),
        round_ties_up(
            rate(F.count_if(winner_known & F.col("actual_winner_in_predicted_top3")), F.count_if(winner_known)), 4
        ).alias("winner_in_predicted_top3_rate"),
        round_ties_up(
            rate(F.coalesce(F.sum("rank_diff"), F.lit(0)), F.count_if(compared)), 4
        ).alias("average_rank_diff"),
    ]


def rank_diff_median(base: DataFrame) -> DataFrame:
    """Exact median of the rank differences per model version.

    Differences are small whole numbers, so their counts are what is merged: a
    version has no more of them than the largest field has horses.
    """
    counts = base.filter(F.col("rank_diff").isNotNull()).groupBy("model_version", "rank_diff").agg(F.count("*").alias("n"))
    version = Window.partitionBy("model_version")
    counts = counts.withColumns({"upto": F.sum("n").over(version.orderBy("rank_diff")), "whole": F.sum("n").over(version)})

    def at(place: Column) -> Column:
        return F.min(F.when(F.col("upto") >= place, F.col("rank_diff")))

    half = F.floor(F.col("whole") / 2)
    both = at(F.ceil(F.col("whole") / 2)) + at(half + 1)
    return counts.groupBy("model_version").agg(
        F.max("whole").alias("evaluated_prediction_count"), (both / 2).alias("median_rank_diff")
    )


def position_by_rank(base: DataFrame) -> DataFrame:
    """Mean finish position of every predicted rank, per model version."""
    placed = F.col("finish_position").isNotNull()
    rows = base.filter(placed & F.col("rank_in_race").isNotNull()).groupBy("model_version", "rank_in_race")
    mean = round_ties_up(rate(F.sum("finish_position"), F.count("*")), 4)
    return rows.agg(F.count("*").alias("placed_count"), mean.alias("average_finish_position"))


def score_bands(base: DataFrame, width: int = 10) -> DataFrame:
    """Share of evaluated predictions in the first three, per model version and band of scores."""
    band = (F.floor(F.col("prediction_score") / width) * width).cast("int").alias("score_from")
    rows = base.filter("is_evaluated").groupBy("model_version", band)
    top3 = F.count_if(F.coalesce(F.col("finish_position") <= 3, F.lit(False)))
    return rows.agg(
        F.count("*").alias("evaluated_prediction_count"), top3.alias("top3_count"),
        round_ties_up(rate(top3, F.count("*")), 4).alias("top3_rate"),
    )


def distance_band(meters: Column) -> Column:
    return F.when(meters < MIDDLE_FROM, "short").when(meters < LONG_FROM, "middle").when(meters.isNotNull(), "long")


def version_report(base: DataFrame, races: DataFrame) -> DataFrame:
    """The metrics of every model version: over all races, and by venue, distance band and surface.

    Predictions are first summed up per run and race, so races need no distinct
    count afterwards; the sums of a race enter all levels in one expand.
    """
    compared = F.col("rank_diff").isNotNull()
    top = F.coalesce(F.col("is_predicted_top1"), F.lit(False))
    top_known = top & F.col("top_prediction_is_top3").isNotNull()
    winner_known = top & F.col("actual_winner_in_predicted_top3").isNotNull()
    per_race = base.groupBy("model_version", "run_id", "race_id").agg(
        F.count("*").alias("predictions"),
        F.count_if(compared).alias("compared"),
        F.coalesce(F.sum("rank_diff"), F.lit(0)).alias("differences"),
        F.count_if(top_known).alias("top_known"),
        F.count_if(top_known & F.col("top_prediction_is_top3")).alias("top_right"),
        F.count_if(winner_known).alias("winner_known"),
        F.count_if(winner_known & F.col("actual_winner_in_predicted_top3")).alias("winner_right"),
    )
    places = races.select(
        "race_id", "venue", distance_band(F.col("distance_meters")).alias("distance_band"), surface_class(F.col("surface")).alias("surface_class")
    )
    rows = per_race.join(places, "race_id")
    by = ["venue", "distance_band", "surface_class"]
    sets = [[F.col("model_version")], *[[F.col("model_version"), F.col(name)] for name in by]]
    level = F.coalesce(*[F.when(F.grouping(name) == 0, F.lit(name)) for name in by], F.lit("all"))
    value = F.coalesce(*[F.when(F.grouping(name) == 0, F.col(name)) for name in by])
    report = rows.groupingSets(sets, "model_version", *by).agg(
        level.alias("level"),
        value.alias("level_value"),
        F.sum("predictions").alias("prediction_count"),
        F.sum("compared").alias("evaluated_prediction_count"),
        F.count_if(F.col("compared") > 0).alias("evaluated_race_count"),
        round_ties_up(rate(F.sum("top_right"), F.sum("top_known")), 4).alias("top1_top3_rate"),
        round_ties_up(rate(F.sum("winner_right"), F.sum("winner_known")), 4).alias("winner_in_predicted_top3_rate"),
        round_ties_up(rate(F.sum("differences"), F.sum("compared")), 4).alias("average_rank_diff"),
    )
    return _small_sample(report.drop(*by))


def _small_sample(rows: DataFrame) -> DataFrame:
    races = F.col("evaluated_race_count")
    return rows.withColumn("is_small_sample", (races > 0) & (races < SMALL_SAMPLE_RACES))


def overall(base: DataFrame) -> DataFrame:
    """One row over everything."""
    return _small_sample(base.agg(*_metrics()))


def by_version(base: DataFrame) -> DataFrame:
    return _small_sample(base.groupBy("model_version").agg(*_metrics()))


def _roles(rows: DataFrame) -> DataFrame:
    """The base and the candidate version in one row; the candidate may be null.

    The preferred names win. Otherwise the base is the first version and the
    candidate the first one that differs from it. The set holds one name per
    model version and is combined in the map tasks.
    """
    names = F.sort_array(F.collect_set("model_version")).alias("names")
    base = F.when(F.array_contains("names", PREFERRED_BASE), F.lit(PREFERRED_BASE)).otherwise(F.get("names", F.lit(0)))
    other = F.get(F.filter("names", lambda name: name != F.col("base_version")), F.lit(0))
    candidate = F.when(F.array_contains("names", PREFERRED_CANDIDATE), F.lit(PREFERRED_CANDIDATE)).otherwise(other)
    return (
        rows.agg(names)
        .withColumn("base_version", base)
        .select("base_version", candidate.alias("candidate_version"), F.size("names").alias("versions"))
    )


def _difference(column: str) -> Column:
    return round_ties_up(F.col(f"c.{column}") - F.col(f"b.{column}"), 4)


def version_comparison(summaries: DataFrame) -> DataFrame:
    """Candidate minus base; no row when there are fewer than two versions."""
    roles = _roles(summaries).filter((F.col("versions") >= 2) & F.col("candidate_version").isNotNull())
    return (
        roles.join(summaries.alias("b"), F.col("base_version") == F.col("b.model_version"))
        .join(summaries.alias("c"), F.col("candidate_version") == F.col("c.model_version"))
        .select(
            F.col("base_version").alias("base_model_version"),
            F.col("candidate_version").alias("candidate_model_version"),
            (F.col("c.evaluated_race_count") - F.col("b.evaluated_race_count")).alias("evaluated_race_count_diff"),
            (F.col("c.evaluated_prediction_count") - F.col("b.evaluated_prediction_count")).alias(
                "evaluated_prediction_count_diff"
            ),
            _difference("top1_top3_rate").alias("top1_top3_rate_diff"),
            _difference("winner_in_predicted_top3_rate").alias("winner_in_predicted_top3_rate_diff"),
            _difference("average_rank_diff").alias("average_rank_diff_diff"),
            (F.col("b.is_small_sample") | F.col("c.is_small_sample")).alias("is_small_sample"),
        )
    )


def _number(item: Column) -> Column:
    """The adjustment of a component: a number, a boolean, or a text that spells a number."""
    kind = F.schema_of_variant(F.try_variant_get(item, "$.adjustment", "variant"))
    text = F.trim(F.try_variant_get(item, "$.adjustment", "string"))
    decimal = text.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$")
    hexadecimal = text.rlike("^0[xX][0-9a-fA-F]+$")
    spelt = F.when(decimal, text.try_cast("double")).when(hexadecimal, F.conv(F.substring(text, 3, 64), 16, 10).try_cast("double"))
    return (
        F.when(kind == "STRING", spelt)
        .when(kind == "BOOLEAN", F.try_variant_get(item, "$.adjustment", "boolean").cast("double"))
        .when(kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.try_variant_get(item, "$.adjustment", "double"))
    )


def parse_components(json: Column) -> Column:
    """Components from JSON text, tolerant of bad shapes.

    Elements that are no objects, and adjustments that are no finite number or
    zero, are left out; a key, label or reason that is no text gets its default.
    """
    parsed = F.try_variant_get(F.try_parse_json(json), "$.components", "array<variant>")
    objects = F.filter(parsed, lambda item: F.schema_of_variant(item).startswith("OBJECT"))

    def text(item: Column, name: str, default: str) -> Column:
        member = F.try_variant_get(item, f"$.{name}", "variant")
        is_text = F.schema_of_variant(member) == "STRING"
        return F.when(is_text, F.try_variant_get(item, f"$.{name}", "string")).otherwise(default)

    typed = F.transform(
        objects,
        lambda item: F.struct(
            text(item, "key", UNKNOWN_KEY).alias("key"),
            text(item, "label", DEFAULT_LABEL).alias("label"),
            _number(item).alias("adjustment"),
            text(item, "reason", DEFAULT_REASON).alias("reason"),
        ),
    )
    finite = F.filter(
        typed,
        lambda item: item["adjustment"].isNotNull()
        & ~F.isnan(item["adjustment"])
        & (F.abs(item["adjustment"]) != float("inf"))
        & (item["adjustment"] != 0),
    )
    return F.coalesce(finite, F.array().cast("array<struct<key:string,label:string,adjustment:double,reason:string>>"))


def _component_sums(base: DataFrame) -> DataFrame:
    """Counts and sums per version, key and label of the components that changed a score.

    Decimal sums: the map side leaves a few rows per task, and the order of
    adding does not matter. Adjustments are taken to twelve places.
    """
    item = F.explode_outer("score_components.components").alias("item")
    rows = base.select("model_version", item).select(
        "model_version",
        F.coalesce("item.key", F.lit(UNKNOWN_KEY)).alias("feature_key"),
        F.coalesce("item.label", F.lit(DEFAULT_LABEL)).alias("label"),
        F.col("item.adjustment").alias("adjustment"),
    )
    finite = ~F.isnan("adjustment") & (F.abs("adjustment") != float("inf"))
    return (
        rows.filter((F.col("adjustment") != 0) & finite)
        .groupBy("model_version", "feature_key", "label")
        .agg(
            F.count("*").alias("count"),
            F.count_if(F.col("adjustment") > 0).alias("positive_count"),
            F.count_if(F.col("adjustment") < 0).alias("negative_count"),
            F.sum(F.col("adjustment").cast("decimal(38,12)")).alias("total"),
        )
    )


def _contribution(label: Column) -> list[Column]:
    mean = F.sum("total").cast("double") / F.sum("count")
    return [
        label.alias("label"),
        *[F.sum(c).alias(c) for c in ("count", "positive_count", "negative_count")],
        round_ties_up(mean, 4).alias("average_adjustment"),
    ]


def feature_contribution(base: DataFrame) -> DataFrame:
    """Counts and mean adjustment per component key, largest effect first."""
    return (
        _component_sums(base)
        .groupBy("feature_key")
        .agg(*_contribution(F.min_by("label", F.struct("model_version", "label"))))
        .orderBy(F.abs(F.col("average_adjustment")).desc(), "feature_key")
    )


def contribution_by_version(base: DataFrame) -> DataFrame:
    return _component_sums(base).groupBy("model_version", "feature_key").agg(*_contribution(F.min("label")))


def contribution_difference(base: DataFrame) -> DataFrame:
    """Per component key: every version's figures, and candidate minus base."""
    versions = contribution_by_version(base)
    # All versions of the base rows take part in choosing, also those without components.
    roles = _roles(base)
    base_version = roles.select("base_version").scalar()
    candidate_version = roles.select("candidate_version").scalar()
    listed = F.sort_array(
        F.collect_list(
            F.struct("model_version", "count", "positive_count", "negative_count", "average_adjustment")
        )
    )
    mean = F.col("average_adjustment")
    grouped = (
        versions.groupBy("feature_key")
        .agg(
            F.max_by("label", "model_version").alias("label"),
            listed.alias("by_model_version"),
            F.max(F.when(F.col("model_version") == base_version, mean)).alias("base_mean"),
            F.max(F.when(F.col("model_version") == candidate_version, mean)).alias("candidate_mean"),
        )
    )
    difference = round_ties_up(F.col("candidate_mean") - F.col("base_mean"), 4)
    return (
        grouped.withColumn("average_adjustment_diff", difference)
        .orderBy(F.abs(F.coalesce("average_adjustment_diff", F.lit(0.0))).desc(), "feature_key")
        .select("feature_key", "label", "by_model_version", "base_mean", "candidate_mean", "average_adjustment_diff")
    )


def version_list(runs: DataFrame) -> DataFrame:
    return runs.select("model_version").distinct().orderBy("model_version")
