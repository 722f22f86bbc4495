"""Lists, cards and details for readers of the tables."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from furlong import registry
from furlong.functions.scalars import body_weight_label, evaluation_label, finish_label, race_time_label
from furlong.model import HISTORY_PAGE_SIZE, RACE_PAGE_SIZE, Tables
from furlong.operators.latest import latest_feature_rows, latest_predictions
from furlong.operators.paging import all_of, page, page_after, page_totals
from furlong.plans.analytics import DEFAULT_LABEL, DEFAULT_REASON, UNKNOWN_KEY

# --- fixed values ------------------------------------------------------------
SURFACE_FILTERS = {"turf": "芝", "dirt": "ダート"}
REASON_LIMIT = 3
# -----------------------------------------------------------------------------


def filter_races(
    races: DataFrame, race_date: str | None = None, venue: str | None = None, surface: str | None = None
) -> DataFrame:
    """Absent filters keep all. The surface filter matches the word anywhere, in any case."""
    conditions: list[Column] = []
    if race_date:
        conditions.append(F.col("race_date") == F.lit(race_date).cast("date"))
    if venue:
        conditions.append(F.col("venue") == venue)
    if surface in SURFACE_FILTERS:
        conditions.append(F.col("surface").ilike(f"%{SURFACE_FILTERS[surface]}%"))
    return races.filter(all_of(conditions))


def _race_columns(races: DataFrame) -> DataFrame:
    return races.select(
        "race_id", "race_date", "venue", "race_number", "name", "scheduled_start_at", "surface",
        "distance_meters", "status", "observed_at",
    )


def races_page(races: DataFrame, number: int, **filters: str | None) -> DataFrame:
    order = [F.asc("scheduled_start_at"), F.asc("race_number"), F.asc("race_id")]
    return page(_race_columns(filter_races(races, **filters)), order, number, RACE_PAGE_SIZE)


RACE_ORDER = (("scheduled_start_at", True), ("race_number", True), ("race_id", True))
BATCH_ORDER = (("started_at", False), ("batch_id", True))


def races_page_after(races: DataFrame, last: Mapping[str, object] | None, **filters: str | None) -> DataFrame:
    """The page of the race list that follows a row of it."""
    return page_after(_race_columns(filter_races(races, **filters)), RACE_ORDER, last, RACE_PAGE_SIZE)


def batches_page_after(batches: DataFrame, last: Mapping[str, object] | None) -> DataFrame:
    """The page of a batch history, newest first, that follows a row of it."""
    return page_after(batches, BATCH_ORDER, last, HISTORY_PAGE_SIZE)


def races_totals(races: DataFrame, **filters: str | None) -> DataFrame:
    return page_totals(filter_races(races, **filters), RACE_PAGE_SIZE)


def filter_options(races: DataFrame, runs: DataFrame) -> DataFrame:
    """The values each filter offers, as (filter, value)."""

    def options(rows: DataFrame, column: str) -> DataFrame:
        return rows.select(F.col(column).cast("string").alias("value")).distinct().select(
            F.lit(column).alias("filter"), "value"
        )

    listed = options(races, "race_date").unionByName(options(races, "venue"))
    return listed.unionByName(options(runs, "model_version")).orderBy("filter", "value")


def race_card(
    tables: Tables, feature_rows: DataFrame, predictions: DataFrame, race_id: object | None = None
) -> DataFrame:
    """Entries with masters, result, latest features and latest prediction.

    One race, or every race when no id is given. The features are those of the
    newest instant, whatever it is. A given id filters the scans of entries,
    features and predictions, so nothing of other races is looked up.
    """
    entries = tables.entries
    if race_id is not None:
        entries, feature_rows, predictions = (
            rows.filter(F.col("race_id") == F.lit(race_id)) for rows in (entries, feature_rows, predictions)
        )
    results = tables.results.select(
        "entry_id", "finish_position", "finish_status", "finish_time_milliseconds", "final_odds",
        F.col("status").alias("result_status"),
    )
    latest = latest_feature_rows(feature_rows).select(
        "entry_id", F.col("as_of_at").alias("features_as_of_at"), F.col("generated_at").alias("features_generated_at"),
        *[f.column for f in registry.ALL],
    )
    predicted = latest_predictions(
        predictions.select("entry_id", "prediction_id", "model_version", "as_of_at", "prediction_score", "rank_in_race")
    ).select(
        "entry_id", "prediction_score", "rank_in_race", F.col("as_of_at").alias("prediction_as_of_at")
    )
    horses = tables.horses.select("horse_id", F.col("name").alias("horse_name"), F.col("sex").alias("horse_sex"))
    jockeys = tables.jockeys.select("jockey_id", F.col("name").alias("jockey_name"))
    trainers = tables.trainers.select(
        "trainer_id", F.col("name").alias("trainer_name"), F.col("affiliation").alias("trainer_affiliation")
    )
    return (
        entries.join(horses, "horse_id")
        .join(jockeys, "jockey_id")
        .join(trainers, "trainer_id")
        .join(results, "entry_id", "left")
        .join(latest, "entry_id", "left")
        .join(predicted, "entry_id", "left")
        .select(
            "race_id", "entry_id", "frame_number", "horse_number", "assigned_weight", "body_weight",
            "body_weight_diff", F.col("status").alias("entry_status"), "available_at", "horse_name", "horse_sex",
            "jockey_name", "trainer_name", "trainer_affiliation", "finish_position", "finish_status",
            "finish_time_milliseconds", "final_odds", "result_status",
            body_weight_label(F.col("body_weight"), F.col("body_weight_diff")).alias("body_weight_label"),
            race_time_label(F.col("finish_time_milliseconds")).alias("finish_time_label"),
            finish_label(F.col("finish_position"), F.col("finish_status")).alias("finish_label"),
            "features_as_of_at", "features_generated_at", *[f.column for f in registry.ALL],
            "prediction_score", "rank_in_race", "prediction_as_of_at",
        )
    )


def race_card_one(tables: Tables, feature_rows: DataFrame, predictions: DataFrame, race_id: object) -> DataFrame:
    """One race's card with the race itself, the components of the prediction, and its place in the list."""
    race = tables.races.filter(F.col("race_id") == F.lit(race_id)).select(
        "race_id", "race_date", "venue", "race_number", F.col("name").alias("race_name"), F.col("surface").alias("race_surface"),
        "distance_meters", F.col("status").alias("race_status"),
    )
    parts = latest_predictions(predictions.filter(F.col("race_id") == F.lit(race_id))).select("entry_id", "score_components")
    card = race_card(tables, feature_rows, predictions, race_id).join(race, "race_id").join(parts, "entry_id", "left")
    place = F.row_number().over(Window.partitionBy("race_id").orderBy(F.asc_nulls_last("horse_number"), "entry_id"))
    return card.withColumn("position", place).orderBy("position")


def run_detail_one(
    tables: Tables, predictions: DataFrame, evaluations: DataFrame, run_id: str, key: Sequence[str] = ("prediction_id",)
) -> DataFrame:
    """One run's predictions in the order of date, race number and rank."""
    order = [F.asc("race_date"), F.asc("race_number"), F.asc_nulls_last("rank_in_race"), F.asc("prediction_id")]
    return prediction_detail(tables, predictions, evaluations, run_id, key).orderBy(*order)


def feature_batches_page(batches: DataFrame, number: int, status: str = "all") -> DataFrame:
    kept = batches if status == "all" else batches.filter(F.col("status") == status)
    return page(kept, [F.desc("started_at"), F.asc("batch_id")], number, HISTORY_PAGE_SIZE)


def feature_batch_detail(feature_rows: DataFrame) -> DataFrame:
    """Per batch: snapshots, races and entries. A wide row is one snapshot per feature."""
    return feature_rows.groupBy("batch_id").agg(
        (F.count("*") * len(registry.ALL)).alias("generated_feature_count"),
        F.count_distinct("race_id").alias("target_race_count"),
        F.count_distinct("entry_id").alias("target_entry_count"),
    )


def feature_key_counts(feature_rows: DataFrame) -> DataFrame:
    """Snapshots per batch and feature key."""
    keys = F.explode(F.array(*[F.lit(feature.key) for feature in registry.ALL])).alias("feature_key")
    return (
        feature_rows.select("batch_id", keys)
        .groupBy("batch_id", "feature_key")
        .agg(F.count("*").alias("snapshot_count"))
        .orderBy("batch_id", "feature_key")
    )


def prediction_runs_page(runs: DataFrame, evaluations: DataFrame, number: int, status: str = "all") -> DataFrame:
    """Runs, newest first, with how many of their predictions were evaluated."""
    kept = runs if status == "all" else runs.filter(F.col("status") == status)
    evaluated = evaluations.groupBy("run_id").agg(F.count("*").alias("evaluation_count"))
    counted = kept.join(evaluated, "run_id", "left").withColumn(
        "evaluation_count", F.coalesce("evaluation_count", F.lit(0).cast("bigint"))
    )
    labelled = counted.withColumn(
        "evaluation_label", evaluation_label(F.col("total_count"), F.col("evaluation_count"))
    )
    return page(labelled, [F.desc("started_at"), F.asc("run_id")], number, HISTORY_PAGE_SIZE)


def run_totals(runs: DataFrame, predictions: DataFrame, evaluations: DataFrame) -> DataFrame:
    """Per run: predictions, races and evaluations."""
    predicted = predictions.groupBy("run_id").agg(
        F.count("*").alias("prediction_count"), F.count_distinct("race_id").alias("target_race_count")
    )
    evaluated = evaluations.groupBy("run_id").agg(F.count("*").alias("evaluation_count"))
    zero = F.lit(0).cast("bigint")
    return (
        runs.select("run_id")
        .join(predicted, "run_id", "left")
        .join(evaluated, "run_id", "left")
        .select(
            "run_id",
            *[F.coalesce(c, zero).alias(c) for c in ("prediction_count", "target_race_count", "evaluation_count")],
        )
    )


def prediction_detail(
    tables: Tables, predictions: DataFrame, evaluations: DataFrame, run_id: str | None = None,
    key: Sequence[str] = ("prediction_id",), spread: Callable[[DataFrame], DataFrame] | None = None,
    carried: Sequence[str] = (),
) -> DataFrame:
    """Predictions with names and evaluation, of one run or of all.

    The race summary columns repeat what the top pick's evaluation says. ``key``
    names the columns by which predictions and evaluations meet. Rows that hold
    the predictions of all versions together meet their names before ``spread``
    makes a row per version. Components are listed if the predictions have them;
    ``carried`` are columns of the predictions that they can be made of afterwards.
    """
    races = tables.races.select("race_id", "race_date", "venue", "race_number", F.col("name").alias("race_name"))
    entries = tables.entries.select("entry_id", "horse_number")
    horses = tables.horses.select("horse_id", F.col("name").alias("horse_name"))
    jockeys = tables.jockeys.select("jockey_id", F.col("name").alias("jockey_name"))
    facts = [
        "finish_position", "finish_status", "is_predicted_top1", "top_prediction_finish_position", "top_prediction_is_top3",
        "is_actual_winner", "actual_winner_in_predicted_top3", "rank_diff", "evaluated_at",
    ]
    names = [name for rows in (races, entries, horses, jockeys) for name in rows.columns[1:]]
    shown = [
        "prediction_id", "jockey_id", "horse_id", "entry_id", "race_id", "run_id", "prediction_score", "rank_in_race",
    ]

    def named(rows: DataFrame) -> DataFrame:
        rows = rows.join(races, "race_id").join(entries, "entry_id").join(horses, "horse_id")
        return rows.join(jockeys, "jockey_id", "left")

    if spread is None:
        kept = predictions if run_id is None else predictions.filter(F.col("run_id") == run_id)
        rows = named(kept.select(*shown, *carried, *[name for name in kept.columns if name == "score_components"]))
    else:
        rows = spread(named(predictions))
        rows = rows if run_id is None else rows.filter(F.col("run_id") == run_id)
    listed = [*shown, *carried, *[name for name in rows.columns if name == "score_components"], *names, *facts]
    return rows.join(evaluations.select(*key, *facts), list(key), "left").select(*listed)


def race_summary(evaluations: DataFrame) -> DataFrame:
    """Per (run, race): the figures of the top pick; races without evaluation are absent."""
    return evaluations.filter("is_predicted_top1").select(
        "run_id", "race_id", "top_prediction_finish_position", "top_prediction_is_top3",
        "actual_winner_in_predicted_top3",
    )


def components_text(components: Column) -> Column:
    """All components in order as one text: key, label, number, truth value, adjustment and reason of each."""

    def number(value: Column) -> Column:
        return F.coalesce(value.cast("decimal(18,6)").cast("string"), F.lit(""))

    def described(item: Column) -> Column:
        truth = F.coalesce(item["value_boolean"].cast("string"), F.lit(""))
        return F.concat_ws("|", item["key"], item["label"], number(item["value_number"]), truth, number(item["adjustment"]), item["reason"])

    return F.array_join(F.transform(components, described), ";")


def reasons(components: Column, positive: bool, limit: int = REASON_LIMIT) -> Column:
    """The components that changed the score most in one direction, strongest first.

    Zero and non-finite adjustments are not reasons; equal ones keep their order.
    """
    sign = 1.0 if positive else -1.0
    placed = F.transform(
        components,
        lambda item, place: F.struct(
            (-item["adjustment"] * sign).alias("weight"), place.alias("place")
        ),
    )
    # The weight is negative for the wanted direction, so plain ascending order fits. Texts are looked up for what is left.
    wanted = F.filter(placed, lambda item: (item["weight"] < 0) & (item["weight"] > float("-inf")))

    def described(item: Column) -> Column:
        component = F.get(components, item["place"])
        return F.struct(
            F.coalesce(component["key"], F.lit(UNKNOWN_KEY)).alias("key"),
            F.coalesce(component["label"], F.lit(DEFAULT_LABEL)).alias("label"),
            component["adjustment"].alias("adjustment"),
            F.coalesce(component["reason"], F.lit(DEFAULT_REASON)).alias("reason"),
        )

    # No element is null, so this sorts as ``array_sort`` does, without a comparing function.
    return F.transform(F.slice(F.sort_array(wanted), 1, limit), described)


def reason_rows(predictions: DataFrame, limit: int = REASON_LIMIT) -> DataFrame:
    """Reasons as rows: direction, place in its list, key, adjustment, text."""
    components = F.col("score_components.components")

    def side(direction: str, positive: bool) -> Column:
        return F.transform(
            reasons(components, positive, limit),
            lambda item, nth: F.struct(
                F.lit(direction).alias("direction"), (nth + 1).alias("place"), item["key"].alias("feature_key"),
                item["adjustment"].alias("adjustment"), item["reason"].alias("reason"),
            ),
        )

    # Outer, as a filter on its size would make every list twice; a prediction without reasons has no direction then.
    listed = predictions.select("prediction_id", F.inline_outer(F.concat(side("positive", True), side("negative", False))))
    return listed.filter(F.col("direction").isNotNull())


def _kept_batches(batches: DataFrame, mode: str, status: str) -> DataFrame:
    conditions = []
    if mode != "all":
        conditions.append(F.col("mode") == mode)
    if status != "all":
        conditions.append(F.col("status") == status)
    return batches.filter(all_of(conditions))


def import_batches_page(batches: DataFrame, number: int, mode: str = "all", status: str = "all") -> DataFrame:
    order = [F.desc("started_at"), F.asc("batch_id")]
    return page(_kept_batches(batches, mode, status), order, number, HISTORY_PAGE_SIZE)


def import_batches_totals(batches: DataFrame, mode: str = "all", status: str = "all") -> DataFrame:
    return page_totals(_kept_batches(batches, mode, status), HISTORY_PAGE_SIZE)


def prediction_runs_totals(runs: DataFrame, status: str = "all") -> DataFrame:
    return page_totals(runs if status == "all" else runs.filter(F.col("status") == status), HISTORY_PAGE_SIZE)


def import_batch_errors(errors: DataFrame, batch_id: str) -> DataFrame:
    """Errors of a batch, newest first."""
    return errors.filter(F.col("batch_id") == batch_id).orderBy(
        F.desc("created_at"), F.asc("file_name"), F.asc("row_number"), F.asc("error_message")
    )
