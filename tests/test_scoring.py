"""Scores, configurations, evaluation and analytics on small literal inputs."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from furlong import registry
from furlong.functions.scalars import round_ties_up
from furlong.plans import analytics, evaluation, predictions, reports
from furlong.sources import scoring_config
from furlong.sources.scoring_config import BUILT_IN, ConfigError, get_config, parse_config

FULL = {
    "horse.has_past_race": True,
    "horse.is_after_layoff_8w": False,
    "horse.days_since_last_race": 21,
    "horse.surface_top3_rate": 0.6,
    "horse.distance_top3_rate": 0.5,
    "horse.track_condition_top3_rate": 0.4,
    "horse.course_top3_rate": 0.5,
    "horse.best_time_same_surface_distance_ms": 94000,
    "horse.best_time_same_surface_distance_count": 2,
    "jockey.venue_win_rate": 0.2,
    "jockey.venue_top3_rate": 0.5,
    "jockey.distance_win_rate": 0.25,
    "jockey.distance_top3_rate": 0.45,
}
SOME = {k: FULL[k] for k in (
    "horse.has_past_race", "horse.is_after_layoff_8w", "horse.days_since_last_race", "horse.surface_top3_rate",
    "horse.distance_top3_rate", "horse.course_top3_rate", "jockey.venue_top3_rate", "jockey.distance_win_rate")}


def scored(spark, given, version="rule-based-v1"):
    row = {f.column: given.get(f.key) for f in registry.ALL}
    schema = ", ".join(f"{f.column} " + ("double" if f.is_number else "boolean") for f in registry.ALL)
    values = [float(v) if v is not None and not isinstance(v, bool) else v for v in row.values()]
    rows = predictions.scored_rows(spark.createDataFrame([tuple(values)], schema), [BUILT_IN[version]])
    return rows.select("score", predictions.score_detail([BUILT_IN[version]])["components"].alias("components")).first()


@pytest.mark.parametrize(
    "given, version, expected",
    [(SOME, "rule-based-v1", 59.57), ({}, "rule-based-v1", 50.0), (FULL, "rule-based-v1", 61.0),
     (FULL, "rule-based-v1.1", 58.55)],
)
def test_scores(spark, given, version, expected):
    assert scored(spark, given, version)["score"] == expected


def test_components(spark):
    parts = {c["key"]: c for c in scored(spark, FULL)["components"]}
    assert parts["horse.best_time_same_surface_distance_ms"]["adjustment"] == 1.0
    assert parts["jockey.venue_win_rate"]["adjustment"] == -0.52
    assert len(parts) == 12
    assert scored(spark, {})["components"] == []


def test_zero_is_dropped_for_rates_only(spark):
    assert scored(spark, {"horse.surface_top3_rate": 0.33})["components"] == []
    config = json.loads(json.dumps(scoring_config._RULE_BASED_V1))
    config["features"]["horse.has_past_race"]["positiveAdjustment"] = 0
    parsed = parse_config(config)
    rows = spark.createDataFrame([(True,)], "horse_has_past_race boolean").select(
        "*", *[F.lit(None).cast("double" if f.is_number else "boolean").alias(f.column) for f in registry.ALL
               if f.column != "horse_has_past_race"])
    detail = predictions.score_detail([parsed])["components"]
    assert len(predictions.scored_rows(rows, [parsed]).select(detail.alias("c")).first()["c"]) == 1


def test_score_stays_in_range(spark):
    best = {k: 1.0 for k in FULL if k.endswith("_rate")}
    config = json.loads(json.dumps(scoring_config._RULE_BASED_V1))
    config["scoreRange"] = {"base": 50, "min": 40, "max": 55}
    low = parse_config(config)
    rows = spark.createDataFrame([tuple(best.get(f.key) for f in registry.ALL)],
                                 ", ".join(f"{f.column} " + ("double" if f.is_number else "boolean") for f in registry.ALL))
    assert predictions.scored_rows(rows, [low]).first()["score"] == 55.0


def test_rounding_sends_ties_up(spark):
    values = [(-0.0005,), (0.0005,), (-0.0015,), (1.2345,), (-0.0002,)]
    rows = spark.createDataFrame(values, "x double").select(round_ties_up(F.col("x"), 3).alias("r")).collect()
    assert [r["r"] for r in rows] == [0.0, 0.001, -0.001, 1.235, 0.0]


def broken(change):
    config = json.loads(json.dumps(scoring_config._RULE_BASED_V1))
    change(config)
    return config


@pytest.mark.parametrize(
    "change",
    [
        lambda c: c["scoreRange"].update(min=100),
        lambda c: c["scoreRange"].update(base=101),
        lambda c: c["features"]["horse.days_since_last_race"].update(goodMaxDays=56),
        lambda c: c["features"]["horse.days_since_last_race"].update(shortThresholdDays=36),
        lambda c: c["features"]["horse.surface_top3_rate"].update(baseline=1.5),
        lambda c: c["features"]["horse.best_time_same_surface_distance"].update(minConfidence=0.9),
        lambda c: c["features"]["horse.surface_top3_rate"].update(type="other"),
        lambda c: c["features"]["horse.has_past_race"].pop("positiveValue"),
        lambda c: c.update(modelVersion=""),
    ],
)
def test_bad_configurations(change):
    with pytest.raises(ConfigError):
        parse_config(broken(change))


def test_configuration_lookup(spark, tmp_path):
    assert get_config().model_version == "rule-based-v1"
    assert list(BUILT_IN) == ["rule-based-v1", "rule-based-v1.1"]
    with pytest.raises(ConfigError, match="rule-based-v1.1"):
        get_config("v9")
    (tmp_path / "own.json").write_text(json.dumps(broken(lambda c: c.update(modelVersion="own"))), "utf-8")
    assert list(scoring_config.read_configs(spark, str(tmp_path))) == ["own"]
    with pytest.raises(ConfigError):
        get_config().parameters("horse.surface_top3_rate", "boolean")


EVALUATION_ROW = (
    "prediction_id string, run_id string, race_id string, entry_id string, predicted_rank int, "
    "prediction_score decimal(6,3), finish_position int, finish_status string, result_available_at timestamp"
)


def judged(spark, *rows):
    full = [(p, "run", "race", e, rank, None, position, "finished", datetime(2026, 6, 29)) for p, e, rank, position in rows]
    frame = spark.createDataFrame(full, EVALUATION_ROW)
    plain = {r["prediction_id"]: r for r in evaluation.evaluate(frame).collect()}
    assert plain == {r["prediction_id"]: r for r in evaluation.evaluate(frame, crowded_races=True).collect()}
    return plain


def test_evaluation(spark):
    rows = judged(spark, ("p1", "e1", 1, 2), ("p2", "e2", 2, 1), ("p3", "e3", 3, 5))
    assert [p for p, r in rows.items() if r["is_predicted_top1"]] == ["p1"]
    assert rows["p1"]["top_prediction_finish_position"] == 2
    assert rows["p1"]["top_prediction_is_top3"] is True
    assert rows["p1"]["actual_winner_in_predicted_top3"] is True
    assert rows["p2"]["is_actual_winner"] and rows["p2"]["rank_diff"] == 1


def test_evaluation_edges(spark):
    no_winner = judged(spark, ("p1", "e1", 1, None), ("p2", "e2", 2, 4))
    assert no_winner["p1"]["top_prediction_is_top3"] is None
    assert no_winner["p1"]["rank_diff"] is None
    assert no_winner["p2"]["actual_winner_in_predicted_top3"] is False
    dead_heat = judged(spark, ("p1", "e1", 5, 1), ("p2", "e2", 2, 1), ("p3", "e3", 3, 3), ("p4", "e4", 4, 4))
    assert dead_heat["p1"]["is_actual_winner"] and dead_heat["p2"]["is_actual_winner"]
    assert dead_heat["p1"]["winner_entry_id"] == "e2"
    late = judged(spark, ("p1", "e1", 4, 1), ("p2", "e2", 1, 2), ("p3", "e3", 2, 3), ("p4", "e4", 3, 4))
    assert late["p1"]["actual_winner_in_predicted_top3"] is False
    unranked = judged(spark, ("p1", "e1", None, 1), ("p2", "e2", 7, 2))
    assert unranked["p2"]["is_predicted_top1"] and unranked["p1"]["rank_diff"] is None
    assert unranked["p1"]["actual_winner_in_predicted_top3"] is True


BASE = (
    "run_id string, model_version string, race_id string, prediction_id string, rank_in_race int, rank_diff int, "
    "is_predicted_top1 boolean, top_prediction_is_top3 boolean, actual_winner_in_predicted_top3 boolean, "
    "score_components struct<components:array<struct<key:string,label:string,adjustment:double,reason:string>>>"
)
V1, V11 = "rule-based-v1", "rule-based-v1.1"


def base_rows(spark, *rows):
    return spark.createDataFrame(list(rows), BASE)


def parts(*pairs):
    return ([(key, f"label of {key}", adjustment, None) for key, adjustment in pairs],)


def test_metrics_and_comparison(spark):
    rows = base_rows(
        spark,
        ("run-1", V1, "race-1", "p1", 1, 1, True, True, True, parts()),
        ("run-1", V1, "race-1", "p2", 2, 1, None, None, None, parts()),
        ("run-2", V11, "race-2", "p3", 1, 4, True, False, False, parts()),
    )
    total = analytics.overall(rows).first()
    assert (total["evaluated_race_count"], total["top1_top3_rate"]) == (2, 0.5)
    assert (total["winner_in_predicted_top3_rate"], total["average_rank_diff"]) == (0.5, 2.0)
    assert total["is_small_sample"] is True
    diff = analytics.version_comparison(analytics.by_version(rows)).first()
    assert (diff["base_model_version"], diff["candidate_model_version"]) == (V1, V11)
    assert (diff["evaluated_race_count_diff"], diff["evaluated_prediction_count_diff"]) == (0, -1)
    assert (diff["top1_top3_rate_diff"], diff["winner_in_predicted_top3_rate_diff"]) == (-1.0, -1.0)
    assert diff["average_rank_diff_diff"] == 3.0 and diff["is_small_sample"] is True


@pytest.mark.parametrize(
    "versions, expected",
    [([V1], None), ([V11, "x"], (V11, V11)), (["a", "b"], ("a", "b")), (["a", V1], (V1, "a")), (["a", V1, V11], (V1, V11))],
)
def test_choice_of_versions(spark, versions, expected):
    rows = base_rows(spark, *[("r", v, "race", f"p{v}", 1, 1, True, True, True, parts()) for v in versions])
    found = analytics.version_comparison(analytics.by_version(rows)).collect()
    assert [(r["base_model_version"], r["candidate_model_version"]) for r in found] == ([expected] if expected else [])


def test_contribution(spark):
    rows = base_rows(
        spark,
        ("run-1", V1, "r", "p1", None, None, None, None, None, parts(("surface", 2.0), ("jockey", -1.0), ("zero", 0.0))),
        ("run-1", V1, "r", "p2", None, None, None, None, None, parts(("surface", 4.0))),
    )
    found = [tuple(r)[:1] + tuple(r)[2:] for r in analytics.feature_contribution(rows).collect()]
    assert found == [("surface", 2, 2, 0, 3.0), ("jockey", 1, 0, 1, -1.0)]


def test_contribution_difference(spark):
    rows = base_rows(
        spark,
        ("run-1", V1, "r", "p1", None, None, None, None, None, parts(("surface", 4.0), ("only", 1.0))),
        ("run-2", V11, "r", "p2", None, None, None, None, None, parts(("surface", 3.0))),
    )
    found = {r["feature_key"]: r for r in analytics.contribution_difference(rows).collect()}
    assert found["surface"]["average_adjustment_diff"] == -1.0
    assert [v["model_version"] for v in found["surface"]["by_model_version"]] == [V1, V11]
    assert found["only"]["average_adjustment_diff"] is None


def test_reasons(spark):
    given = parts(("a", 2.4), ("b", -2.0), ("c", 0.0), ("d", 5.0), ("e", 2.4), ("f", 0.1), ("g", -3.0))
    rows = spark.createDataFrame([("p", given)], "prediction_id string, " + BASE[BASE.index("score_components"):])
    found = [(r["direction"], r["place"], r["feature_key"]) for r in reports.reason_rows(rows).collect()]
    assert sorted(found) == [("negative", 1, "g"), ("negative", 2, "b"), ("positive", 1, "d"), ("positive", 2, "a"), ("positive", 3, "e")]


def test_component_parsing(spark):
    texts = [
        ('{"components":[{"key":"a","label":"L","adjustment":2,"reason":"r"},{"adjustment":"1.5"},{"adjustment":0}]}',),
        ('{"components":"no"}',), ("[]",), ("not json",), (None,),
    ]
    rows = spark.createDataFrame(texts, "j string").select(analytics.parse_components(F.col("j")).alias("c")).collect()
    assert [(c["key"], c["label"], c["adjustment"]) for c in rows[0]["c"]] == [("a", "L", 2.0), ("unknown", "特徴量", 1.5)]
    assert [r["c"] for r in rows[1:]] == [[], [], [], []]
    odd = '{"components":[5,{"key":7,"label":true,"adjustment":true},{"key":{},"adjustment":"0x10"},{"adjustment":"1d"},{"key":"k","adjustment":" -2e1 "}]}'
    kept = spark.createDataFrame([(odd,)], "j string").select(F.inline(analytics.parse_components(F.col("j")))).collect()
    assert [(c["key"], c["label"], c["adjustment"]) for c in kept] == [
        ("unknown", "特徴量", 1.0), ("unknown", "特徴量", 16.0), ("k", "特徴量", -20.0)
    ]
