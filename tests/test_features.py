"""The feature definitions on a hand-made history."""

from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from furlong import registry
from furlong.functions.scalars import surface_class
from furlong.model import Tables
from furlong.operators.latest import latest_feature_rows, latest_snapshots
from furlong.plans import features

TOKYO = timezone(timedelta(hours=9))
AS_OF = "2026-07-04T10:00:00+09:00"
PUBLISHED = datetime(2026, 6, 20, 16, 0, tzinfo=TOKYO)


def make_tables(spark, past, jockey="j1", condition="良"):
    """A target race on 2026-07-04 and past rides of (horse, jockey, overrides)."""
    races, entries, results = [], [], []
    early = datetime(2026, 1, 1, tzinfo=TOKYO)

    def add(name, horse, rider, date, **over):
        start = over.get("start", datetime.fromisoformat(f"{date}T15:40:00+09:00"))
        races.append((name, datetime.fromisoformat(date).date(), over.get("venue", "東京"), start,
                      over.get("surface", "芝"), over.get("distance", 1600), over.get("condition", "良"), early))
        entries.append((f"e-{name}", name, horse, rider, 1, early))
        if over.get("result", True):
            results.append((f"e-{name}", over.get("position", 1), over.get("status", "finished"),
                            over.get("time", 93000), over.get("published", PUBLISHED), over.get("published", PUBLISHED)))

    add("target", "h1", jockey, "2026-07-04", condition=condition, published=datetime(2026, 7, 4, 16, tzinfo=TOKYO))
    for number, (horse, rider, date, over) in enumerate(past):
        add(f"past{number}", horse, rider, date, **over)
    none = spark.createDataFrame([], "x string")
    return Tables(
        races=spark.createDataFrame(races, "race_id string, race_date date, venue string, scheduled_start_at timestamp, "
                                    "surface string, distance_meters int, track_condition string, available_at timestamp"),
        horses=none, jockeys=none, trainers=none,
        entries=spark.createDataFrame(entries, "entry_id string, race_id string, horse_id string, jockey_id string, "
                                      "horse_number int, available_at timestamp"),
        results=spark.createDataFrame(results, "entry_id string, finish_position int, finish_status string, "
                                      "finish_time_milliseconds int, available_at timestamp, observed_at timestamp"),
    )


def target_row(tables, as_of=AS_OF):
    return features.feature_rows(tables, [as_of]).filter("entry_id = 'e-target'").first().asDict()


def test_recent_form(spark):
    row = target_row(make_tables(spark, [
        ("h1", "other", "2026-06-01", {"position": 2}),
        ("h1", "other", "2026-04-01", {"surface": "ダート", "distance": 1800, "position": 6}),
    ]))
    assert row["horse_days_since_last_race"] == 33
    assert row["horse_has_past_race"] is True
    assert row["horse_is_after_layoff_8w"] is False
    assert (row["horse_surface_starts"], float(row["horse_surface_top3_rate"])) == (1, 1.0)
    assert (row["horse_distance_starts"], float(row["horse_distance_top3_rate"])) == (1, 1.0)


def test_best_time_condition_and_course(spark):
    row = target_row(make_tables(spark, [
        ("h1", "other", "2026-06-01", {"position": 2, "time": 93400}),
        ("h1", "other", "2026-05-01", {"position": 5, "time": 92800}),
        ("h1", "other", "2026-04-01", {"position": 4, "time": 94000}),
        ("h1", "other", "2026-03-01", {"position": 1, "time": 90000, "status": "disqualified", "venue": "京都",
                                       "condition": "重"}),
    ]))
    assert row["horse_best_time_same_surface_distance_ms"] == 92800
    assert row["horse_best_time_same_surface_distance_count"] == 3
    assert row["horse_track_condition_starts"] == 3
    assert float(row["horse_track_condition_top3_rate"]) == pytest.approx(1 / 3, abs=1e-6)
    assert row["horse_course_starts"] == 3
    assert float(row["horse_course_top3_rate"]) == pytest.approx(1 / 3, abs=1e-6)


def test_jockey_rides(spark):
    row = target_row(make_tables(spark, [
        ("x1", "j1", "2026-06-01", {"position": 1}),
        ("x2", "j1", "2026-05-01", {"position": 3, "distance": 1800}),
        ("x3", "j1", "2026-04-01", {"position": 8}),
        ("x4", "j1", "2026-03-01", {"position": 5, "venue": "京都"}),
    ]))
    assert [row[f"jockey_venue_{n}"] for n in ("starts", "wins", "top3")] == [3, 1, 2]
    assert float(row["jockey_venue_win_rate"]) == pytest.approx(1 / 3, abs=1e-6)
    assert float(row["jockey_venue_top3_rate"]) == pytest.approx(2 / 3, abs=1e-6)
    assert [row[f"jockey_distance_{n}"] for n in ("starts", "wins", "top3")] == [3, 1, 1]
    assert row["horse_has_past_race"] is False


def test_nothing_leaks(spark):
    late = datetime(2026, 7, 4, 12, tzinfo=TOKYO)
    row = target_row(make_tables(spark, [
        ("h1", "j1", "2026-06-01", {"published": late}),
        ("h1", "j1", "2026-07-04", {}),
        ("h1", "j1", "2026-07-20", {}),
    ]))
    assert row["horse_has_past_race"] is False
    assert row["horse_days_since_last_race"] is None
    assert row["horse_is_after_layoff_8w"] is None
    for column in ("horse_surface_starts", "horse_course_starts", "jockey_venue_starts", "jockey_distance_wins"):
        assert row[column] == 0
    for column in ("horse_surface_top3_rate", "horse_best_time_same_surface_distance_ms", "jockey_venue_win_rate",
                   "horse_available_until", "jockey_venue_observed_until"):
        assert row[column] is None


def test_moving_the_instant_reveals_the_result(spark):
    late = datetime(2026, 7, 4, 12, tzinfo=TOKYO)
    tables = make_tables(spark, [("h1", "j1", "2026-06-01", {"published": late})])
    assert target_row(tables)["horse_has_past_race"] is False
    assert target_row(tables, "2026-07-04T12:00:00+09:00")["horse_has_past_race"] is True


@pytest.mark.parametrize("condition", [None, ""])
def test_unknown_condition_matches_nothing(spark, condition):
    row = target_row(make_tables(spark, [("h1", "j1", "2026-06-01", {"condition": condition})], condition=condition))
    assert row["horse_track_condition_starts"] == 0
    assert row["horse_track_condition_top3_rate"] is None
    assert row["horse_surface_starts"] == 1


def test_layoff_boundary(spark):
    assert target_row(make_tables(spark, [("h1", "j1", "2026-05-09", {})]))["horse_is_after_layoff_8w"] is True
    assert target_row(make_tables(spark, [("h1", "j1", "2026-05-10", {})]))["horse_is_after_layoff_8w"] is False


def test_surface_words(spark):
    words = [("芝",), ("ダート",), ("障害",), ("ダート・芝",)]
    rows = spark.createDataFrame(words, "s string").select(surface_class(F.col("s")).alias("c")).collect()
    assert [r["c"] for r in rows] == ["turf", "dirt", "other", "turf"]


def test_long_and_wide_agree(spark):
    tables = make_tables(spark, [("h1", "j1", "2026-06-01", {}), ("h2", "j1", "2026-06-01", {})])
    wide = features.feature_rows(tables, [AS_OF, "2026-07-05T00:00:00Z"])
    long = features.to_long(wide)
    assert long.count() == wide.count() * len(registry.ALL)
    from_long = features.to_wide(latest_snapshots(long, "2026-07-04T20:00:00Z"))
    newest = latest_feature_rows(wide, "2026-07-04T20:00:00Z")
    columns = ["entry_id", *[f"cast({f.column} as double) as {f.column}" for f in registry.ALL]]
    assert sorted(map(str, from_long.selectExpr(*columns).collect())) == sorted(
        map(str, newest.selectExpr(*columns).collect())
    )


def test_a_newer_null_hides_an_older_value(spark):
    rows = spark.createDataFrame(
        [("e", "k", datetime(2026, 1, 1), 1, 5.0), ("e", "k", datetime(2026, 1, 2), 1, None)],
        "entry_id string, feature_key string, as_of_at timestamp, feature_version int, value_number double",
    )
    assert latest_snapshots(rows).first()["value_number"] is None
    assert latest_snapshots(rows, "2026-01-01T12:00:00Z").first()["value_number"] == 5.0


def test_registry():
    assert len(registry.ALL) == 23 and len(registry.P0_KEYS) == 7
    ids = [f.definition_id for f in registry.ALL]
    assert ids[0].endswith("-000000000001") and ids[7].endswith("-000000000101") and ids[-1].endswith("-000000000210")
    assert [f.key for f in registry.ALL if not f.is_number] == ["horse.has_past_race", "horse.is_after_layoff_8w"]
