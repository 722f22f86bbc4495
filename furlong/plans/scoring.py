"""Rule-based score of an entry as column expressions."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from furlong import registry
from furlong.functions.scalars import round_ties_up
from furlong.sources.scoring_config import ConfigError, ScoringConfig

# --- fixed values: labels and reasons, in the order of the components --------
LABELS = {
    "horse.has_past_race": "過去出走",
    "horse.is_after_layoff_8w": "8週休み明け",
    "horse.days_since_last_race": "前走間隔",
    "horse.surface_top3_rate": "同馬場区分3着内率",
    "horse.distance_top3_rate": "同距離3着内率",
    "horse.track_condition_top3_rate": "同馬場状態3着内率",
    "horse.course_top3_rate": "同コース3着内率",
    "horse.best_time_same_surface_distance": "同馬場同距離の持ち時計",
    "jockey.venue_win_rate": "騎手・同競馬場勝率",
    "jockey.venue_top3_rate": "騎手・同競馬場3着内率",
    "jockey.distance_win_rate": "騎手・同距離勝率",
    "jockey.distance_top3_rate": "騎手・同距離3着内率",
}
RAISED = "がスコアを押し上げました"
LOWERED = "がスコアを抑えました"
INTERVAL_SHORT = "前走間隔が短めです"
INTERVAL_LAYOFF = "前走から間隔が空いています"
INTERVAL_GOOD = "前走間隔が扱いやすい範囲です"
INTERVAL_STANDARD = "前走間隔が標準的です"
ABOVE_BASELINE = "が平均的な基準より高めです"
BELOW_BASELINE = "が平均的な基準より低めです"
TIMED = "同条件の持ち時計があるため、軽く加点しました"
DISCLAIMER = "このスコアは勝率・複勝率ではなく、特徴量に基づく相対評価です。"
# -----------------------------------------------------------------------------

BOOLEAN_KEYS = ("horse.has_past_race", "horse.is_after_layoff_8w")
INTERVAL_KEY = "horse.days_since_last_race"
BEST_TIME_KEY = "horse.best_time_same_surface_distance"

Read = Callable[[str], Column]


def wide_column(key: str) -> Column:
    """Features as they are named in the wide rows; numbers as doubles."""
    feature = registry.BY_KEY[key]
    column = F.col(feature.column)
    return column.cast("double") if feature.is_number else column


def read_columns(configs: Sequence[ScoringConfig]) -> set[str]:
    """The wide columns that the rules and components of the configurations read."""
    names = set()

    def read(key: str) -> Column:
        names.add(registry.BY_KEY[key].column)
        return wide_column(key)

    for config in configs:
        adjustments(config, read)
    components(configs, F.lit(""), F.array(), read)
    return names


def _number(value: Any) -> Column:
    return F.lit(float(value))


def _boolean(value: Column, rule: Mapping[str, Any]) -> Column:
    chosen = F.when(value == F.lit(rule["positiveValue"]), _number(rule["positiveAdjustment"]))
    return F.when(value.isNotNull(), chosen.otherwise(_number(rule["negativeAdjustment"])))


def _by_interval(value: Column, rule: Mapping[str, Any], short, layoff, good, standard) -> Column:
    return (
        F.when(value.isNull(), None)
        .when(value < rule["shortThresholdDays"], short)
        .when(value >= rule["layoffThresholdDays"], layoff)
        .when(value <= rule["goodMaxDays"], good)
        .otherwise(standard)
    )


def _interval(value: Column, rule: Mapping[str, Any]) -> Column:
    names = ("short", "layoff", "good", "standard")
    return _by_interval(value, rule, *[_number(rule[f"{name}Adjustment"]) for name in names])


def _rate(value: Column, rule: Mapping[str, Any]) -> Column:
    centred = (value - _number(rule["baseline"])) * _number(rule["maxAdjustment"])
    # Only here a zero is as good as no component.
    return F.nullif(round_ties_up(centred, 3), F.lit(0.0))


def _best_time(value: Column, count: Column, rule: Mapping[str, Any]) -> Column:
    from_count = F.least(
        F.lit(1.0), F.greatest(_number(rule["minConfidence"]), count / _number(rule["fullConfidenceCount"]))
    )
    confidence = F.when(count.isNotNull(), from_count).otherwise(_number(rule["defaultConfidence"]))
    return F.when(value.isNotNull(), round_ties_up(_number(rule["baseAdjustment"]) * confidence, 3))


def adjustments(config: ScoringConfig, read: Read = wide_column) -> Column:
    """The adjustment of every component in order, null where one does not apply."""
    found = []
    for key in LABELS:
        if key in BOOLEAN_KEYS:
            found.append(_boolean(read(key), config.parameters(key, "boolean")))
        elif key == INTERVAL_KEY:
            found.append(_interval(read(key), config.parameters(key, "interval_days")))
        elif key == BEST_TIME_KEY:
            rule = config.parameters(key, "best_time")
            found.append(_best_time(read(rule["featureKey"]), read(rule["countFeatureKey"]), rule))
        else:
            found.append(_rate(read(key), config.parameters(key, "rate")))
    return F.array(*found)


def score(base: Column, low: Column, high: Column, adjusted: Column) -> Column:
    """Base plus all adjustments in order, rounded and kept in range."""
    total = F.lit(0.0)
    for nth in range(len(LABELS)):
        total = total + F.coalesce(adjusted[nth], F.lit(0.0))
    return F.least(high, F.greatest(low, round_ties_up(base + total, 3)))


def components(configs: Sequence[ScoringConfig], version: Column, adjusted: Column, read: Read = wide_column) -> Column:
    """The components that apply, with value, adjustment and reason."""
    listed = []
    for nth, (key, label) in enumerate(LABELS.items()):
        adjustment = adjusted[nth]
        shown, truth = key, F.lit(None).cast("boolean")
        if key in BOOLEAN_KEYS:
            value, truth = F.lit(None).cast("double"), read(key)
            reason = F.when(adjustment >= 0, label + RAISED).otherwise(label + LOWERED)
        elif key == INTERVAL_KEY:
            value = read(key)
            texts = [F.lit(t) for t in (INTERVAL_SHORT, INTERVAL_LAYOFF, INTERVAL_GOOD, INTERVAL_STANDARD)]
            reason = F.coalesce(
                *[
                    F.when(version == c.model_version, _by_interval(value, c.parameters(key, "interval_days"), *texts))
                    for c in configs
                ]
            )
        elif key == BEST_TIME_KEY:
            rules = {c.model_version: c.parameters(key, "best_time")["featureKey"] for c in configs}
            if len(set(rules.values())) > 1:
                raise ConfigError(f"{key}: the configurations name different features")
            shown = next(iter(rules.values()))
            value, reason = read(shown), F.lit(TIMED)
        else:
            value = read(key)
            reason = F.when(adjustment > 0, label + ABOVE_BASELINE).otherwise(label + BELOW_BASELINE)
        item = F.struct(
            F.lit(shown).alias("key"),
            F.lit(label).alias("label"),
            value.alias("value_number"),
            truth.alias("value_boolean"),
            adjustment.alias("adjustment"),
            reason.alias("reason"),
        )
        listed.append(F.when(adjustment.isNotNull(), item))
    return F.array_compact(F.array(*listed))
