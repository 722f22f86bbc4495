"""Scoring configurations: the two built-in versions, JSON files, checks."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.sql import SparkSession

# --- fixed values: scoring weights per model version -------------------------
_RULE_BASED_V1 = {
    "modelVersion": "rule-based-v1",
    "scoreRange": {"base": 50, "min": 0, "max": 100},
    "features": {
        "horse.has_past_race": {"type": "boolean", "positiveValue": True, "positiveAdjustment": 1.5, "negativeAdjustment": -2},
        "horse.is_after_layoff_8w": {"type": "boolean", "positiveValue": False, "positiveAdjustment": 1, "negativeAdjustment": -2},
        "horse.days_since_last_race": {
            "type": "interval_days",
            "shortThresholdDays": 10, "goodMaxDays": 35, "layoffThresholdDays": 56,
            "shortAdjustment": -2, "goodAdjustment": 2, "standardAdjustment": 1, "layoffAdjustment": -2,
        },
        "horse.surface_top3_rate": {"type": "rate", "baseline": 0.33, "maxAdjustment": 8},
        "horse.distance_top3_rate": {"type": "rate", "baseline": 0.33, "maxAdjustment": 8},
        "horse.track_condition_top3_rate": {"type": "rate", "baseline": 0.33, "maxAdjustment": 5},
        "horse.course_top3_rate": {"type": "rate", "baseline": 0.33, "maxAdjustment": 6},
        "horse.best_time_same_surface_distance": {
            "type": "best_time",
            "featureKey": "horse.best_time_same_surface_distance_ms",
            "countFeatureKey": "horse.best_time_same_surface_distance_count",
            "baseAdjustment": 2, "minConfidence": 0.25, "fullConfidenceCount": 4, "defaultConfidence": 0.5,
        },
        "jockey.venue_win_rate": {"type": "rate", "baseline": 0.33, "maxAdjustment": 4},
        "jockey.venue_top3_rate": {"type": "rate", "baseline": 0.33, "maxAdjustment": 5},
        "jockey.distance_win_rate": {"type": "rate", "baseline": 0.33, "maxAdjustment": 4},
        "jockey.distance_top3_rate": {"type": "rate", "baseline": 0.33, "maxAdjustment": 5},
    },
}
_RULE_BASED_V11 = {
    "modelVersion": "rule-based-v1.1",
    "scoreRange": {"base": 50, "min": 0, "max": 100},
    "features": {
        "horse.has_past_race": {"type": "boolean", "positiveValue": True, "positiveAdjustment": 1.2, "negativeAdjustment": -1.5},
        "horse.is_after_layoff_8w": {"type": "boolean", "positiveValue": False, "positiveAdjustment": 0.8, "negativeAdjustment": -1.5},
        "horse.days_since_last_race": {
            "type": "interval_days",
            "shortThresholdDays": 10, "goodMaxDays": 35, "layoffThresholdDays": 56,
            "shortAdjustment": -1.5, "goodAdjustment": 1.5, "standardAdjustment": 0.8, "layoffAdjustment": -1.5,
        },
        "horse.surface_top3_rate": {"type": "rate", "baseline": 0.33, "maxAdjustment": 6},
        "horse.distance_top3_rate": {"type": "rate", "baseline": 0.33, "maxAdjustment": 6},
        "horse.track_condition_top3_rate": {"type": "rate", "baseline": 0.33, "maxAdjustment": 4},
        "horse.course_top3_rate": {"type": "rate", "baseline": 0.33, "maxAdjustment": 5},
        "horse.best_time_same_surface_distance": {
            "type": "best_time",
            "featureKey": "horse.best_time_same_surface_distance_ms",
            "countFeatureKey": "horse.best_time_same_surface_distance_count",
            "baseAdjustment": 1.5, "minConfidence": 0.25, "fullConfidenceCount": 4, "defaultConfidence": 0.5,
        },
        "jockey.venue_win_rate": {"type": "rate", "baseline": 0.33, "maxAdjustment": 3},
        "jockey.venue_top3_rate": {"type": "rate", "baseline": 0.33, "maxAdjustment": 4},
        "jockey.distance_win_rate": {"type": "rate", "baseline": 0.33, "maxAdjustment": 3},
        "jockey.distance_top3_rate": {"type": "rate", "baseline": 0.33, "maxAdjustment": 4},
    },
}
# -----------------------------------------------------------------------------

DEFAULT_VERSION = _RULE_BASED_V1["modelVersion"]

# Parameters each feature type must have; integers are marked.
_PARAMETERS = {
    "boolean": ("positiveValue", "positiveAdjustment", "negativeAdjustment"),
    "interval_days": (
        "shortThresholdDays",
        "goodMaxDays",
        "layoffThresholdDays",
        "shortAdjustment",
        "goodAdjustment",
        "standardAdjustment",
        "layoffAdjustment",
    ),
    "rate": ("baseline", "maxAdjustment"),
    "best_time": (
        "featureKey",
        "countFeatureKey",
        "baseAdjustment",
        "minConfidence",
        "fullConfidenceCount",
        "defaultConfidence",
    ),
}


class ConfigError(ValueError):
    """A scoring configuration that cannot be used."""


@dataclass(frozen=True)
class ScoringConfig:
    model_version: str
    base: float
    low: float
    high: float
    features: Mapping[str, Mapping[str, Any]]

    def parameters(self, key: str, kind: str) -> Mapping[str, Any]:
        """The parameters of a feature, which must be of the wanted type."""
        found = self.features.get(key)
        if found is None or found["type"] != kind:
            raise ConfigError(f"{self.model_version}: {key} must be configured as {kind}")
        return found


def parse_config(raw: Mapping[str, Any]) -> ScoringConfig:
    """Check a configuration and give it its typed form."""
    problems: list[str] = []
    version = raw.get("modelVersion")
    if not isinstance(version, str) or not version:
        problems.append("modelVersion must be a text")
    bounds = raw.get("scoreRange") or {}
    if not all(_is_number(bounds.get(name)) for name in ("base", "min", "max")):
        problems.append("scoreRange needs the numbers base, min and max")
    else:
        if not bounds["min"] < bounds["max"]:
            problems.append("scoreRange.min must be below max")
        if not bounds["min"] <= bounds["base"] <= bounds["max"]:
            problems.append("scoreRange.base must lie between min and max")
    features = raw.get("features")
    if not isinstance(features, Mapping):
        problems.append("features must be an object")
        features = {}
    for key, feature in features.items():
        problems.extend(f"{key}: {problem}" for problem in _feature_problems(feature))
    if problems:
        raise ConfigError("; ".join(problems))
    return ScoringConfig(version, float(bounds["base"]), float(bounds["min"]), float(bounds["max"]), dict(features))


def _is_number(value: Any) -> bool:
    return isinstance(value, (int, float)) and not isinstance(value, bool)


def _feature_problems(feature: Any) -> list[str]:
    if not isinstance(feature, Mapping) or feature.get("type") not in _PARAMETERS:
        return ["unknown type"]
    kind = feature["type"]
    texts = {"featureKey", "countFeatureKey"}
    problems = []
    for name in _PARAMETERS[kind]:
        value = feature.get(name)
        if name == "positiveValue":
            valid = isinstance(value, bool)
        elif name in texts:
            valid = isinstance(value, str) and value != ""
        else:
            valid = _is_number(value)
        if not valid:
            problems.append(f"{name} is missing or of the wrong type")
    if problems:
        return problems
    if kind == "rate":
        if not 0 <= feature["baseline"] <= 1:
            problems.append("baseline must lie in 0..1")
        if feature["maxAdjustment"] < 0:
            problems.append("maxAdjustment must not be negative")
    elif kind == "interval_days":
        days = [feature[name] for name in ("shortThresholdDays", "goodMaxDays", "layoffThresholdDays")]
        if any(day != int(day) or day <= 0 for day in days):
            problems.append("thresholds must be positive whole days")
        if not days[0] <= days[1] < days[2]:
            problems.append("thresholds must satisfy short <= goodMax < layoff")
    elif kind == "best_time":
        for name in ("minConfidence", "defaultConfidence"):
            if not 0 <= feature[name] <= 1:
                problems.append(f"{name} must lie in 0..1")
        if feature["baseAdjustment"] < 0 or feature["fullConfidenceCount"] <= 0:
            problems.append("baseAdjustment must not be negative, fullConfidenceCount must be positive")
        if feature["minConfidence"] > feature["defaultConfidence"]:
            problems.append("minConfidence must not exceed defaultConfidence")
    return problems


BUILT_IN: dict[str, ScoringConfig] = {
    config.model_version: config for config in map(parse_config, (_RULE_BASED_V1, _RULE_BASED_V11))
}


def read_configs(spark: SparkSession, folder: str) -> dict[str, ScoringConfig]:
    """Configurations from the ``*.json`` files of a folder that the cluster shares, by model version."""
    files = spark.read.option("wholetext", True).option("pathGlobFilter", "*.json").text(folder)
    texts = sorted((row["path"], row["value"]) for row in files.select("_metadata.file_path", "value").toDF("path", "value").collect())
    parsed = [parse_config(json.loads(text)) for _, text in texts]
    return {config.model_version: config for config in parsed}


def get_config(version: str | None = None, known: Mapping[str, ScoringConfig] = BUILT_IN) -> ScoringConfig:
    wanted = DEFAULT_VERSION if version is None else version
    if wanted not in known:
        raise ConfigError(f"unknown model version {wanted}; known: {', '.join(known)}")
    return known[wanted]
