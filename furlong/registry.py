"""The features, their order, types and stored identity."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

# --- fixed values: feature key, display name, value type, priority, definition id -
FEATURES = (
    ("horse.days_since_last_race", "前走からの日数", "number", "P0", "81000000-0000-4000-8000-000000000001"),
    ("horse.has_past_race", "過去出走あり", "boolean", "P0", "81000000-0000-4000-8000-000000000002"),
    ("horse.is_after_layoff_8w", "8週以上の休み明け", "boolean", "P0", "81000000-0000-4000-8000-000000000003"),
    ("horse.surface_starts", "同馬場区分出走数", "number", "P0", "81000000-0000-4000-8000-000000000004"),
    ("horse.surface_top3_rate", "同馬場区分3着内率", "number", "P0", "81000000-0000-4000-8000-000000000005"),
    ("horse.distance_starts", "同距離出走数", "number", "P0", "81000000-0000-4000-8000-000000000006"),
    ("horse.distance_top3_rate", "同距離3着内率", "number", "P0", "81000000-0000-4000-8000-000000000007"),
    ("horse.best_time_same_surface_distance_ms", "同馬場区分・同距離の持ち時計", "number", "P1", "81000000-0000-4000-8000-000000000101"),
    ("horse.best_time_same_surface_distance_count", "同馬場区分・同距離の時計対象数", "number", "P1", "81000000-0000-4000-8000-000000000102"),
    ("horse.track_condition_starts", "同馬場状態出走数", "number", "P1", "81000000-0000-4000-8000-000000000103"),
    ("horse.track_condition_top3_rate", "同馬場状態3着内率", "number", "P1", "81000000-0000-4000-8000-000000000104"),
    ("horse.course_starts", "同コース出走数", "number", "P1", "81000000-0000-4000-8000-000000000105"),
    ("horse.course_top3_rate", "同コース3着内率", "number", "P1", "81000000-0000-4000-8000-000000000106"),
    ("jockey.venue_starts", "騎手・同競馬場出走数", "number", "P2", "81000000-0000-4000-8000-000000000201"),
    ("jockey.venue_wins", "騎手・同競馬場勝利数", "number", "P2", "81000000-0000-4000-8000-000000000202"),
    ("jockey.venue_top3", "騎手・同競馬場3着内数", "number", "P2", "81000000-0000-4000-8000-000000000203"),
    ("jockey.venue_win_rate", "騎手・同競馬場勝率", "number", "P2", "81000000-0000-4000-8000-000000000204"),
    ("jockey.venue_top3_rate", "騎手・同競馬場3着内率", "number", "P2", "81000000-0000-4000-8000-000000000205"),
    ("jockey.distance_starts", "騎手・同距離出走数", "number", "P2", "81000000-0000-4000-8000-000000000206"),
    ("jockey.distance_wins", "騎手・同距離勝利数", "number", "P2", "81000000-0000-4000-8000-000000000207"),
    ("jockey.distance_top3", "騎手・同距離3着内数", "number", "P2", "81000000-0000-4000-8000-000000000208"),
    ("jockey.distance_win_rate", "騎手・同距離勝率", "number", "P2", "81000000-0000-4000-8000-000000000209"),
    ("jockey.distance_top3_rate", "騎手・同距離3着内率", "number", "P2", "81000000-0000-4000-8000-000000000210"),
)
FEATURE_VERSION = 1
# -----------------------------------------------------------------------------

# What each feature says and how it is worked out. "Visible" means that start and
# result were known at the instant; "earlier" means before the race's own start.
TEXTS = {
    "horse.days_since_last_race": (
        "Days between the horse's latest earlier start and this race.",
        "race day minus the day of the newest visible earlier start; null without one",
    ),
    "horse.has_past_race": (
        "Whether an earlier start of the horse is visible.",
        "number of visible earlier starts > 0",
    ),
    "horse.is_after_layoff_8w": (
        "Whether the horse returns after eight weeks or more.",
        "days_since_last_race >= 56; null without an earlier start",
    ),
    "horse.surface_starts": (
        "Earlier starts on the same kind of surface.",
        "count of visible earlier starts with equal surface kind",
    ),
    "horse.surface_top3_rate": (
        "Share of those starts that ended in the first three.",
        "finishes 1 to 3 / surface_starts; null when that is 0",
    ),
    "horse.distance_starts": (
        "Earlier starts over the same distance.",
        "count of visible earlier starts with equal distance",
    ),
    "horse.distance_top3_rate": (
        "Share of those starts that ended in the first three.",
        "finishes 1 to 3 / distance_starts; null when that is 0",
    ),
    "horse.best_time_same_surface_distance_ms": (
        "Best finishing time on this kind of surface and distance.",
        "least time of finished visible earlier starts with equal surface kind and distance",
    ),
    "horse.best_time_same_surface_distance_count": (
        "How many times that best is taken from.",
        "count of such starts that have a time",
    ),
    "horse.track_condition_starts": (
        "Earlier starts on the same track condition.",
        "count of visible earlier starts with equal condition",
    ),
    "horse.track_condition_top3_rate": (
        "Share of those starts that ended in the first three.",
        "finishes 1 to 3 / track_condition_starts; null when that is 0",
    ),
    "horse.course_starts": (
        "Earlier starts on the same course.",
        "count of visible earlier starts with equal venue, surface kind and distance",
    ),
    "horse.course_top3_rate": (
        "Share of those starts that ended in the first three.",
        "finishes 1 to 3 / course_starts; null when that is 0",
    ),
    "jockey.venue_starts": (
        "Earlier rides of the jockey at this venue.",
        "count of visible earlier rides with equal venue",
    ),
    "jockey.venue_wins": (
        "How many of them were won.",
        "rides at the venue that finished first",
    ),
    "jockey.venue_top3": (
        "How many of them ended in the first three.",
        "rides at the venue that finished 1 to 3",
    ),
    "jockey.venue_win_rate": (
        "Share of rides at this venue that were won.",
        "venue_wins / venue_starts; null when that is 0",
    ),
    "jockey.venue_top3_rate": (
        "Share of rides at this venue in the first three.",
        "venue_top3 / venue_starts; null when that is 0",
    ),
    "jockey.distance_starts": (
        "Earlier rides of the jockey over this distance.",
        "count of visible earlier rides with equal distance",
    ),
    "jockey.distance_wins": (
        "How many of them were won.",
        "rides over the distance that finished first",
    ),
    "jockey.distance_top3": (
        "How many of them ended in the first three.",
        "rides over the distance that finished 1 to 3",
    ),
    "jockey.distance_win_rate": (
        "Share of rides over this distance that were won.",
        "distance_wins / distance_starts; null when that is 0",
    ),
    "jockey.distance_top3_rate": (
        "Share of rides over this distance in the first three.",
        "distance_top3 / distance_starts; null when that is 0",
    ),
}


@dataclass(frozen=True)
class Feature:
    key: str
    name: str
    value_type: str
    priority: str
    definition_id: str
    description: str
    calculation: str

    @property
    def column(self) -> str:
        """The key as a column name of the wide table."""
        return self.key.replace(".", "_")

    @property
    def is_number(self) -> bool:
        return self.value_type == "number"


ALL: tuple[Feature, ...] = tuple(Feature(*fixed, *TEXTS[fixed[0]]) for fixed in FEATURES)
BY_KEY: dict[str, Feature] = {feature.key: feature for feature in ALL}
P0_KEYS: tuple[str, ...] = tuple(feature.key for feature in ALL if feature.priority == "P0")


def definitions(spark: SparkSession) -> DataFrame:
    """The registry as rows of ``feature_definitions``."""
    return spark.createDataFrame(
        [
            (f.definition_id, f.key, f.name, f.description, "race_entry", f.value_type, FEATURE_VERSION, f.priority, f.calculation, True)
            for f in ALL
        ],
        "feature_definition_id string, feature_key string, name string, description string, entity_type string, "
        "value_type string, version int, priority string, calculation_logic string, is_active boolean",
    )
