"""Tables, column names, enumerations and keys of the racing data model."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

# --- fixed values: enumerations ----------------------------------------------
RACE_STATUS = ("scheduled", "confirmed", "cancelled")
ENTRY_STATUS = ("entered", "running", "scratched", "excluded")
RESULT_STATUS = ("preliminary", "confirmed", "corrected")
FINISH_STATUS = ("finished", "did_not_finish", "disqualified", "scratched")
HORSE_SEX = ("male", "female", "gelding")
RUN_MODE = ("dry_run", "import")
RUN_STATUS = ("running", "succeeded", "failed")
PREDICTION_TYPE = "rule_based"
# --- fixed values: page sizes of the reports ---------------------------------
RACE_PAGE_SIZE = 12
HISTORY_PAGE_SIZE = 20
# -----------------------------------------------------------------------------

# Column types of the stored tables. Instants are TIMESTAMP in a UTC session.
RACES = (
    "race_id string, race_date date, venue string, race_number smallint, name string, "
    "scheduled_start_at timestamp, surface string, distance_meters int, weather string, "
    "track_condition string, status string, available_at timestamp, observed_at timestamp, "
    "imported_at timestamp"
)
HORSES = (
    "horse_id string, name string, birth_date date, sex string, color string, "
    "available_at timestamp, observed_at timestamp, imported_at timestamp"
)
JOCKEYS = (
    "jockey_id string, name string, available_at timestamp, observed_at timestamp, "
    "imported_at timestamp"
)
TRAINERS = (
    "trainer_id string, name string, affiliation string, available_at timestamp, "
    "observed_at timestamp, imported_at timestamp"
)
ENTRIES = (
    "entry_id string, race_id string, horse_id string, jockey_id string, trainer_id string, "
    "frame_number smallint, horse_number smallint, assigned_weight decimal(4,1), "
    "body_weight int, body_weight_diff int, status string, available_at timestamp, "
    "observed_at timestamp, imported_at timestamp"
)
RESULTS = (
    "result_id string, entry_id string, finish_position smallint, finish_status string, "
    "finish_time_milliseconds int, margin string, final_odds decimal(8,1), popularity smallint, "
    "status string, available_at timestamp, observed_at timestamp, imported_at timestamp"
)
IMPORT_BATCHES = (
    "batch_id string, provider_code string, import_type string, mode string, status string, "
    "started_at timestamp, finished_at timestamp, total_rows bigint, inserted_rows bigint, "
    "updated_rows bigint, skipped_rows bigint, failed_rows bigint, source_dir string, "
    "summary array<struct<file:string,entity_type:string,read:bigint,valid:bigint,upserted:bigint>>"
)
IMPORT_ERRORS = (
    "batch_id string, file_name string, row_number bigint, entity_type string, source_id string, "
    "error_code string, error_message string, raw_row map<string,string>, created_at timestamp"
)
FEATURE_BATCHES = (
    "batch_id string, status string, mode string, as_of_at timestamp, feature_version int, "
    "total_count bigint, success_count bigint, failure_count bigint, inserted bigint, "
    "updated bigint, started_at timestamp, finished_at timestamp, failure_reason string"
)
PREDICTION_RUNS = (
    "run_id string, prediction_type string, model_version string, status string, mode string, "
    "as_of_at timestamp, total_count bigint, success_count bigint, failure_count bigint, "
    "inserted bigint, updated bigint, started_at timestamp, finished_at timestamp, failure_reason string"
)

# Columns that identify a stored row. A merge matches on these.
MERGE_KEYS = {
    "races": ("race_date", "venue", "race_number"),
    "horses": ("horse_id",),
    "jockeys": ("jockey_id",),
    "trainers": ("trainer_id",),
    "entries": ("race_id", "horse_id"),
    "results": ("entry_id",),
    "feature_definitions": ("feature_key", "version"),
    "feature_snapshots": ("feature_key", "feature_version", "entry_id", "as_of_at"),
    "feature_rows": ("feature_version", "entry_id", "as_of_at"),
    "predictions": ("prediction_type", "model_version", "entry_id", "as_of_at"),
    "evaluations": ("prediction_id",),
}

# Uniqueness the merged tables must have besides the merge key.
UNIQUE_KEYS = {
    "races": (("race_id",), ("race_date", "venue", "race_number")),
    "entries": (("entry_id",), ("race_id", "horse_id"), ("race_id", "horse_number")),
    "results": (("result_id",), ("entry_id",)),
}


@dataclass(frozen=True)
class Tables:
    """The current version of the racing tables.

    ``hot`` maps a key column of ``entries`` to the keys that hold too many rows
    for one task; a column without such keys is absent.
    """

    races: DataFrame
    horses: DataFrame
    jockeys: DataFrame
    trainers: DataFrame
    entries: DataFrame
    results: DataFrame
    hot: Mapping[str, DataFrame] = field(default_factory=dict)
