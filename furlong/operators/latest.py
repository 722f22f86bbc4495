"""Latest row per key.

``row_number() = 1`` lets the optimizer keep one row per key in every map task
before the shuffle, so a key with many versions does not gather in one task.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_row(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    ranked = rows.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col("_nth") == 1).drop("_nth")


def latest_snapshots(long: DataFrame, until: str | datetime | None = None) -> DataFrame:
    """Newest snapshot per (entry, feature) not after ``until``.

    A newer null hides an older value. Equal instants: the higher version wins.
    """
    rows = long if until is None else long.filter(F.col("as_of_at") <= F.lit(until).cast("timestamp"))
    return first_row(
        rows, ["entry_id", "feature_key"], [F.desc("as_of_at"), F.desc("feature_version")]
    )


def latest_feature_rows(wide: DataFrame, until: str | datetime | None = None) -> DataFrame:
    """The same on wide rows: a generation writes all features of an entry at
    once, so the newest wide row holds the newest snapshot of every feature."""
    rows = wide if until is None else wide.filter(F.col("as_of_at") <= F.lit(until).cast("timestamp"))
    return first_row(rows, ["entry_id"], [F.desc("as_of_at"), F.desc("feature_version")])


def latest_predictions(predictions: DataFrame) -> DataFrame:
    """Newest prediction per entry over all model versions."""
    return first_row(
        predictions, ["entry_id"], [F.desc("as_of_at"), F.desc("model_version"), F.asc("prediction_id")]
    )
