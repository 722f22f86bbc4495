"""Session settings the jobs rely on."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Instants are stored in UTC; dates are business dates and carry no zone.
ZONE = "UTC"

SETTINGS = {
    "spark.sql.session.timeZone": ZONE,
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}
# Bytes of a generated method that the JVM still compiles. A larger one is interpreted, so its operators run one by one.
METHOD_LIMIT = "8000"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cores: str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A single-process session for tests and for the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("furlong")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def use_utc(spark: SparkSession) -> SparkSession:
    """Pin the session zone; timestamps are compared and shown in UTC. Rules of many terms are to be compiled."""
    spark.conf.set("spark.sql.session.timeZone", ZONE)
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", METHOD_LIMIT)
    return spark


@contextmanager
def written_once(spark: SparkSession) -> Iterator[None]:
    """While tables are written that are read back: shuffle files go as soon as the table they made is complete."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
