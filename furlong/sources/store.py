"""Tables as Parquet folders, versioned so that a job replaces several at once.

A job writes new folders beside the current ones and then adds one small
numbered pointer file. Readers follow the newest, so they see all of a job's
tables or none, and a failed or repeated job leaves the old version in place.

A table of rows that belong to an instant is kept in slices, one folder per
instant, each with a version of its own. A job rewrites the instants it touches
and names only them; the files of all others stay as they are, and a reader's
limit on the instant becomes a partition filter. Two jobs on different
instants of a table do not disturb each other. ``clean`` deletes what no
pointer names that a reader may still follow.
"""

from __future__ import annotations

import json
import re
import tempfile
import uuid
from collections.abc import Iterable, Mapping
from datetime import UTC, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from furlong import model
from furlong.operators.latest import first_row
from furlong.session import written_once
from furlong.sources import files

_POINTER = "CURRENT-"
_NEXT = ".next-"
_CODEC = "zstd"
_VERSION = re.compile(r"(version=)?[0-9a-f]{32}")

# What a pointer names per table: its folder, or per instant the version that holds its slice.
Named = str | dict[str, str]

SCHEMAS = {
    "races": model.RACES,
    "horses": model.HORSES,
    "jockeys": model.JOCKEYS,
    "trainers": model.TRAINERS,
    "entries": model.ENTRIES,
    "results": model.RESULTS,
}
HISTORIES = {
    "import_batches": model.IMPORT_BATCHES,
    "feature_batches": model.FEATURE_BATCHES,
    "prediction_runs": model.PREDICTION_RUNS,
}


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach, as named by ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder shared by the executors")
    folder = tempfile.mkdtemp(prefix="furlong-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def last_state(states: DataFrame) -> DataFrame:
    """The last state of every run: a finished one where there is one.

    The first column identifies the run.
    """
    return first_row(states, states.columns[:1], [F.desc_nulls_last("finished_at"), F.desc("status")])


def _slice(name: str, instant: str) -> str:
    return f"{name}@{instant}"


def _micros(at: datetime) -> int:
    """Microseconds since 1970; an instant without a zone is local, as Spark takes it."""
    return (at.astimezone(UTC) - datetime(1970, 1, 1, tzinfo=UTC)) // timedelta(microseconds=1)


def _flat(folders: Mapping[str, Named]) -> dict[str, str]:
    """Tables and slices with their version."""
    flat = {}
    for name, named in folders.items():
        flat.update({_slice(name, i): version for i, version in named.items()} if isinstance(named, dict) else {name: named})
    return flat


def _paths(name: str, named: Named) -> list[str]:
    if isinstance(named, str):
        return [named]
    return [f"{name}/version={version}/instant={instant}" for instant, version in named.items()]


class StaleTable(RuntimeError):
    """Another job replaced a table that this one is about to replace."""


class Store:
    """Current tables, run histories and import errors under one root folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")
        # Which version of a table, or of a slice of one, this job has read.
        self._seen: dict[str, str | None] = {}

    def _numbers(self) -> list[int]:
        names = files.names_in(self.spark, self.root)
        return sorted(int(name[len(_POINTER) :]) for name in names if name.startswith(_POINTER))

    def _content(self, number: int) -> dict[str, Named]:
        lines = self.spark.read.text(self._pointer_file(number)).collect()  # one short line
        return json.loads("".join(row["value"] for row in lines))

    def _pointer_file(self, number: int) -> str:
        return f"{self.root}/{_POINTER}{number:09d}"

    def _pointer(self) -> tuple[int, dict[str, Named]]:
        """Number and content of the newest pointer file."""
        numbers = self._numbers()
        return (numbers[-1], self._content(numbers[-1])) if numbers else (0, {})

    def _folders(self) -> dict[str, Named]:
        return self._pointer()[1]

    def has(self, table: str) -> bool:
        return table in self._folders()

    def table(self, name: str, schema: str | None = None) -> DataFrame:
        """The current version; an empty table where none was written yet."""
        folder = self._folders().get(name)
        if isinstance(folder, dict):
            return self.slices(name, schema)
        self._seen[name] = folder
        if folder is None:
            return self.spark.createDataFrame([], schema or SCHEMAS[name])
        return self.spark.read.parquet(f"{self.root}/{folder}")

    def instants(self, name: str) -> list[int]:
        """The instants, in microseconds, of which a table has a slice."""
        return sorted(map(int, self._folders().get(name, {})))

    def slices(
        self, name: str, schema: str | StructType | None = None, among: Iterable[int] | None = None,
        until: datetime | None = None,
    ) -> DataFrame:
        """A sliced table, or its slices of some instants (microseconds) or up to one.

        The limit is a filter on the partition column, so other slices are not read.
        """
        named = self._folders().get(name, {})
        chosen = None if among is None else {str(instant) for instant in among}
        for instant in named if chosen is None else chosen:
            self._seen[_slice(name, instant)] = named.get(instant)
        # Only folders within the limit are listed; the filter on the partition column says the same to the plan.
        last = None if until is None else _micros(until)
        wanted = {i: v for i, v in named.items() if (chosen is None or i in chosen) and (last is None or int(i) <= last)}
        if not wanted:
            return self.spark.createDataFrame([], schema or SCHEMAS[name])
        paths = [f"{self.root}/{name}/version={version}/instant={instant}" for instant, version in wanted.items()]
        reader = self.spark.read.option("basePath", f"{self.root}/{name}")
        if schema is not None:
            stored = schema if isinstance(schema, StructType) else self.spark.createDataFrame([], schema).schema
            reader = reader.schema(StructType([*stored, StructField("version", StringType()), StructField("instant", LongType())]))
        rows = reader.parquet(*paths)
        if chosen is not None:
            rows = rows.filter(F.col("instant").isin(sorted(map(int, chosen))))
        if last is not None:
            rows = rows.filter(F.col("instant") <= last)
        return rows.drop("version", "instant")

    def prepare_slices(self, name: str, rows: DataFrame, column: str = "as_of_at") -> dict[str, str]:
        """Write one version of the slices that the rows belong to; per instant the version."""
        version = uuid.uuid4().hex
        base = f"{self.root}/{name}/version={version}"
        sliced = rows.withColumn("instant", F.unix_micros(column))
        with written_once(self.spark):
            sliced.write.partitionBy("instant").option("compression", _CODEC).parquet(base)
        found = [part.removeprefix("instant=") for part in files.names_in(self.spark, base) if part.startswith("instant=")]
        return {instant: version for instant in found}

    def prepare(self, tables: Mapping[str, DataFrame]) -> dict[str, str]:
        """Write new versions that nobody reads yet."""
        folders = {}
        for name, rows in tables.items():
            folders[name] = f"{name}/{uuid.uuid4().hex}"
            with written_once(self.spark):
                rows.write.option("compression", _CODEC).parquet(f"{self.root}/{folders[name]}")
        return folders

    def prepared(self, folder: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{folder}")

    def replace(self, tables: Mapping[str, DataFrame]) -> None:
        """Write new versions of all given tables, then switch to them together."""
        self.switch(self.prepare(tables))

    def switch(self, prepared: Mapping[str, Named]) -> None:
        """Make prepared versions the current ones, all at once; of a sliced table, its prepared slices.

        Pointers are numbered and never overwritten: the new one is written aside
        and renamed to the next number, which fails if another job was quicker.
        Then its tables are taken over and the next number is tried. A table that
        the other job replaced since this one read it is a conflict.
        """
        while True:
            number, folders = self._pointer()
            current, wanted = _flat(folders), _flat(prepared)
            stale = [name for name in wanted if name in self._seen and current.get(name) != self._seen[name]]
            if stale:
                raise StaleTable(f"replaced by another job meanwhile: {', '.join(sorted(stale))}")
            merged = dict(folders)
            for name, named in prepared.items():
                merged[name] = {**merged.get(name, {}), **named} if isinstance(named, dict) else named
            fresh = f"{self.root}/{_NEXT}{uuid.uuid4().hex}"
            files.create(self.spark, fresh, json.dumps(merged))
            if files.rename_new(self.spark, fresh, self._pointer_file(number + 1)):
                self._seen.update(wanted)
                return
            files.delete_folders(self.spark, [fresh])

    def clean(self, before: datetime) -> list[str]:
        """Delete what no reader can need any more; returns the deleted folders, relative to the root.

        A pointer that was replaced at ``before`` or later may still be followed by a
        reader, so it stays with all it names, as does the current one. Folders that
        no such pointer names go if they were written before ``before``: younger
        ones may belong to a job that has not switched yet.
        """
        limit = int(before.timestamp() * 1000)
        numbers = self._numbers()
        replaced = {old: files.modified(self.spark, self._pointer_file(new)) for old, new in zip(numbers, numbers[1:])}
        gone = [number for number in numbers if replaced.get(number, limit) < limit]
        kept = [self._content(number) for number in numbers if number not in gone]
        live = {path for content in kept for name, named in content.items() for path in _paths(name, named)}
        deleted = []
        for table in files.names_in(self.spark, self.root):
            if table.startswith((_POINTER, _NEXT)):
                continue
            # Run histories and errors have plain files, which no pattern fits.
            for version in filter(_VERSION.fullmatch, files.names_in(self.spark, f"{self.root}/{table}")):
                folder = f"{table}/{version}"
                if folder in live or files.modified(self.spark, f"{self.root}/{folder}") >= limit:
                    continue
                used = [path for path in live if path.startswith(f"{folder}/")]
                if not used:
                    deleted.append(folder)
                    continue
                slices = [f"{folder}/{part}" for part in files.names_in(self.spark, f"{self.root}/{folder}") if part.startswith("instant=")]
                deleted += [path for path in slices if path not in used]
        # Pointers first: a reader that comes now must not find one whose tables are going.
        files.delete_folders(self.spark, [self._pointer_file(number) for number in gone])
        files.delete_folders(self.spark, [f"{self.root}/{folder}" for folder in deleted])
        left = [name for name in files.names_in(self.spark, self.root) if name.startswith(_NEXT)]
        files.delete_folders(self.spark, [f"{self.root}/{name}" for name in left if files.modified(self.spark, f"{self.root}/{name}") < limit])
        return sorted(deleted)

    def append_history(self, name: str, row: Mapping[str, object]) -> None:
        """Add one state of a run. Later states of the run replace earlier ones on reading."""
        schema = HISTORIES[name]
        one = self.spark.createDataFrame([], schema)
        values = [row.get(field.name) for field in one.schema.fields]
        self.spark.createDataFrame([values], one.schema).write.mode("append").parquet(f"{self.root}/{name}")

    def states(self, name: str) -> DataFrame:
        """All recorded states of all runs."""
        if not files.exists(self.spark, f"{self.root}/{name}"):
            return self.spark.createDataFrame([], HISTORIES[name])
        return self.spark.read.schema(HISTORIES[name]).parquet(f"{self.root}/{name}")

    def history(self, name: str) -> DataFrame:
        """One row per run, in its last state."""
        return last_state(self.states(name))

    def append_errors(self, errors: DataFrame) -> None:
        errors.write.mode("append").parquet(f"{self.root}/import_errors")

    def import_errors(self) -> DataFrame:
        if not files.exists(self.spark, f"{self.root}/import_errors"):
            return self.spark.createDataFrame([], model.IMPORT_ERRORS)
        return self.spark.read.schema(model.IMPORT_ERRORS).parquet(f"{self.root}/import_errors")

    def tables(self, hot: Mapping[str, DataFrame] | None = None) -> model.Tables:
        return model.Tables(**{name: self.table(name) for name in SCHEMAS}, hot=hot or {})
