"""What the training-data operators share: words, batches and staged tables."""

from __future__ import annotations

import ctypes
import gc
import pathlib
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from furlong.sources.files import delete_folders
from furlong.sources.store import shared_folder

# A word is a run without the six ASCII white-space characters; bytes.split() cuts at the same six.
GAP = r"[\x20\x09-\x0D]+"

# Rows that go to Python at once. Texts can be long, so the batches are small.
BATCH_ROWS = 1000
FILTER_BITS = 1 << 23


def words(text: str | None) -> list[bytes]:
    return text.encode().split() if text else []


def word_array(text: Column) -> Column:
    """The words of a text as an array; none for a null text."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), "")


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def staged(rows: DataFrame, name: str) -> DataFrame:
    """Write once to the shared folder and read back: cuts the lineage and survives lost executors."""
    return Scope().staged(rows, name)


class Scope:
    """The tables that one call stages for itself; other calls' tables are never touched."""

    def __init__(self) -> None:
        self.paths: list[str] = []

    def staged(self, rows: DataFrame, name: str) -> DataFrame:
        spark = rows.sparkSession
        path = f"{shared_folder(spark)}/furlong-llm/{name}-{uuid.uuid4().hex}"
        rows.write.parquet(path)
        self.paths.append(path)
        return spark.read.schema(rows.schema).parquet(path)

    def settled(self, rows: DataFrame, name: str) -> DataFrame:
        """Stages the rows and deletes the scope's earlier tables, which nothing needs any more."""
        used, self.paths = self.paths, []
        result = self.staged(rows, name)
        delete_folders(rows.sparkSession, used)
        return result


def maybe_in(rows: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """Adds ``__maybe``: false only where the row's whole number ``column`` is surely none of ``keys``.

    A bitmap of hashed keys, 1 MB at any size, is all that is broadcast. It keeps
    most texts that a join would drop out of its shuffle; the join itself stays
    exact. With very many keys it lets more rows through, never fewer.
    """
    place = F.pmod(F.xxhash64(F.col(column).cast("long")), F.lit(FILTER_BITS))
    bucket, bit = F.shiftright(place, 15), place.bitwiseAND(F.lit(32767).cast("long"))
    maps = keys.select(bucket.alias("__bucket"), bit.alias("__bit")).groupBy("__bucket")
    maps = maps.agg(F.bitmap_construct_agg("__bit").alias("__map"))
    placed = rows.withColumns({"__bucket": bucket, "__bit": bit}).join(F.broadcast(maps), "__bucket", "left")
    byte = F.conv(F.hex(F.substring(F.col("__map"), (F.col("__bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    on = F.call_function("shiftright", byte, (F.col("__bit") % 8).cast("int")).bitwiseAND(F.lit(1)) == 1
    return placed.select(*[rows[name] for name in rows.columns], F.coalesce(on, F.lit(False)).alias("__maybe"))


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once per application, wherever the driver found it."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = pathlib.Path(__file__).resolve().parents[1]
    archive = pathlib.Path(tempfile.mkdtemp(prefix="furlong-")) / "furlong.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)


def map_batches(rows: DataFrame, step: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema, keeps: tuple[str, ...] = ()) -> DataFrame:
    """``mapInArrow`` over batches of bounded size.

    Workers are used again by later tasks; what they remember for other steps than ``keeps`` is dropped.
    """
    ship(rows.sparkSession)
    rows.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))

    def run(batches):
        forget(keeps)
        yield from step(batches)
        if not keeps:
            hand_back()  # the worker may idle for long beside stages that need the memory

    return rows.mapInArrow(run, schema)


_remembered: dict[str, Callable] = {}


def remember(name: str, clear: Callable) -> None:
    """Names a table that a worker keeps between tasks, and how to drop it."""
    _remembered[name] = clear


def forget(but: tuple[str, ...]) -> None:
    """Drops the tables of other steps and hands the memory back, which the next stage's tables need."""
    used = [name for name in _remembered if name not in but]
    for name in used:
        _remembered.pop(name)()
    if used or not but:
        gc.collect()
        hand_back()


def hand_back() -> None:
    """Gives the system what was freed and is still held."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only where the C library has it
    if trim:
        trim(0)


class Bounded(dict):
    """A memo of a function of one key; forgets everything when it holds ``limit`` entries."""

    def __init__(self, compute: Callable, limit: int):
        super().__init__()
        self.compute, self.limit = compute, limit

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.clear()
        value = self[key] = self.compute(key)
        return value
