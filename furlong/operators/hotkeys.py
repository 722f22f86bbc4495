"""Keys with more rows than one task should hold, and how to split them.

A window over a key puts all rows of the key into one task. For a hot key the
rows are cut into *chunks* in their order; the window runs per (key, chunk), and
what earlier chunks contribute is aggregated with map-side combine and carried
in. A key that is not hot has no chunk, so the bulk of the data pays nothing
but one comparison.

Chunk borders are quantiles of the key's own rows, from a mergeable sketch, so
chunks hold about ``HOT_ROWS`` rows however the rows lie: over years, or all on
one day. A value that fills several quantiles alone is a chunk of its own.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Rows of one key above which it is split. A table of n rows has at most
# n / HOT_ROWS hot keys, which bounds the broadcast in ``mark_chunks``: 10^11
# rows give at most 100,000 keys.
HOT_ROWS = 1_000_000

CHUNK = "_chunk"
# Rows of a chunk that all have one value, dealt over several tasks.
PART = "_part"
# Most chunks of one key; the sketch resolves a hundred times finer.
MOST_CHUNKS = 1024
_ACCURACY = 100_000


def hot_keys(rows: DataFrame, column: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The keys of ``column`` with more than ``hot_rows`` rows."""
    return (
        rows.filter(F.col(column).isNotNull())
        .groupBy(column)
        .agg(F.count("*").alias("_rows"))
        .filter(F.col("_rows") > hot_rows)
        .select(column)
    )


def find_hot(rows: DataFrame, columns: Sequence[str], hot_rows: int = HOT_ROWS) -> dict[str, DataFrame]:
    """Hot-key frames for those columns that have a hot key at all.

    One counting job decides, reading only the key columns and combining in the
    map tasks; what reaches the driver is at most one name per column. Plans for
    data without hot keys stay plain windows.
    """
    crowded = [hot_keys(rows, c, hot_rows).limit(1).select(F.lit(c).alias("name")) for c in columns]
    names = {row["name"] for row in reduce(DataFrame.unionByName, crowded).collect()}
    return {c: hot_keys(rows, c, hot_rows) for c in columns if c in names}


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows of equal keys in one task, in all shuffle partitions.

    A number that is given is kept where small partitions would be merged by what
    they take on disk. Windows that sort wide rows need many times that in memory.
    """
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def mark_chunks(rows: DataFrame, column: str, hot: DataFrame, coarse: Column) -> DataFrame:
    """Add the chunk: ``coarse`` for rows of a hot key, null for all others.

    ``hot`` is broadcast; its size is bounded by the row count over HOT_ROWS.
    """
    flagged = hot.select(column, F.lit(True).alias("_hot"))
    return (
        rows.join(F.broadcast(flagged), column, "left")
        .withColumn(CHUNK, F.when(F.col("_hot"), coarse))
        .drop("_hot")
    )


def chunk_borders(
    rows: DataFrame, column: str, hot: DataFrame, value: Column, chunk_rows: int = HOT_ROWS, most: int = MOST_CHUNKS
) -> DataFrame:
    """Per hot key: ascending ``_borders`` of its chunks, repeated where one value fills several."""
    crowded = rows.withColumn("_value", value).join(F.broadcast(hot.select(column)), column, "left_semi")
    quantiles = [step / most for step in range(1, most)]
    found = crowded.groupBy(column).agg(
        F.count("*").alias("_rows"), F.percentile_approx("_value", quantiles, _ACCURACY).alias("_all")
    )
    chunks = F.least(F.lit(most), F.greatest(F.lit(2), F.ceil(F.col("_rows") / chunk_rows).cast("int")))
    steps = F.sequence(F.lit(1), chunks - 1)
    borders = F.transform(steps, lambda step: F.element_at("_all", F.ceil(step * most / chunks).cast("int")))
    return found.filter(F.col("_all").isNotNull()).select(column, borders.alias("_borders"))


def _place(borders: Column, value: Column, including: bool) -> Column:
    """How many of the ascending borders lie below the value (or at it), by halving."""

    def below(at: Column) -> Column:
        border = F.get(borders, at - 1)
        return border <= value if including else border < value

    powers = F.array(*[F.lit(1 << bit) for bit in reversed(range(MOST_CHUNKS.bit_length()))])
    return F.aggregate(powers, F.lit(0), lambda low, step: F.when(below(low + step), low + step).otherwise(low))


def mark_quantiles(
    rows: DataFrame, column: str, hot: DataFrame, value: Column, chunk_rows: int = HOT_ROWS, ties: bool = False
) -> DataFrame:
    """Add chunk and part: null for rows of keys that are not hot.

    Chunks ascend with ``value``; equal values share one. A border value has a
    chunk to itself, and with ``ties`` its rows are dealt over as many parts as
    quantiles it fills (``_parts``). The broadcast holds one number per ``chunk_rows`` rows.
    """
    borders = chunk_borders(rows, column, hot, value, chunk_rows)
    marked = rows.withColumn("_value", value).join(F.broadcast(borders), column, "left")
    low, high = (_place(F.col("_borders"), F.col("_value"), including) for including in (False, True))
    marked = marked.withColumns({"_low": low, "_high": high})
    filled = F.greatest(F.col("_high") - F.col("_low"), F.lit(1)) if ties else F.lit(1)
    chunk = 2 * F.col("_low") + (F.col("_high") > F.col("_low")).cast("int")
    known = F.col("_borders").isNotNull()
    marked = marked.withColumns({CHUNK: F.when(known, chunk), "_parts": F.when(known, filled)})
    # Which part a row goes to has no influence on its result.
    part = F.pmod(F.monotonically_increasing_id(), F.col("_parts")).cast("int")
    return marked.withColumn(PART, part).drop("_value", "_borders", "_low", "_high")


def number_rows(
    rows: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    into: str,
    hot: DataFrame | None = None,
    coarse: Column | None = None,
    value: Column | None = None,
    chunk_rows: int = HOT_ROWS,
) -> DataFrame:
    """``row_number`` of every row inside ``keys``.

    ``hot`` holds hot values of ``keys[0]``. Their rows are cut at quantiles of
    ``value``, a number that ascends in the given order, or else by ``coarse``,
    anything that does.
    """
    if hot is None:
        return rows.withColumn(into, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    if value is None:
        marked = mark_chunks(rows, keys[0], hot, coarse)
    else:
        marked = mark_quantiles(rows, keys[0], hot, value, chunk_rows).drop(PART, "_parts")
    inside = F.row_number().over(Window.partitionBy(*keys, CHUNK).orderBy(*order))
    numbered = marked.withColumn("_inside", inside)
    # Chunk sizes of hot keys only: one row per (key, chunk), summed in order.
    sizes = marked.filter(F.col(CHUNK).isNotNull()).groupBy(*keys, CHUNK).agg(F.count("*").alias("_size"))
    before = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    carry = sizes.select(*keys, CHUNK, F.sum("_size").over(before).alias("_before"))
    joined = numbered.join(carry, [*keys, CHUNK], "left")
    return joined.withColumn(
        into, (F.col("_inside") + F.coalesce(F.col("_before"), F.lit(0))).cast("int")
    ).drop("_inside", "_before", CHUNK)
