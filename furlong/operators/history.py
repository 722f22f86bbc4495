"""Running statistics over the strict past of a key."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from furlong.operators.hotkeys import CHUNK, HOT_ROWS, PART, dealt, mark_chunks, mark_quantiles

_FAMILY = "_family"
_BEFORE_ALL = -(2**62)

_COMBINE = {"sum": F.sum, "max": F.max, "min": F.min}


@dataclass(frozen=True)
class Measure:
    """``into = kind(column)`` over the past rows; null inputs do not count, nor do rows where ``only`` does not hold."""

    into: str
    kind: str
    column: str
    only: str | None = None


def strict_past(
    rows: DataFrame,
    entity: str,
    order: str,
    families: Mapping[tuple[str, ...], Sequence[Measure]],
    hot: DataFrame | None = None,
    chunk_micros: int | None = None,
    upto: int = -1,
    chunk_rows: int = HOT_ROWS,
    together: bool = False,
) -> DataFrame:
    """Add each family's measures over rows of equal keys with a smaller ``order``.

    Rows with an equal ``order`` do not see each other, unless ``upto`` is 0. The
    rows are shuffled once, on the key columns that all families have in common,
    or not at all where ``together`` says that those of an entity are in one task.

    ``hot`` lists entities too large for one task. Their rows are windowed in
    chunks of about ``chunk_rows``, or per ``chunk_micros`` of ``order``; the
    totals of the earlier chunks enter each (key, chunk) as one additional row
    that sorts before all real ones, so no join is needed, and are dropped at the
    end. Rows of one instant that fill several chunks see only those totals, so
    they are dealt over parts.
    """
    if hot is None:
        return _windows(rows, order, families, extra=(), counted=None, upto=upto, together=together)
    if chunk_micros is None:
        marked = mark_quantiles(rows, entity, hot, F.col(order), chunk_rows, ties=upto < 0)
    else:
        marked = mark_chunks(rows, entity, hot, F.floor(F.col(order) / F.lit(chunk_micros)))
        marked = marked.withColumns({"_parts": F.when(F.col(CHUNK).isNotNull(), 1), PART: F.when(F.col(CHUNK).isNotNull(), 0)})
    carried = _carry_rows(marked.filter(F.col(CHUNK).isNotNull()), order, families)
    unioned = marked.withColumn(_FAMILY, F.lit(None).cast("int")).unionByName(carried, allowMissingColumns=True)

    def counted(family: int, column: Column) -> Column:
        return F.when(F.col(_FAMILY).isNull() | (F.col(_FAMILY) == family), column)

    windowed = _windows(unioned, order, families, extra=(CHUNK, PART), counted=counted, upto=upto)
    return windowed.filter(F.col(_FAMILY).isNull()).drop(_FAMILY, CHUNK, PART, "_parts")


def _windows(rows, order, families, extra, counted, upto, together=False):
    # One exchange on the columns all families share; every window then finds
    # its rows in place and only sorts.
    shared = [key for key in next(iter(families)) if all(key in keys for keys in families)]
    if not together:
        rows = dealt(rows, *shared, *extra)
    for number, (keys, measures) in enumerate(families.items()):
        past = (
            Window.partitionBy(*keys, *extra)
            .orderBy(order)
            .rangeBetween(Window.unboundedPreceding, upto)
        )
        columns = {}
        for measure in measures:
            value = F.col(measure.column)
            if measure.only is not None:
                value = F.when(F.col(measure.only), value)
            if counted is not None:
                value = counted(number, value)
            columns[measure.into] = _COMBINE[measure.kind](value).over(past)
        rows = rows.withColumns(columns)
    return rows


def _carry_rows(hot_rows, order, families):
    """One row per family, key and chunk holding the totals of the earlier chunks."""
    measured: dict[str, str] = {}
    for measures in families.values():
        for measure in measures:
            if measure.only is not None:
                raise ValueError(f"{measure.into}: totals of chunks count all rows")
            if measured.setdefault(measure.column, measure.kind) != measure.kind:
                raise ValueError(f"{measure.column} is combined in two ways")
    all_keys = list(dict.fromkeys(key for keys in families for key in keys))

    def key_in_family(key: str) -> Column:
        using = [number for number, keys in enumerate(families) if key in keys]
        return F.when(F.col(_FAMILY).isin(using), F.col(key)).alias(key)

    spread = hot_rows.withColumn(
        _FAMILY, F.explode(F.array(*[F.lit(number) for number in range(len(families))]))
    ).select(_FAMILY, CHUNK, "_parts", *[key_in_family(key) for key in all_keys], *measured)
    totals = spread.groupBy(_FAMILY, *all_keys, CHUNK).agg(
        F.max("_parts").alias("_parts"), *[_COMBINE[kind](F.col(column)).alias(column) for column, kind in measured.items()]
    )
    earlier = (
        Window.partitionBy(_FAMILY, *all_keys)
        .orderBy(CHUNK)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    summed = totals.select(
        _FAMILY,
        CHUNK,
        "_parts",
        *all_keys,
        F.lit(_BEFORE_ALL).cast("long").alias(order),
        *[_COMBINE[kind](F.col(column)).over(earlier).alias(column) for column, kind in measured.items()],
    )
    # Every part of a chunk gets the same row.
    return summed.withColumn(PART, F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))


def as_events(rows: DataFrame, known_at: str, asked_at: str, measures: Sequence[str]) -> DataFrame:
    """Two events per row: what it adds to the past becomes known at one time, and its own past is asked for at another.

    Ordered by ``at`` and windowed up to and including the own time, every row
    finds what is known when it asks, each row with a limit of its own, and no
    row is repeated per limit. A row with nothing to add (``known_at`` null)
    only asks. ``measures`` are null on the events that ask.
    """
    adds = F.struct(F.col(known_at).alias("at"), F.lit(False).alias("asks"))
    asks = F.struct(F.col(asked_at).alias("at"), F.lit(True).alias("asks"))
    spread = rows.withColumn("_event", F.explode(F.array(adds, asks)))
    spread = spread.withColumns({"at": F.col("_event.at"), "asks": F.col("_event.asks")}).drop("_event")
    spread = spread.filter(F.col("at").isNotNull())
    return spread.withColumns({name: F.when(~F.col("asks"), F.col(name)) for name in measures})


def near_copies(rows: DataFrame, keys: Sequence[str], value: str, width: int, into: str, adds: Column, hot: bool = False) -> DataFrame:
    """Copies of the rows under every value of their key within ``width`` of their own, in column ``into``.

    A window by ``into`` then sees all rows whose value is near its own. A row that
    adds nothing is not copied beyond itself. Only values that occur in the key
    serve as ``into``, so the copies are few where values are. The values of a
    hot key are gathered with map-side combine and joined back.
    """
    if hot:
        values = rows.groupBy(*keys).agg(F.collect_set(value).alias("_values"))
        known = rows.alias("l").join(values.alias("r"), [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys], "left")
        rows = known.select("l.*", "_values")
    else:
        rows = rows.withColumn("_values", F.collect_set(value).over(Window.partitionBy(*keys)))
    near = F.filter("_values", lambda other: F.abs(other - F.col(value)) <= width)
    own = F.array(F.col(value))
    return rows.withColumn(into, F.explode(F.when(adds & F.col(value).isNotNull(), near).otherwise(own))).drop("_values")
