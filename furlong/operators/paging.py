"""Sorted pages and their totals."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def page(rows: DataFrame, order: Sequence[Column], number: int, size: int) -> DataFrame:
    """Page ``number`` (from 1). The order must end in a unique column."""
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)


def page_after(
    rows: DataFrame, order: Sequence[tuple[str, bool]], last: Mapping[str, object] | None, size: int
) -> DataFrame:
    """The page that follows the row ``last``; the first page without one.

    ``order`` lists columns without nulls, true for ascending, the final one unique.
    What lies before is not gathered and skipped but filtered: the bound on the
    first column is a filter of its own, which the scan takes to leave out files
    and row groups, so a page costs the same at any depth.
    """
    sorting = [F.asc(name) if up else F.desc(name) for name, up in order]
    if last is None:
        return rows.orderBy(*sorting).limit(size)
    beyond = F.lit(False)
    for name, up in reversed(order):
        column, bound = F.col(name), F.lit(last[name])
        further = column > bound if up else column < bound
        beyond = further | ((column == bound) & beyond)
    name, up = order[0]
    first = F.col(name) >= F.lit(last[name]) if up else F.col(name) <= F.lit(last[name])
    return rows.filter(first).filter(beyond).orderBy(*sorting).limit(size)


def page_totals(rows: DataFrame, size: int) -> DataFrame:
    """One row: how many rows there are and how many pages, at least one."""
    return rows.agg(F.count("*").alias("total_count")).withColumn(
        "total_pages", F.greatest(F.lit(1), F.ceil(F.col("total_count") / size)).cast("bigint")
    )


def all_of(conditions: Sequence[Column]) -> Column:
    """Conjunction; no condition keeps every row."""
    kept = F.lit(True)
    for condition in conditions:
        kept = kept & condition
    return kept
