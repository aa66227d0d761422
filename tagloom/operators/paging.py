"""Ordered pages of a table and exact row positions."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import emptied, shared_folder, written
from .lookup import POINT_KEYS, lookup_join

# Pages that end within this many rows are a top-k; deeper ones are cut out by position.
SHALLOW_ROWS = 100_000
_PLACE_BYTES = 64  # of a row id with its position


def with_position(df: DataFrame, *order: Column, name: str = "position") -> DataFrame:
    """Add the 1-based position of every row in a total order, without sorting in one task.

    Rows are range-partitioned and sorted within partitions; a row's position is its place in its partition plus
    the sizes of the partitions before it. The order should be unique, so that equal rows cannot pile up.
    """
    shared_folder(df.sparkSession)
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    numbered = ranged.withColumn("__row", F.monotonically_increasing_id()).checkpoint()
    # monotonically_increasing_id keeps the partition in its upper bits and the place in the lower 33.
    part = F.shiftright("__row", 33)
    sizes = numbered.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__rows"))
    # One row per partition, so this window and the broadcast are bounded by the partition count.
    before = sizes.select(
        "__part", (F.sum("__rows").over(Window.orderBy("__part")) - F.col("__rows")).alias("__before")
    )
    place = F.col("__row").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        numbered.withColumn("__part", part)
        .join(F.broadcast(before), "__part")
        .withColumn(name, F.col("__before") + place + 1)
        .drop("__row", "__part", "__before")
    )


def with_position_in_group(df: DataFrame, group: str, *order: Column, name: str = "position") -> DataFrame:
    """1-based position of every row within its group; a group of any size is spread over many tasks."""
    placed = with_position(df, F.col(f"`{group}`"), *order, name="__at")
    first = placed.groupBy(group).agg(F.min("__at").alias("__first"))
    return (
        lookup_join(placed, group, first, "inner")
        .withColumn(name, F.col("__at") - F.col("__first") + 1)
        .drop("__at", "__first")
    )


def page(df: DataFrame, first: int, size: int, *order: Column) -> DataFrame:
    """Rows ``first`` to ``first + size`` of an order; end the order with a unique column, or pages may overlap."""
    if first + size <= SHALLOW_ROWS:
        return df.orderBy(*order).offset(first).limit(size)
    placed = with_position(df, *order, name="__position")
    wanted = placed.where((F.col("__position") > first) & (F.col("__position") <= first + size))
    return wanted.orderBy("__position").drop("__position")


class OrderedIndex:
    """The row ids of a table in a total order, written once; pages of any depth are cut from it without sorting again.

    Only the order columns and the ids are sorted, never the wide rows. ``key`` must be unique; end the order with it. The
    index answers for the rows at the time it was built, and ``release`` frees it.
    """

    def __init__(self, df: DataFrame, key: str, columns: Sequence[str], *order: Column):
        """``order`` reads ``columns`` and the key only."""
        self.df, self.key = df, key
        self._paths: list[str] = []
        narrow = df.select(*(F.col(f"`{c}`") for c in dict.fromkeys((key, *columns))))
        placed = with_position(narrow, *order, name="__position")
        # The files hold consecutive positions, so a page reads the row groups it lies in.
        self._index = written(
            placed.select(F.col("__position").alias("position"), F.col(f"`{key}`").alias("key")), "ordered-index", self._paths
        )

    def count(self) -> int:
        return self._index.count()

    def page(self, first: int, size: int) -> DataFrame:
        """Rows ``first`` to ``first + size`` in order."""
        return self._rows(self._index.where((F.col("position") > first) & (F.col("position") <= first + size)), size)

    def page_after(self, key: Any, size: int) -> DataFrame:
        """The rows behind the one with this key; none if no row has it."""
        at = self._index.where(F.col("key") == F.lit(key)).select("position").first()
        return self.page(at["position"], size) if at else self.df.where(F.lit(False))

    def release(self) -> None:
        while self._paths:
            emptied(self.df.sparkSession, self._paths.pop())

    def _rows(self, part: DataFrame, size: int) -> DataFrame:
        rows = self.df
        if size <= POINT_KEYS:
            # The ids of a short page are a filter that reaches the scan.
            rows = rows.where(F.col(f"`{self.key}`").isin(*(r["key"] for r in part.collect())))
        places = part.select(F.col("key").alias(self.key), F.col("position").alias("__position"))
        wide = lookup_join(rows, self.key, places, "inner", size=_PLACE_BYTES * size)
        return wide.orderBy("__position").limit(size).select(*(F.col(f"`{c}`") for c in self.df.columns))


def grid_page(df: DataFrame, first: int, size: int, sort: Column | None, *default_sort: Column) -> DataFrame:
    """A page by the user's sort, with the default sort as tie-breaker."""
    return page(df, first, size, *([sort] if sort is not None else []), *default_sort)


def table_page(
    df: DataFrame, columns: Sequence[str], condition: str | None, first: int, size: int, *order: Column
) -> DataFrame:
    """Columns of the rows that meet a condition, cut to a page; all rows when ``size`` is not positive."""
    rows = df.where(condition) if condition else df
    if size <= 0:
        return rows.select(*columns)
    return page(rows.select(*columns), first, size, *order)


def key_page(df: DataFrame, key: str, first: int, size: int) -> DataFrame:
    """A page of row keys in byte order of their text."""
    return page(df.select(F.col(f"`{key}`").cast("string").alias("row_key")), first, size, F.col("row_key"))


def key_page_from(df: DataFrame, key: str, start: Any, size: int) -> DataFrame:
    """The next ``size`` row keys from ``start`` on: continues a scan at any depth with one filtered top-k."""
    keys = df.select(F.col(f"`{key}`").cast("string").alias("row_key"))
    return keys.where(F.col("row_key") >= str(start)).orderBy("row_key").limit(size)


def count_where(df: DataFrame, condition: str | None = None) -> DataFrame:
    """One row with the number of rows that meet a condition."""
    return (df.where(condition) if condition else df).agg(F.count(F.lit(1)).alias("n"))
