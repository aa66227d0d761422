"""Method items: user code over the rows of a source table."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import Catalog
from ..sources.sqltext import constant
from ..spec import Item, SpecError
from ..streaming.highwater import newer_than
from .items import is_incremental

FrameMethod = Callable[[DataFrame, Mapping[str, Any]], DataFrame]
PandasMap = Callable[[pd.DataFrame], pd.DataFrame]
PandasRows = Iterator[pd.DataFrame]

# Summary rows that a task holds before they go into the shuffle.
BUFFER_ROWS = 100_000
# Parts in which the summaries of one key are merged first.
SALTS = 16


@dataclass(frozen=True)
class GroupedMethod:
    """User Python over all rows of a key, written so that no key has to fit into memory.

    ``partial(pdf, params)`` summarises any batch of source rows, one row per key; ``merge(pdf, params)``
    combines summary rows, again one row per key, and must not depend on how rows were batched. Both return the
    columns of ``schema``, whose first column is the key. ``value`` is the item value as an SQL expression or
    function of the summary columns. ``columns`` are the source columns that are read.
    """

    columns: tuple[str, ...]
    schema: str
    partial: Callable[[pd.DataFrame, Mapping[str, Any]], pd.DataFrame]
    merge: Callable[[pd.DataFrame, Mapping[str, Any]], pd.DataFrame]
    value: str | Callable[[], Column]

    def __call__(self, df: DataFrame, params: Mapping[str, Any]) -> DataFrame:
        """``(key, value)`` rows.

        A task merges its summaries in a buffer of at most ``BUFFER_ROWS`` rows, so a key goes into the shuffle once per
        flush of a task, however many rows it has. Summaries are merged per key and salt first, then per key: the last task
        of a key sees at most ``SALTS`` summaries of it. Rows without a key are left out.
        """
        partial, combine, schema = self.partial, self.merge, self.schema
        merge = lambda rows: combine(rows, params)
        summary = df.select(*self.columns).mapInPandas(_summaries(lambda rows: partial(rows, params), merge), schema)
        key = summary.columns[0]
        named = F.col(f"`{key}`")
        # The partition of the source task is the salt, which stays the same if the task runs again.
        salted = summary.withColumn("__salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
        first = _merged(salted, [named, F.col("__salt")], merge, schema)
        merged = _merged(first, [named], merge, schema)
        value = F.expr(self.value) if isinstance(self.value, str) else self.value()
        return merged.select(named, value.alias("value"))


def _summaries(summarise: PandasMap, merge: PandasMap, limit: int | None = None) -> Callable[[PandasRows], PandasRows]:
    """The task that reads source rows: one summary per key and flush."""

    def run(batches: PandasRows) -> PandasRows:
        room = BUFFER_ROWS if limit is None else limit
        held: list[pd.DataFrame] = []
        rows = 0
        for batch in batches:
            if not len(batch):
                continue
            part = summarise(batch)
            part = part[part.iloc[:, 0].notna()]
            held.append(part)
            rows += len(part)
            if rows > room:
                whole = merge(pd.concat(held, ignore_index=True))
                # If merging frees too little room, the keys are mostly different ones and go out.
                if len(whole) > room // 2:
                    yield whole
                    held, rows = [], 0
                else:
                    held, rows = [whole], len(whole)
        if rows:
            yield merge(pd.concat(held, ignore_index=True))

    return run


def _merged(summaries: DataFrame, groups: list[Column], merge: PandasMap, schema: str) -> DataFrame:
    """Merge the summaries of equal groups, whose first column is the key; a group is read in order and need not fit into memory."""
    extra = [c for c in summaries.columns if c == "__salt"]

    def run(batches: PandasRows) -> PandasRows:
        # Rows arrive sorted: only the last key of a batch can continue in the next one. A task with several salts of a
        # key merges them as well.
        carried = None
        for batch in batches:
            if not len(batch):
                continue
            batch = batch.drop(columns=extra)
            if carried is not None:
                batch = pd.concat([carried, batch], ignore_index=True)
            last = batch.iloc[-1, 0]
            done = merge(batch)
            open_key = done.iloc[:, 0] == last
            carried = done[open_key]
            if not open_key.all():
                yield done[~open_key]
        if carried is not None:
            yield carried

    return summaries.repartition(*groups).sortWithinPartitions(*groups).mapInPandas(run, schema)


_METHODS: dict[str, FrameMethod] = {}


def method(name: str) -> Callable[[FrameMethod], FrameMethod]:
    """Register ``fn(df, params) -> DataFrame[key, value]`` under a name that method items can use."""

    def register(fn: FrameMethod) -> FrameMethod:
        _METHODS[name] = fn
        return fn

    return register


def register_grouped(name: str, grouped: GroupedMethod) -> GroupedMethod:
    _METHODS[name] = grouped
    return grouped


def method_result(catalog: Catalog, item: Item, watermark: dt.datetime | None = None) -> DataFrame:
    """Run the user code of a method item over its (incrementally filtered) source."""
    fn = item.content if callable(item.content) else _METHODS.get(str(item.content))
    if fn is None:
        raise SpecError(f"item {item.name}: no method is registered as {item.content!r}")
    source = catalog.table(item.table)
    if is_incremental(item):
        source = source.where(newer_than(source, item.increment_column, watermark))
    frame = fn(source, {p.name: constant(p) for p in item.params})
    if frame is None:
        raise SpecError(f"item {item.name}: the method returned no frame")
    return frame
