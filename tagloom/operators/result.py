"""The wide result table as pure functions from the prior result to the new one."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import blank, lenient_double, lenient_int
from ..spec import Item, SpecError
from ..types import epoch_millis, spark_type, to_system

# Default of every system type when an item declares none.
TYPE_DEFAULTS = {"int": 0, "double": 0.0, "string": ""}


def default_value(item: Item, system: str | None = None, storage: str = "table") -> Column:
    """Typed default of an item column: the declared one, else the zero of its type (``cell``: null)."""
    system = system or item.value_type
    target = spark_type(system)
    declared = item.default
    if declared is None or str(declared).strip() == "":
        zero = TYPE_DEFAULTS.get(system) if storage == "table" else None
        return F.lit(zero).cast(target)
    text = str(declared).strip()
    try:
        if system == "int":
            return F.lit(_whole(text)).cast(target)
        if system == "double":
            return F.lit(float(text)).cast(target)
        if system == "date":
            return F.lit(dt.datetime.fromisoformat(text).date()).cast(target)
    except (ValueError, ArithmeticError):
        raise SpecError(f"default {text} is no {system}") from None
    return F.lit(str(declared)).cast(target)


def _whole(text: str) -> int:
    """A whole number without going through floating point; digits after the point are cut off."""
    try:
        value = int(text)
    except ValueError:
        value = int(Decimal(text))
    if not -(1 << 63) <= value < 1 << 63:
        raise ValueError(text)
    return value


def default_problems(items: Iterable[Item], storage: str = "table") -> dict[str, SpecError]:
    """The items whose declared default is no value of their type, by name."""
    problems = {}
    for item in items:
        try:
            column_defaults([item], storage)
        except SpecError as error:
            problems[item.name] = error
    return problems


def column_defaults(items: Iterable[Item], storage: str = "table") -> dict[str, Column]:
    """Default of every result column the items own, raw columns of post-processed items included."""
    return {
        column: default_value(item, system, storage) for item in items for column, system in item.columns.items()
    }


def init_defaults(spine: DataFrame, items: Sequence[Item], storage: str = "table") -> DataFrame:
    """A new result: every key of the spine with every column at its default."""
    key = spine.columns[0]
    return spine.select(F.col(f"`{key}`"), *[d.alias(c) for c, d in column_defaults(items, storage).items()])


def new_keys(spine: DataFrame, prior: DataFrame) -> DataFrame:
    """Keys of the spine that the prior result does not hold."""
    key = spine.columns[0]
    return spine.select(key).join(prior.select(key), key, "left_anti")


def add_missing_columns(prior: DataFrame, items: Sequence[Item], storage: str = "table") -> DataFrame:
    """Add item columns the prior result lacks, at their defaults."""
    held = {c.lower() for c in prior.columns}
    missing = {c: d for c, d in column_defaults(items, storage).items() if c.lower() not in held}
    return prior.withColumns(missing) if missing else prior


def modify_column_types(prior: DataFrame, items: Sequence[Item]) -> DataFrame:
    """Cast columns the prior result shares with the items to their declared types."""
    fields = {f.name.lower(): f for f in prior.schema.fields}
    changes = {}
    for item in items:
        for column, system in item.columns.items():
            held = fields.get(column.lower())
            if held is not None and held.dataType != spark_type(system):
                changes[held.name] = to_system(F.col(f"`{held.name}`"), held.dataType, system)
    return prior.withColumns(changes) if changes else prior


def init_new_keys(prior: DataFrame, spine: DataFrame, items: Sequence[Item], storage: str = "table") -> DataFrame:
    """Prior result plus the new keys of the spine at column defaults; old rows are kept as they are."""
    merged = merge_keys(prior, spine)
    defaults = column_defaults(items, storage)
    return _fill_new_rows(merged, spine.columns[0], defaults).drop("__prior", "__spine")


def merge_keys(prior: DataFrame, spine: DataFrame) -> DataFrame:
    """Every key of either side with its prior row, and flags saying which side it came from.

    The keys alone are combined first; the wide rows join afterwards, so the result stays partitioned by key
    for the item joins that follow.
    """
    key = spine.columns[0]
    old = prior.select(F.col(f"`{key}`"), F.lit(True).alias("__prior"), F.lit(False).alias("__spine"))
    now = spine.select(F.col(f"`{key}`"), F.lit(False).alias("__prior"), F.lit(True).alias("__spine"))
    keys = old.unionByName(now).groupBy(key).agg(F.max("__prior").alias("__prior"), F.max("__spine").alias("__spine"))
    return keys.join(prior, key, "left")


def _fill_new_rows(merged: DataFrame, key: str, defaults: dict[str, Column]) -> DataFrame:
    by_name = {c.lower(): d for c, d in defaults.items()}
    filled = {
        c: F.when(F.col("__prior"), F.col(f"`{c}`")).otherwise(by_name[c.lower()])
        for c in merged.columns
        if c.lower() in by_name
    }
    return merged.withColumns(filled) if filled else merged


def backfill_blank(
    result: DataFrame, items: Sequence[Item], in_run: Column | None = None, storage: str = "cell"
) -> DataFrame:
    """Blank cells of the run's keys take their defaults; ``in_run`` limits the rows (all when None)."""
    changes = {}
    held = {c.lower(): c for c in result.columns}
    for column, default in column_defaults(items, storage).items():
        name = held.get(column.lower())
        if name is not None:
            empty = blank(F.col(f"`{name}`"))
            changes[name] = F.when(empty if in_run is None else in_run & empty, default).otherwise(F.col(f"`{name}`"))
    return result.withColumns(changes) if changes else result


def base_result(prior: DataFrame | None, spine: DataFrame, items: Sequence[Item], storage: str = "table") -> DataFrame:
    """The rows and columns a run starts from: the prior result brought up to the specification."""
    if prior is None:
        return init_defaults(spine, items, storage)
    prior = add_missing_columns(modify_column_types(prior, items), items, storage)
    merged = _fill_new_rows(merge_keys(prior, spine), spine.columns[0], column_defaults(items, storage))
    if storage == "cell":
        merged = backfill_blank(merged, items, F.col("__spine"), storage)
    return merged.drop("__prior", "__spine")


def update_existing(result: DataFrame, frame: DataFrame, reset: dict[str, Column] | None = None) -> DataFrame:
    """Write a one-row-per-key item frame into existing rows; keys the result lacks are ignored.

    Columns of ``reset`` fall back to the given default where the frame has no row, instead of keeping their
    old value.
    """
    key = frame.columns[0]
    renamed = frame.select(
        F.col(f"`{key}`"),
        *[F.col(f"`{c}`").alias(f"__new_{c}") for c in frame.columns[1:]],
        F.lit(True).alias("__hit"),
    )
    joined = result.join(renamed, key, "left")
    changes = {
        c: F.when(F.col("__hit"), F.col(f"`__new_{c}`")).otherwise((reset or {}).get(c, F.col(f"`{c}`")))
        for c in frame.columns[1:]
    }
    return joined.withColumns(changes).select(*[F.col(f"`{c}`") for c in result.columns])


def reload_column(result: DataFrame, item: Item, storage: str = "table") -> DataFrame:
    """Set the column of an item back to its default in all rows; the raw column is left alone."""
    return result.withColumn(item.name, default_value(item, None, storage))


def drop_column(result: DataFrame, column: str) -> DataFrame:
    return result.drop(column)


def truncate(result: DataFrame) -> DataFrame:
    """The same columns without rows."""
    return result.where(F.lit(False))


def encode_cells(df: DataFrame) -> DataFrame:
    """Every cell as text, dates as epoch milliseconds; binary cells stay as they are."""
    columns = []
    for field in df.schema.fields:
        col = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            col = epoch_millis(col).cast("string")
        elif not isinstance(field.dataType, T.BinaryType):
            col = to_system(col, field.dataType, "string")
        columns.append(col.alias(field.name))
    return df.select(*columns)


def decode_cells(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Read text cells as typed columns: the key first as text, blanks as 0, 0.0, '' or null."""
    columns = [F.col(f"`{df.columns[0]}`")]
    for name, system in types.items():
        col = F.col(f"`{name}`")
        if system == "int":
            col = lenient_int(col)
        elif system == "double":
            col = lenient_double(col)
        elif system == "date":
            col = F.timestamp_millis(F.trim(col).try_cast("bigint")).cast("date")
        elif system == "string":
            col = F.when(blank(col), F.lit("")).otherwise(col)
        columns.append(col.alias(name))
    return df.select(*columns)
