"""Key, basic and SQL items as DataFrames.

Every frame built here has the key first. ``one_per_key`` frames carry one row per key, which is what the
result is joined with: both join sides are unique on the key, so no key can be hot there.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence
from functools import wraps

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..lenient import lenient_analysis
from ..sources import Catalog
from ..spec import Item, SpecError
from ..streaming.highwater import newer_than
from ..types import is_instant, spark_type, to_system
from .values import is_valid, single_value


def _leniently(build: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """Analyse the user's filters and column expressions so that bad casts give null."""

    @wraps(build)
    def wrapped(catalog: Catalog, *args, **kwargs) -> DataFrame:
        with lenient_analysis(catalog.spark):
            return build(catalog, *args, **kwargs)

    return wrapped


def source_column(df: DataFrame, name: str) -> tuple[Column, T.DataType]:
    """A column given by name, or by an SQL expression if no column has that name, and its type."""
    for field in df.schema.fields:
        if field.name.lower() == name.lower():
            return F.col(f"`{field.name}`"), field.dataType
    column = F.expr(name)
    return column, df.select(column.alias("value")).schema[0].dataType


def is_incremental(item: Item) -> bool:
    return item.extract == "incremental" and bool(item.increment_column)


def key_source(catalog: Catalog, key: Item) -> tuple[DataFrame, Column, T.DataType]:
    """Rows the key item reads, its key column and the type of that column, before filtering."""
    if key.key_kind == "sql":
        df = catalog.sql(str(key.content), key.params)
        return df, F.col(f"`{df.columns[0]}`"), df.schema[0].dataType
    df = catalog.table(key.table)
    return df, *source_column(df, str(key.content))


def row_condition(df: DataFrame, item: Item, watermark: dt.datetime | None) -> Column | None:
    """The item's own filter and its increment filter, or None when every row counts."""
    conditions = []
    if item.filter and (item.kind == "basic" or (item.kind == "key" and item.key_kind == "basic")):
        conditions.append(F.expr(item.filter))
    if is_incremental(item):
        conditions.append(newer_than(df, item.increment_column, watermark))
    if not conditions:
        return None
    return conditions[0] if len(conditions) == 1 else conditions[0] & conditions[1]


def typed_key(column: Column, dtype: T.DataType, key: Item) -> Column:
    """The key brought to the declared type of the key item, or left as it is."""
    return column if key.type is None else to_system(column, dtype, key.type)


def key_type(dtype: T.DataType, key: Item) -> T.DataType:
    return dtype if key.type is None else spark_type(key.type)


@_leniently
def key_spine(catalog: Catalog, key: Item, watermark: dt.datetime | None = None, mode: str = "strict") -> DataFrame:
    """Distinct valid keys of the run."""
    df, column, dtype = key_source(catalog, key)
    condition = row_condition(df, key, watermark)
    if condition is not None:
        df = df.where(condition)
    spine = df.select(typed_key(column, dtype, key).alias(key.name))
    return spine.where(is_valid(F.col(f"`{key.name}`"), key_type(dtype, key), mode)).distinct()


def _kept_pairs(pairs: DataFrame, key: Item, item: Item, dtype: T.DataType, mode: str) -> DataFrame:
    """Pairs with a key and a valid value."""
    return pairs.where(F.col(f"`{key.name}`").isNotNull() & is_valid(F.col(f"`{item.name}`"), dtype, mode))


@_leniently
def basic_pairs(
    catalog: Catalog, key: Item, item: Item, watermark: dt.datetime | None = None, mode: str = "strict"
) -> DataFrame:
    """``(key, value)`` rows of a basic item, several per key if the source has them."""
    df = catalog.table(item.table)
    condition = row_condition(df, item, watermark)
    if condition is not None:
        df = df.where(condition)
    value, dtype = source_column(df, str(item.content))
    pairs = df.select(
        typed_key(*source_column(df, item.key_column), key).alias(key.name), value.alias(item.name)
    )
    return _kept_pairs(pairs, key, item, dtype, mode)


def shared_scan(items: Sequence[Item]) -> list[list[Item]]:
    """Basic items grouped by source table and key column, in the order of their first member."""
    groups: dict[tuple[str, str], list[Item]] = {}
    for item in items:
        groups.setdefault(((item.table or "").lower(), (item.key_column or "").lower()), []).append(item)
    return list(groups.values())


@_leniently
def basic_frame(
    catalog: Catalog,
    key: Item,
    items: Sequence[Item],
    watermark: dt.datetime | None = None,
    mode: str = "strict",
    spine_flag: str | None = None,
) -> DataFrame:
    """One row per key for all basic items of one table and key column: one scan, one aggregation.

    The filter of an item decides which rows count for it, also for items that count or add up rows.
    With ``spine_flag`` the key item, which must read the same table and column, is answered by the same
    aggregation: the flag is true for keys it selects.
    """
    df = catalog.table(items[0].table)
    key_column, key_dtype = source_column(df, items[0].key_column)
    conditions, inputs, aggregates = [], {}, []
    for item in items:
        value, dtype = source_column(df, str(item.content))
        condition = row_condition(df, item, watermark)
        conditions.append(condition)
        kept = is_valid(value, dtype, mode)
        if condition is not None:
            kept = condition & kept
        # The number of values is that of the source's own, whatever type the item declares for it.
        typed = F.lit(1) if item.duplicates == "count" else to_system(value, dtype, item.system_type)
        inputs[item.name] = F.when(kept, typed)
        order = None
        if item.duplicates == "latest" and item.increment_column:
            inputs[f"{item.name}__order"] = source_column(df, item.increment_column)[0]
            order = F.col(f"`{item.name}__order`")
        aggregates.append(_chosen(item, F.col(f"`{item.name}`"), order))
    if spine_flag is not None:
        condition = row_condition(df, key, watermark)
        conditions.append(condition)
        inputs[spine_flag] = F.lit(True) if condition is None else F.coalesce(condition, F.lit(False))
        aggregates.append(F.max(F.col(spine_flag)).alias(spine_flag))
    if all(c is not None for c in conditions):
        wanted = conditions[0]
        for condition in conditions[1:]:
            wanted = wanted | condition
        df = df.where(wanted)
    rows = df.select(
        typed_key(key_column, key_dtype, key).alias(key.name), *[column.alias(name) for name, column in inputs.items()]
    )
    named_key = F.col(f"`{key.name}`")
    usable = named_key.isNotNull() if spine_flag is None else is_valid(named_key, key_type(key_dtype, key), mode)
    return rows.where(usable).groupBy(key.name).agg(*aggregates)


def sql_pairs(
    catalog: Catalog, key: Item, item: Item, watermark: dt.datetime | None = None, mode: str = "strict"
) -> DataFrame:
    """Rows of an SQL item: its first column is the key, the second the value.

    A third date or timestamp column orders the values of a key, and is kept as ``<item>__order``; an incremental item
    reads only its newer rows.
    """
    df = catalog.sql(str(item.content), item.params)
    types = [field.dataType for field in df.schema.fields]
    if len(types) < 2:
        raise SpecError(f"item {item.name}: the query must return a key and a value column")
    df = df.toDF(*[f"c{i}" for i in range(len(types))])
    ordered = len(types) > 2 and is_instant(types[2])
    if ordered and is_incremental(item):
        df = df.where(newer_than(df, "c2", watermark))
    columns = [typed_key(F.col("c0"), types[0], key).alias(key.name), F.col("c1").alias(item.name)]
    if ordered:
        columns.append(F.col("c2").alias(f"{item.name}__order"))
    return _kept_pairs(df.select(*columns), key, item, types[1], mode)


def declared_pairs(df: DataFrame, key: Item, item: Item, mode: str = "strict") -> DataFrame:
    """First two columns of a user frame, cast to the declared types of the key and the item."""
    types = [field.dataType for field in df.schema.fields]
    if len(types) < 2:
        raise SpecError(f"item {item.name}: the method must return a key and a value column")
    df = df.toDF(*[f"c{i}" for i in range(len(types))])
    pairs = df.select(
        typed_key(F.col("c0"), types[0], key).alias(key.name),
        to_system(F.col("c1"), types[1], item.system_type).alias(item.name),
    )
    return _kept_pairs(pairs, key, item, spark_type(item.system_type), mode)


def one_per_key(pairs: DataFrame, key: Item, item: Item) -> DataFrame:
    """Bring the value to the declared type and keep one value per key by the item's rule."""
    fields = {field.name: field.dataType for field in pairs.schema.fields}
    value = F.col(f"`{item.name}`")
    if item.duplicates != "count":
        value = to_system(value, fields[item.name], item.system_type)
    order = f"{item.name}__order"
    return pairs.groupBy(key.name).agg(_chosen(item, value, F.col(f"`{order}`") if order in fields else None))


def _chosen(item: Item, value: Column, order: Column | None) -> Column:
    """The value of a key under the item's rule, in the item's declared type."""
    if item.duplicates == "sum" and item.system_type not in ("int", "double"):
        raise SpecError(f"item {item.name}: only numbers can be added up")
    chosen = single_value(item.duplicates, value, order)
    if item.duplicates == "count":
        chosen = to_system(chosen, T.LongType(), item.system_type)
    elif item.duplicates == "sum":
        chosen = chosen.cast(spark_type(item.system_type))
    return chosen.alias(item.name)
