"""Code dictionaries and point reads."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources import Catalog
from ..spec import SpecError

# Prefixes of a code name that say which catalog holds the dictionary.
DATASOURCE_PREFIX = "datasource:"
LOCAL_PREFIX = "local:"

# A lookup side is broadcast only if it is at most this many bytes of text and numbers.
BROADCAST_BYTES = 64 << 20
HEAVY_VALUES = 10_000
SALTS = 64
POINT_KEYS = 1_000


def code_map(main: DataFrame, items: DataFrame, codename: str) -> DataFrame:
    """``(itemvalue, itemtext)`` of the dictionaries with this name, one text per value."""
    wanted = main.where(F.col("codename") == codename).select("codeid").distinct()
    return (
        lookup_join(items, "codeid", wanted, "left_semi")
        .where(F.col("itemvalue").isNotNull())
        .groupBy(F.col("itemvalue").cast("string").alias("itemvalue"))
        .agg(F.max("itemtext").alias("itemtext"))
    )


def named_code_map(codename: str, local: Catalog, datasource: Catalog | None = None) -> DataFrame:
    """Dictionary of a prefixed code name: ``datasource:`` reads the tag's own source, otherwise the local one."""
    catalog = local
    if codename.startswith(DATASOURCE_PREFIX):
        if datasource is None:
            raise SpecError(f"code {codename}: no data source catalog given")
        catalog, codename = datasource, codename[len(DATASOURCE_PREFIX):]
    elif codename.startswith(LOCAL_PREFIX):
        codename = codename[len(LOCAL_PREFIX):]
    return code_map(catalog.table("code_main"), catalog.table("code_items"), codename)


def measured_bytes(lookup: DataFrame) -> int:
    """Size of the rows of a lookup side: eight bytes per column and what text and nested columns hold."""
    row = F.lit(8 * (len(lookup.columns) + 2))
    for field in lookup.schema.fields:
        if field.dataType.typeName() not in ("integer", "long", "double", "boolean", "date", "timestamp"):
            row = row + F.coalesce(F.octet_length(F.to_json(F.struct(F.col(f"`{field.name}`")))), F.lit(0))
    return lookup.agg(F.coalesce(F.sum(row), F.lit(0)).alias("bytes")).first()["bytes"]


def lookup_join(
    df: DataFrame,
    on: str,
    lookup: DataFrame,
    how: str = "left",
    *,
    size: int | None = None,
    limit: int = BROADCAST_BYTES,
    heavy_values: int = HEAVY_VALUES,
    salts: int = SALTS,
) -> DataFrame:
    """Join rows with a lookup that has at most one row per value of ``on``; ``left``, ``inner`` or ``left_semi``.

    A lookup of at most ``limit`` bytes (``size`` if already measured) is broadcast. A larger one is joined in one
    shuffle by value and salt. One pass over the column finds the ``heavy_values`` most frequent values; their rows get a
    salt from a hash of the row and its task, and their lookup rows are repeated for each, so a value that holds a third of
    all rows is spread over ``salts`` tasks. Rows without a value match nothing and are spread over all tasks.
    """
    if (measured_bytes(lookup) if size is None else size) <= limit:
        return df.join(F.broadcast(lookup), on, how)
    value = F.col(f"`{on}`")
    # Hashes of values are few and small, whatever the values are; two values with one hash are both salted.
    name = F.xxhash64(value)
    counts = df.where(value.isNotNull()).groupBy(name.alias("h")).agg(F.count(F.lit(1)).alias("n"))
    frequent = counts.orderBy(F.col("n").desc(), "h").limit(heavy_values).where(F.col("n") > salts).collect()
    heavy = name.isin(*(r.h for r in frequent)) if frequent else F.lit(False)
    hashable = [F.col(f"`{f.name}`") for f in df.schema.fields if "map<" not in f.dataType.simpleString()]
    # Exact copies of a row differ by the task that reads them, which has the same number if it runs again.
    row = F.xxhash64(*hashable, F.spark_partition_id())
    salt = F.when(value.isNull(), row).when(heavy, F.pmod(row, F.lit(salts))).otherwise(F.lit(0).cast("bigint"))
    every = F.sequence(F.lit(0).cast("bigint"), F.when(heavy, F.lit(salts - 1)).otherwise(0).cast("bigint"))
    repeated = lookup.where(value.isNotNull()).withColumn("__salt", F.explode(every))
    return df.withColumn("__salt", salt).join(repeated, [on, "__salt"], how).drop("__salt")


def decode(df: DataFrame, column: str, codes: DataFrame, alias: str | None = None) -> DataFrame:
    """Replace code values of a column by their texts; values the dictionary lacks stay as they are."""
    name = alias or column
    value = F.col(f"`{column}`").cast("string")
    rows = df.withColumn("__code", value)
    joined = lookup_join(rows, "__code", codes.select(F.col("itemvalue").alias("__code"), F.col("itemtext").alias("__text")))
    text: Column = F.coalesce(F.col("__text"), F.col("__code"))
    return joined.withColumn(name, text).drop("__code", "__text")


def _key(value: Column, kind: T.DataType) -> Column:
    return value.cast("string").try_cast(kind)


def multi_get(df: DataFrame, key: str, keys: Sequence[Any] | DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows of the listed keys. A short list becomes a scan filter, a long one or a DataFrame a semi-join."""
    projected = df.select(F.col(f"`{key}`"), *[F.col(f"`{c}`") for c in columns if c != key])
    if not isinstance(keys, DataFrame):
        # Keys may come as text; both ways below compare them in the type of the key, and a key that does not fit is in no row.
        kind = df.schema[key].dataType
        if len(keys) <= POINT_KEYS:
            return projected.where(F.col(f"`{key}`").isin(*(_key(F.lit(k), kind) for k in keys)) if keys else F.lit(False))
        texts = df.sparkSession.createDataFrame([(None if k is None else str(k),) for k in keys], "k string")
        keys = texts.select(_key(F.col("k"), kind).alias(key))
    wanted = keys.select(F.col(f"`{keys.columns[0]}`").alias(key)).where(F.col(f"`{key}`").isNotNull()).distinct()
    # A key may have many rows, so a long list goes the way of large lookups.
    return lookup_join(projected, key, wanted, "left_semi")
