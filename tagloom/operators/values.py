"""Which values count: non-null keys, valid values, one value per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..spec import SpecError

# Texts that never count as a value in strict mode.
INVALID_TEXTS = ("", "NaN", "Infinity", "null", "Null", "NULL")


def is_valid(col: Column, dtype: T.DataType, mode: str = "strict") -> Column:
    """True for values worth keeping. ``compat`` drops only nulls."""
    if mode == "compat":
        return col.isNotNull()
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return col.isNotNull() & ~F.isnan(col) & (col != F.lit(float("inf")))
    if isinstance(dtype, (T.StringType, T.CharType, T.VarcharType)):
        return col.isNotNull() & ~col.isin(*INVALID_TEXTS)
    return col.isNotNull()


def exclude_invalid(df: DataFrame, column: str, mode: str = "strict") -> DataFrame:
    return df.where(is_valid(F.col(column), df.schema[column].dataType, mode))


def distinct_pairs(df: DataFrame) -> DataFrame:
    """Distinct rows of an item frame, the form in which several values per key are still visible."""
    return df.where(F.col(df.columns[0]).isNotNull()).distinct()


def single_value(rule: str, value: Column, order: Column | None = None) -> Column:
    """Aggregate that leaves one value per key; all of them combine partially before the shuffle."""
    if rule == "max":
        return F.max(value)
    if rule == "count":
        # A key without a value keeps what it has, as under the other rules.
        return F.nullif(F.count(value), F.lit(0).cast("bigint"))
    if rule == "sum":
        return F.try_sum(value)  # a total beyond 64 bits is no value
    if rule == "latest":
        if order is None:
            raise SpecError("the latest rule needs an increment column")
        return F.max_by(value, F.when(value.isNotNull(), F.struct(order, value)))
    return F.when(F.min(value) == F.max(value), F.max(value)).otherwise(
        F.when(F.min(value).isNotNull(), F.raise_error(F.lit("several values for one key")))
    )
