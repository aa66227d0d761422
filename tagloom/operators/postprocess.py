"""Post-processing of item values: weighting against a standard, or clamping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import round_half_up
from ..spec import Item, PostProcess
from ..types import epoch_millis, is_instant, system_type_of


def as_number(col: Column, dtype: T.DataType) -> Column:
    """Floating-point input of post-processing: numbers, numeric text (else 0.0), dates as epoch millis."""
    if isinstance(dtype, T.StringType):
        return F.coalesce(F.trim(col).try_cast("double"), F.lit(0.0))
    if is_instant(dtype):
        return epoch_millis(col).cast("double")
    if system_type_of(dtype) in ("int", "double"):
        return col.cast("double")
    return F.lit(0.0)


def weighted(value: Column, post: PostProcess, lower_is_better: bool) -> Column:
    """Ratio to the standard (inverse when lower is better, 0 for a zero divisor), weighted, in percent."""
    if post.standard is not None:
        standard = F.lit(float(post.standard))
        if lower_is_better:
            value = F.when(value == 0, F.lit(0.0)).otherwise(F.try_divide(standard, value))
        else:
            value = F.lit(0.0) if post.standard == 0 else value / standard
    if post.weight is not None:
        value = value * F.lit(float(post.weight))
    return value * F.lit(100.0)


def clamped(value: Column, post: PostProcess) -> Column:
    """At least ``min``, then at most ``max``; NaN becomes the first bound that is set."""
    if post.min is not None:
        low = F.lit(float(post.min))
        value = F.when((value > low) & ~F.isnan(value), value).otherwise(low)
    if post.max is not None:
        high = F.lit(float(post.max))
        value = F.when(value < high, value).otherwise(high)
    return value


def post_value(col: Column, dtype: T.DataType, item: Item) -> Column:
    """Processed value of an item; whole-number items are rounded half up."""
    if not item.is_post_processed:
        return col
    value = as_number(col, dtype)
    if item.post.kind == "weight":
        value = weighted(value, item.post, item.lower_is_better)
    elif item.post.kind == "number":
        value = clamped(value, item.post)
    return round_half_up(value) if isinstance(dtype, T.LongType) else value


def post_process(df: DataFrame, item: Item) -> DataFrame:
    """Item frame with the processed value next to the raw one."""
    if not item.is_post_processed:
        return df
    raw = F.col(f"`{item.name}`")
    others = [F.col(f"`{c}`") for c in df.columns if c != item.name]
    return df.select(
        *others,
        raw.alias(item.raw_name),
        post_value(raw, df.schema[item.name].dataType, item).alias(item.name),
    )
