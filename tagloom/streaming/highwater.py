"""Incremental extraction: rows newer than the start of the last successful run."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..spec import SpecError
from ..types import is_instant

EPOCH = dt.datetime(1970, 1, 1)


def newer_than(df: DataFrame, column: str, watermark: dt.datetime | None) -> Column:
    """``column > watermark`` with the watermark as a literal of the column's own type, so it reaches the scan.

    Without an earlier run the watermark is the epoch.
    """
    name = {c.lower(): c for c in df.columns}.get(column.lower())
    if name is None:
        raise SpecError(f"no increment column {column}")
    dtype = df.schema[name].dataType
    if not is_instant(dtype):
        raise SpecError(f"increment column {column} is {dtype.simpleString()}, not a date or timestamp")
    text = (watermark or EPOCH).isoformat(sep=" ")
    return F.col(f"`{name}`") > F.lit(text).cast("timestamp_ntz").cast(dtype)


def last_success(log: DataFrame, model: Column, *, status: Column, operated_at: Column) -> DataFrame:
    """Start of the latest successful run of every model."""
    return log.where(status).groupBy(model.alias("model")).agg(F.max(operated_at).alias("last_ok"))
