"""Scalar helpers, all of them built-in Spark expressions (no Python workers)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Text forms a lenient date may take, tried in this order.
DATE_FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd")


def trim_token_start(col: Column, token: str) -> Column:
    """Remove every leading repeat of a whole token (not of its characters); null becomes ''."""
    text = F.coalesce(col, F.lit(""))
    return F.regexp_replace(text, f"^(?:{re.escape(token)})+", "") if token else text


def trim_token_end(col: Column, token: str) -> Column:
    """Remove every trailing repeat of a whole token; null becomes ''."""
    text = F.coalesce(col, F.lit(""))
    return F.regexp_replace(text, f"(?:{re.escape(token)})+\\z", "") if token else text


def trim_token(col: Column, token: str) -> Column:
    """Remove a whole token at both ends, the start first."""
    return trim_token_end(trim_token_start(col, token), token)


def date_text(col: Column, pattern: str) -> Column:
    return F.date_format(col, pattern)


def blank(col: Column) -> Column:
    """True for null, empty and whitespace-only cells, whatever the column type."""
    return col.isNull() | (F.trim(col.cast("string")) == "")


def lenient_int(col: Column) -> Column:
    """Whole number of a text cell, 0 when absent, blank or not a number."""
    return F.coalesce(F.trim(col.cast("string")).try_cast("bigint"), F.lit(0).cast("bigint"))


def lenient_double(col: Column) -> Column:
    """Floating-point number of a text cell, 0.0 when absent, blank or not a number."""
    return F.coalesce(F.trim(col.cast("string")).try_cast("double"), F.lit(0.0))


def lenient_date(col: Column) -> Column:
    """Timestamp of a text cell: digits are epoch milliseconds, then the fixed forms, else null."""
    text = F.trim(col.cast("string"))
    millis = F.when(text.rlike("^[0-9]+$"), F.timestamp_millis(text.try_cast("bigint")))
    return F.coalesce(millis, *[F.try_to_timestamp(text, F.lit(form)) for form in DATE_FORMATS])


def round_half_up(col: Column) -> Column:
    """Nearest whole number with halves going up (-2.5 gives -2); NaN gives 0."""
    return F.floor(col + F.lit(0.5)).cast("bigint")
