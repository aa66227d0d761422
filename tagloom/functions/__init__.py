"""Column functions."""

from .scalars import (
    blank,
    date_text,
    lenient_date,
    lenient_double,
    lenient_int,
    round_half_up,
    trim_token,
    trim_token_end,
    trim_token_start,
)

__all__ = [
    "blank",
    "date_text",
    "lenient_date",
    "lenient_double",
    "lenient_int",
    "round_half_up",
    "trim_token",
    "trim_token_end",
    "trim_token_start",
]
