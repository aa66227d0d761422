"""How expressions written by users are analysed."""

from __future__ import annotations

import threading
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Reentrant, as planning a tag analyses expressions inside expressions.
_PLANNING = threading.RLock()


@contextmanager
def lenient_analysis(spark: SparkSession) -> Iterator[None]:
    """Analyse expressions so that a bad cast or a zero divisor gives null in its row instead of failing the job.

    The mode is fixed when an expression is analysed, so it is restored before any job of the user runs. It is a setting
    of the session, so threads that plan at the same time take turns.
    """
    with _PLANNING:
        before = spark.conf.get("spark.sql.ansi.enabled")
        spark.conf.set("spark.sql.ansi.enabled", "false")
        try:
            yield
        finally:
            spark.conf.set("spark.sql.ansi.enabled", before)
