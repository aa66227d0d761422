"""Append-only log of model runs."""

from __future__ import annotations

import datetime as dt
import itertools
import json
import time
import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import removed
from .highwater import last_success

# Run states.
RUNNING, SUCCESS, FAILED = "running", "success", "failed"

# ``kind`` is start, message or end; (run_id, seq, writer) is unique, so a row that is there twice is the same row.
_SCHEMA = (
    "run_id string, seq bigint, writer string, kind string, model string, operated_at timestamp, at timestamp, message string"
)
_STAMP = "yyyy-MM-dd HH:mm:ss.SSSSSS"
# Files beyond which the log of a day that is over is written anew as one.
COMPACT_FILES = 100


def messages_json(messages: Sequence[str], earlier: str | None = None) -> str | None:
    """JSON array of the messages of a run, after those already logged; None when there are none."""
    if not messages:
        return earlier
    return json.dumps([*(json.loads(earlier) if earlier else []), *messages], ensure_ascii=False)


class RunLog:
    """One row when a run starts, one for each of its messages and one when it ends, in Parquet folders by day.

    Nothing is read before it is written, so several writers, also of one run, keep each other's messages. Messages
    stand in the order of the writers' clocks.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._writer, self._count = uuid.uuid4().hex, itertools.count()

    def now(self) -> dt.datetime:
        """Current time on the session's clock and in its time zone, as the sources' timestamps are read."""
        text = self.spark.sql(f"SELECT date_format(current_timestamp(), '{_STAMP}')").first()[0]
        return dt.datetime.strptime(text, "%Y-%m-%d %H:%M:%S.%f")

    def rows(self) -> DataFrame:
        """Every row that was logged, once."""
        try:
            rows = self.spark.read.schema(f"{_SCHEMA}, day string").parquet(self.path)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], _SCHEMA)
        # A compaction that did not end leaves rows both in its file and in the old ones.
        return rows.drop("day").dropDuplicates(["run_id", "seq", "writer"])

    def runs(self) -> DataFrame:
        """Latest state of every run, with its messages as a JSON array in order; null if there are none."""
        ended = lambda value: F.max(F.when(F.col("kind") == "end", value))
        line = F.when(F.col("kind") == "message", F.struct("seq", "writer", "message"))
        runs = self.rows().groupBy("run_id").agg(
            F.max("model").alias("model"),
            F.max("operated_at").alias("operated_at"),
            ended(F.col("at")).alias("completed_at"),
            F.sort_array(F.collect_list(line)).alias("lines"),
        )
        return runs.select(
            "run_id",
            "model",
            _status(F.col("completed_at").isNotNull(), F.size("lines") > 0).alias("status"),
            "operated_at",
            "completed_at",
            _json_array(F.transform("lines", lambda x: x["message"])).alias("messages"),
        )

    def start(self, model: str, operated_at: dt.datetime) -> str:
        run_id = uuid.uuid4().hex
        self._append(run_id, model, operated_at, [("start", None)])
        return run_id

    def messages(self, run_id: str) -> str | None:
        """What a run has logged so far, as a JSON array; None if nothing."""
        row = self.runs().where(F.col("run_id") == run_id).select("messages").first()
        return row["messages"] if row else None

    def append(self, run_id: str, model: str, operated_at: dt.datetime, messages: Sequence[str]) -> None:
        """Add messages to a run that goes on, so that they are kept if it never ends."""
        if messages:
            self._append(run_id, model, operated_at, [("message", m) for m in messages])

    def finish(self, run_id: str, model: str, operated_at: dt.datetime, messages: Sequence[str] = ()) -> None:
        """End a run, with further messages if any: successful exactly when it left none at all."""
        self._append(run_id, model, operated_at, [*(("message", m) for m in messages), ("end", None)])

    def last_success(self, model: str) -> dt.datetime | None:
        """Start of the latest successful run, None before the first."""
        # Counting is enough here; the messages themselves need not be read.
        kind = lambda name: F.count(F.when(F.col("kind") == name, 1)) > 0
        runs = self.rows().where(F.col("model") == model).groupBy("run_id", "model").agg(
            _status(kind("end"), kind("message")).alias("status"), F.max("operated_at").alias("operated_at")
        )
        marks = last_success(runs, F.col("model"), status=F.col("status") == SUCCESS, operated_at=F.col("operated_at"))
        row = marks.select(F.date_format("last_ok", _STAMP).alias("t")).first()
        return None if row is None or row["t"] is None else dt.datetime.strptime(row["t"], "%Y-%m-%d %H:%M:%S.%f")

    def compact(self, files: int = COMPACT_FILES) -> list[str]:
        """Write every day that is over and has more than so many files as one file; the days that were.

        Rows go into the new file before the old ones are removed, and readers take each row once, so neither readers
        nor a job that dies in between lose or double one. Writers write into the folder of the current day only.
        """
        today = self._today()
        try:
            found = self.spark.read.schema(f"{_SCHEMA}, day string").parquet(self.path)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return []
        place = found.where(F.col("day") < today).select("day", F.input_file_name().alias("file"))
        held = place.groupBy("day").agg(F.collect_set("file").alias("files"))
        many = held.where(F.size("files") > files).collect()
        for row in many:
            old = self.spark.read.schema(_SCHEMA).parquet(*row.files)
            old.coalesce(1).write.mode("append").parquet(f"{self.path}/day={row.day}")
            removed(self.spark, row.files)
        return sorted(row.day for row in many)

    def _today(self) -> str:
        return self.now().date().isoformat()

    def _append(self, run_id: str, model: str, operated_at: dt.datetime, rows: Sequence[tuple[str, str | None]]) -> None:
        # Nanoseconds order the rows of all writers, the counter those of one writer in one tick.
        clock = time.time_ns()
        values = [(run_id, clock + next(self._count), self._writer, kind, model, message) for kind, message in rows]
        began = F.lit(operated_at.isoformat(sep=" ")).cast("timestamp")
        now = F.current_timestamp()
        self.spark.createDataFrame(
            values, "run_id string, seq bigint, writer string, kind string, model string, message string"
        ).select(
            "*", began.alias("operated_at"), now.alias("at"), F.date_format(now, "yyyy-MM-dd").alias("day")
        ).coalesce(1).write.mode("append").partitionBy("day").parquet(self.path)


def _status(ended: Column, has_messages: Column) -> Column:
    return F.when(~ended, RUNNING).when(has_messages, FAILED).otherwise(SUCCESS)


def _json_array(texts: Column) -> Column:
    """A JSON array of texts with a blank after each comma, as ``messages_json`` writes it."""
    quoted = F.transform(texts, lambda t: F.regexp_replace(F.to_json(F.array(t)), r"^\[|\]$", ""))
    return F.when(F.size(texts) > 0, F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]")))
