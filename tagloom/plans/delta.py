"""Results kept by key bucket, so that a run rewrites only buckets in which a row is new or has changed."""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import re
from collections.abc import Collection, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.formula import is_user_code
from ..operators.items import is_incremental
from ..sources import Catalog, written
from ..sources.shared import emptied, removed
from ..spec import Tag
from .tag import Narrow, TagResult, compute_tag

BUCKETS = 64
_BUCKET = "tagloom_bucket"
# Fingerprint that a row had in the prior result; null for new rows.
OLD = ("__old_a", "__old_b")
_MANIFEST = "version bigint, buckets int, row_schema string, mark string, folders map<int,string>"
# Functions whose value may differ from run to run for the same row.
_VOLATILE = re.compile(r"\b(current_\w+|curdate|now|localtimestamp|rand\w*|uuid|shuffle|\w+_id|input_file_\w+)\s*\(|\bcurrent_\w+\b", re.I)


def bucket_of(key: Column, buckets: int) -> Column:
    """Bucket of a key; keys of different number widths that print alike share one."""
    return F.pmod(F.xxhash64(key.cast("string")), F.lit(buckets)).cast("int")


def _fingerprint(columns: Sequence[str]) -> tuple[Column, Column]:
    """128 bits of hash of a row; the hash skips nulls, so it takes their places as well."""
    cells = [c for name in columns for c in (F.col(f"`{name}`"), F.col(f"`{name}`").isNull())]
    return F.xxhash64(*cells), F.xxhash64(F.lit(1), *cells)


@dataclass(frozen=True)
class Snapshot:
    """One version of a result: the folder of every bucket that has rows."""

    spark: SparkSession
    version: int = 0
    buckets: int = BUCKETS
    schema: T.StructType | None = None
    mark: str | None = None
    folders: dict[int, str] = field(default_factory=dict)

    def read(self, buckets: Collection[int] | None = None) -> DataFrame:
        """All rows, or those of some buckets, whose files alone are then read."""
        folders = [f for b, f in self.folders.items() if buckets is None or b in buckets]
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*folders)

    def tracked(self, buckets: Collection[int] | None = None) -> DataFrame:
        """The same rows with their fingerprints, which a run carries along to tell what it changed."""
        a, b = _fingerprint(self.schema.names)
        return self.read(buckets).withColumns({OLD[0]: a, OLD[1]: b})

    def buckets_of(self, keys: DataFrame) -> set[int]:
        """Buckets of the keys in the first column; there are never more than the store has."""
        bucket = bucket_of(F.col(f"`{keys.columns[0]}`"), self.buckets)
        return {row[0] for row in keys.select(bucket).distinct().collect()}

    def inside(self, key: str, buckets: Collection[int]) -> Column:
        return bucket_of(F.col(f"`{key}`"), self.buckets).isin(*buckets) if buckets else F.lit(False)


class DeltaStore:
    """Copy-on-write by key bucket.

    ``<path>/v=N/tagloom_bucket=B`` holds the rows of bucket B as version N wrote them. The manifest has a row per
    version with the folder of every bucket; Spark's commit protocol adds that row whole or not at all, so a job that
    dies while writing leaves the earlier version current. The earlier version stays whole for readers that are still on
    it; folders that neither of the last two versions names are removed. One writer at a time.

    A bucket should hold some hundred megabytes, as a change to one of its rows rewrites it; ``buckets`` may change
    from run to run, which rewrites everything once.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def _manifest(self) -> DataFrame | None:
        try:
            return self.spark.read.schema(_MANIFEST).parquet(f"{self.path}/manifest")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def snapshots(self, count: int) -> list[Snapshot]:
        """The latest versions, newest first."""
        manifest = self._manifest()
        rows = manifest.orderBy(F.col("version").desc()).limit(count).collect() if manifest is not None else []
        return [
            Snapshot(self.spark, r.version, r.buckets, T.StructType.fromJson(json.loads(r.row_schema)), r.mark, dict(r.folders))
            for r in rows
        ]

    def snapshot(self) -> Snapshot | None:
        return next(iter(self.snapshots(1)), None)

    def version(self) -> int:
        current = self.snapshot()
        return current.version if current else 0

    def read(self) -> DataFrame | None:
        current = self.snapshot()
        return current.read() if current else None

    def publish(self, frame: DataFrame, mark: str | None = None, whole: bool = True) -> set[int]:
        """Make a frame the current version; the buckets that were written.

        Of a frame planned over ``Snapshot.tracked`` rows only the new and changed rows are taken; the others of their buckets
        are copied. A frame without fingerprints, or with other columns than the current version, replaces everything. A
        frame that is not ``whole`` lacks rows of the prior result, which stay. ``mark`` is kept with the version.
        """
        recent = self.snapshots(2)
        current = recent[0] if recent else None
        rows = frame.drop(*OLD)
        number = current.version + 1 if current else 1
        same = current is not None and current.buckets == self.buckets and _shape(current.schema) == _shape(rows.schema)
        if same and set(OLD) <= set(frame.columns):
            folders, touched = self._write_changes(frame, current, number)
        elif not whole:
            raise ValueError("a part of the rows cannot replace the whole result")
        else:
            folders = self._write(rows, number)
            touched = set(folders)
        self._append(number, rows.schema, mark, folders)
        if len(recent) > 1:
            live = {*folders.values(), *current.folders.values()}
            removed(self.spark, [f for f in recent[1].folders.values() if f not in live])
        return touched

    def _write_changes(self, frame: DataFrame, current: Snapshot, number: int) -> tuple[dict[int, str], set[int]]:
        key, columns = frame.columns[0], [c for c in frame.columns if c not in OLD]
        a, b = _fingerprint(columns)
        unchanged = (F.col(OLD[0]) == a) & (F.col(OLD[1]) == b)
        used: list[str] = []
        # Changed rows are written once; the plan of the whole tag does not run again for the copies below.
        changed = written(frame.where(~F.coalesce(unchanged, F.lit(False))).drop(*OLD), "changed-rows", used)
        touched = current.buckets_of(changed)
        folders = dict(current.folders)
        if touched:
            stay = current.read(touched).join(changed.select(key), key, "left_anti")
            folders |= self._write(stay.select(*map(_named, columns)).unionByName(changed), number, touched)
        for path in used:
            emptied(self.spark, path)
        return folders, touched

    def _write(self, rows: DataFrame, number: int, buckets: set[int] | None = None) -> dict[int, str]:
        path = f"{self.path}/v={number}"
        placed = rows.withColumn(_BUCKET, bucket_of(_named(rows.columns[0]), self.buckets))
        placed.repartition(_BUCKET).write.mode("overwrite").partitionBy(_BUCKET).parquet(path)
        if buckets is None:
            held = self.spark.read.schema(f"{_BUCKET} int").parquet(path).distinct().collect()
            buckets = {row[0] for row in held}
        return {b: f"{path}/{_BUCKET}={b}" for b in buckets}

    def _append(self, number: int, schema: T.StructType, mark: str | None, folders: dict[int, str]) -> None:
        row = (number, self.buckets, schema.json(), mark, folders)
        self.spark.createDataFrame([row], _MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")


def _named(column: str) -> Column:
    return F.col(f"`{column}`")


def _shape(schema: T.StructType) -> list[tuple[str, str]]:
    return [(f.name, f.dataType.simpleString()) for f in schema.fields]


def formula_mark(tag: Tag) -> str | None:
    """A text that stays the same while the formulas of a tag give the same values for the same row; None if that cannot be told.

    User functions and expressions of the time or of random numbers give None.
    """
    told: list = [tag.storage, tag.values]
    for item in tag.value_items:
        if item.kind != "formula":
            continue
        text = str(item.content)
        if is_user_code(item) or _VOLATILE.search(text):
            return None
        told.append((item.name, text, item.type, item.default, item.lower_is_better, repr(item.post), repr(item.params)))
    return hashlib.sha256(repr(told).encode()).hexdigest()


def _only_newer_rows(tag: Tag, watermark: dt.datetime | None, exclude: Collection[str]) -> bool:
    """True if no item of a run can change rows for which no source row is new."""
    read = [i for i in tag.value_items if i.kind != "formula" and i.name not in exclude]
    return (
        watermark is not None
        and all(is_incremental(i) for i in read)
        and all(i.extract != "reload" for i in tag.items)
    )


def compute_delta(
    catalog: Catalog,
    tag: Tag,
    store: DeltaStore,
    watermark: dt.datetime | None = None,
    exclude: Collection[str] = (),
    observed: Observation | None = None,
) -> TagResult:
    """Plan a run over the current version of a store, for its ``publish``.

    If all items are incremental and the formulas are those of the last run, only buckets that hold a key of the new source
    rows are read. Otherwise all rows are computed, and the store takes those that differ.
    """
    current = store.snapshot()
    prior = current.tracked() if current else None
    mark = formula_mark(tag)
    result = None
    if current and current.buckets == store.buckets and mark is not None and mark == current.mark:
        if _only_newer_rows(tag, watermark, exclude):
            result = compute_tag(catalog, tag, prior, watermark, exclude, _touched_buckets(tag, current), observed)
            result.whole = False
            if _shape(result.frame.drop(*OLD).schema) != _shape(current.schema):
                result.release()  # columns have changed, so all rows have
                result, observed = None, Observation() if observed else None  # one serves one plan only
    if result is None:
        result = compute_tag(catalog, tag, prior, watermark, exclude, observed=observed)
    # A formula that failed left its old values, so the next run has to see all rows again.
    wanted = {i.name for i in tag.value_items if i.kind == "formula"}
    done = {i.name for level in result.formulas for i in level}
    result.mark = mark if wanted <= done else None
    return result


def _touched_buckets(tag: Tag, current: Snapshot) -> Narrow:
    """Limits a run to the buckets of keys that an item has a value for, or that are new."""

    def narrow(frames: list[DataFrame], spine: DataFrame) -> tuple[DataFrame, Column]:
        key = spine.columns[0]
        if {f.schema[0].dataType for f in (spine, *frames)} != {current.schema[0].dataType}:
            return current.tracked(), F.lit(True)  # buckets go by the text of a key
        # In cell storage a run fills blank cells of all its keys, else only new keys change.
        new = spine if tag.storage == "cell" else spine.join(current.read().select(_named(key)), key, "left_anti")
        keys = reduce(DataFrame.union, [f.select(_named(key)) for f in frames], new.select(_named(key)))
        touched = current.buckets_of(keys)
        return current.tracked(touched), current.inside(key, touched)

    return narrow
