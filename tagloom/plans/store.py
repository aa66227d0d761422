"""Publishing results: a new version is written whole, then made current; readers never see half a run."""

from __future__ import annotations

from typing import Protocol

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import emptied


class ResultStore(Protocol):
    """Where the result of one tag lives between runs."""

    def read(self) -> DataFrame | None: ...

    def publish(self, frame: DataFrame) -> None: ...


class PathStore:
    """Versions as Parquet folders ``<path>/v=N`` and a log of published versions next to them.

    A version counts once its row is in the log. Spark's commit protocol makes that append all or nothing, so
    a job that dies while writing leaves the earlier version current. The earlier version is kept for readers that are
    still on it; the files of older ones are freed.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def version(self) -> int:
        try:
            log = self.spark.read.schema("version long").parquet(f"{self.path}/versions")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return 0
        return log.agg(F.coalesce(F.max("version"), F.lit(0))).first()[0]

    def read(self) -> DataFrame | None:
        current = self.version()
        return self.spark.read.parquet(f"{self.path}/v={current}") if current else None

    def publish(self, frame: DataFrame) -> None:
        following = self.version() + 1
        frame.write.mode("overwrite").parquet(f"{self.path}/v={following}")
        self.spark.range(1).select(F.lit(following).cast("long").alias("version")).write.mode("append").parquet(
            f"{self.path}/versions"
        )
        if following > 2:
            emptied(self.spark, f"{self.path}/v={following - 2}")


class TableStore:
    """Versions as metastore tables ``<name>_vN`` bucketed by key, and a view ``<name>`` over the current one.

    Bucketing by key lets the next run join its items with the prior result without shuffling the wide rows,
    and write them back without shuffling them either.
    The earlier version is kept for readers that are still on it; older ones are dropped.
    """

    def __init__(self, spark: SparkSession, name: str, buckets: int | None = None):
        # As many buckets as shuffle partitions, so that a join takes the buckets as they are.
        self.spark, self.name = spark, name
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def version(self) -> int:
        if not self.spark.catalog.tableExists(self.name):
            return 0
        row = self.spark.sql(f"SHOW TBLPROPERTIES {self.name} ('version')").first()
        return int(row["value"])

    def read(self) -> DataFrame | None:
        return self.spark.table(self.name) if self.version() else None

    def publish(self, frame: DataFrame) -> None:
        current = self.version()
        key, table = frame.columns[0], f"{self.name}_v{current + 1}"
        # The result of a tag is hash-partitioned by key like the buckets are. If the bucket count divides the
        # partition count, every task holds whole buckets or parts of one, and no further shuffle is needed.
        if int(self.spark.conf.get("spark.sql.shuffle.partitions")) % self.buckets:
            frame = frame.repartition(self.buckets, key)
        frame.write.mode("overwrite").bucketBy(self.buckets, key).sortBy(key).format("parquet").saveAsTable(table)
        self.spark.sql(
            f"CREATE OR REPLACE VIEW {self.name} TBLPROPERTIES ('version' = '{current + 1}') AS SELECT * FROM {table}"
        )
        if current > 1:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.name}_v{current - 1}")
