"""Intermediate results that must survive lost executors live in the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; only a local session may fall back to a temporary one."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
        folder = tempfile.mkdtemp(prefix="tagloom-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder


def emptied(spark: SparkSession, path: str) -> None:
    """Free the space of a frame that was ``written``, once no plan reads it any more."""
    spark.range(0).write.mode("overwrite").parquet(path)


def removed(spark: SparkSession, paths: Iterable[str]) -> None:
    """Remove folders through the file system that Spark resolves them by; a missing one is no error."""
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def written(df: DataFrame, name: str, paths: list[str] | None = None) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Unlike a cached frame it outlives its executors, and unlike a checkpoint it stays columnar, so later
    readers still prune columns and push filters. The path is added to ``paths``, if given.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    if paths is not None:
        paths.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
