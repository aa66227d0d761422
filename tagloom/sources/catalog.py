"""Named tables for items and SQL: Parquet folders, metastore tables, JDBC databases or DataFrames."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession

from ..lenient import lenient_analysis
from ..spec import Param, SpecError
from .jdbc import JdbcPartitioning, JdbcSource, Single, SplitBy
from .sqltext import sql_arguments


class Catalog:
    """Resolves table names to DataFrames and runs SQL over them.

    Readers are called on first use and remembered, so a table used by many items infers its schema once.
    """

    def __init__(
        self,
        spark: SparkSession,
        readers: Mapping[str, Callable[[], DataFrame]] | None = None,
        database: JdbcSource | None = None,
    ):
        self.spark = spark
        self._readers = {name.lower(): reader for name, reader in (readers or {}).items()}
        self._frames: dict[str, DataFrame] = {}
        # Where SQL runs, and the names that only Spark knows.
        self._database = database
        self._own: set[str] = set()

    @classmethod
    def parquet(cls, spark: SparkSession, folder: str, names: Iterable[str]) -> Catalog:
        """Tables kept as ``folder/name.parquet``."""
        return cls(spark, {n: lambda n=n: spark.read.parquet(f"{folder}/{n}.parquet") for n in names})

    @classmethod
    def jdbc(
        cls,
        spark: SparkSession,
        url: str,
        names: Iterable[str],
        properties: Mapping[str, str],
        partitioning: Mapping[str, JdbcPartitioning | SplitBy | Single] | None = None,
    ) -> Catalog:
        """Tables of a database, each read in the parts that ``partitioning`` gives; a table it does not name is refused.

        SQL over the database's own tables runs in the database. SQL that names a staging query or an added frame runs in
        Spark.
        """
        database = JdbcSource(spark, url, properties)
        splits = {name.lower(): split for name, split in (partitioning or {}).items()}

        def reader(name: str) -> Callable[[], DataFrame]:
            return lambda: database.table(name, splits.get(name.lower()))

        return cls(spark, {name: reader(name) for name in names}, database)

    def scoped(self) -> Catalog:
        """A copy that can take staging queries without showing them to other tags."""
        copy = Catalog(self.spark, self._readers, self._database)
        copy._frames, copy._own = dict(self._frames), set(self._own)
        return copy

    def add(self, name: str, frame: DataFrame) -> Catalog:
        """Put a DataFrame under a name, replacing an earlier table of that name."""
        self._readers[name.lower()] = lambda: frame
        self._own.add(name.lower())
        self._frames.pop(name.lower(), None)
        return self

    def table(self, name: str) -> DataFrame:
        """The named table; names the catalog does not hold are looked up in the metastore."""
        if not name:
            raise SpecError("no source table given")
        known = name.lower()
        if known not in self._readers:
            return self._metastore_table(name)
        if known not in self._frames:
            self._frames[known] = self._readers[known]()
        return self._frames[known]

    def _metastore_table(self, name: str) -> DataFrame:
        """A table of the metastore, and not a temporary view of the same name."""
        if "." not in name:
            name = f"{self.spark.catalog.currentDatabase()}.{name}"
        return self.spark.table(name)

    def sql(self, text: str, params: Iterable[Param] = ()) -> DataFrame:
        """Run user SQL over the catalog's tables; other names are looked up in the metastore only.

        The SQL of a database's catalog is sent to the database, unless it names a staging query.
        The tables it names are bound inside the query, as common table expressions over views that exist while it is
        analysed. So a query sees neither the tables of another catalog nor the user's temporary views, and changes none.
        Casts and divisions that fail give null, as the databases such queries are written for do.
        """
        words = set(re.findall(r"\w+", text.lower()))
        if self._database is not None and not words & self._own:
            return self._database.query(text, params)
        query, args = sql_arguments(text.strip().removesuffix(";"), params)
        views = {}
        with lenient_analysis(self.spark):
            hidden: dict[str, DataFrame] = {}
            try:
                self._hide_views(words, hidden)
                for name in sorted(words & self._readers.keys()):
                    views[name] = f"__tagloom_{uuid.uuid4().hex}"
                    self.table(name).createTempView(views[name])
                bound = ", ".join(f"`{name}` AS (SELECT * FROM {view})" for name, view in views.items())
                whole = f"WITH {bound} SELECT * FROM (\n{query}\n)" if bound else query
                return self.spark.sql(whole, args) if args else self.spark.sql(whole)
            finally:
                for view in views.values():
                    self.spark.catalog.dropTempView(view)
                for name, frame in hidden.items():
                    frame.createOrReplaceTempView(name)

    def _hide_views(self, words: set[str], hidden: dict[str, DataFrame]) -> None:
        """Take away the session's temporary views of names in a query that are no table of the catalog.

        Each is put into ``hidden`` before it goes, so that the caller can bring all of them back whatever happens.
        """
        named = words - self._readers.keys()
        for row in self.spark.sql("SHOW VIEWS").collect():
            if row.isTemporary and not row.namespace and row.viewName.lower() in named:
                hidden[row.viewName] = self.spark.table(row.viewName)
                self.spark.catalog.dropTempView(row.viewName)
