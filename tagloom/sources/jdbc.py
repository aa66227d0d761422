"""Databases read over JDBC: tables in parallel ranges, and queries that the database itself runs."""

from __future__ import annotations

import datetime as dt
import math
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field
from decimal import Decimal
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ..spec import Param, SpecError
from .sqltext import sql_with_literals

# Rows of one task of a table that is split by the values of a column.
ROWS_PER_TASK = 1_000_000
MOST_TASKS = 10_000


@dataclass(frozen=True)
class JdbcPartitioning:
    """How one table is read in parallel: ``partitions`` ranges of a numeric or date column with known bounds."""

    column: str
    lower: str
    upper: str
    partitions: int


@dataclass(frozen=True)
class SplitBy:
    """How one table is read in parallel: ranges of a numeric or date column, whose bounds and rows the database is asked for."""

    column: str
    rows_per_task: int = ROWS_PER_TASK


@dataclass(frozen=True)
class Single:
    """A table so small that one task may read it."""


@dataclass(frozen=True)
class Dialect:
    """How a database writes literals."""

    backslash: bool = False  # a backslash in a text literal has to be doubled
    timestamp: str = "TIMESTAMP '{}'"

    def text(self, value: str, quote: str = "'") -> str:
        """The inside of a text literal."""
        if self.backslash:
            value = value.replace("\\", "\\\\")
        return value.replace(quote, quote + quote)

    def literal(self, value: Any) -> str:
        if value is None:
            return "NULL"
        if isinstance(value, bool):
            return "TRUE" if value else "FALSE"
        if isinstance(value, (int, Decimal)):
            return str(value)
        if isinstance(value, float):
            if not math.isfinite(value):
                raise SpecError(f"{value} cannot be written in SQL")
            return repr(value)
        if isinstance(value, dt.datetime):
            return self.timestamp.format(value.isoformat(sep=" "))
        if isinstance(value, dt.date):
            return f"DATE '{value.isoformat()}'"
        return f"'{self.text(str(value))}'"


# Literal forms of databases that depart from standard SQL, by the start of their address.
DIALECTS = {
    "jdbc:mysql:": Dialect(backslash=True),
    "jdbc:mariadb:": Dialect(backslash=True),
    "jdbc:hive2:": Dialect(backslash=True, timestamp="CAST('{}' AS TIMESTAMP)"),
    "jdbc:sqlserver:": Dialect(timestamp="CAST('{}' AS DATETIME2)"),
}


def dialect_of(url: str) -> Dialect:
    return next((d for start, d in DIALECTS.items() if url.startswith(start)), Dialect())


def jdbc_options(url: str, table: str, properties: Mapping[str, str], split: JdbcPartitioning | None) -> dict[str, str]:
    """Options of ``spark.read.format("jdbc")`` for one table."""
    options = {"url": url, "dbtable": table, **properties}
    if split is not None:
        options |= {
            "partitionColumn": split.column,
            "lowerBound": split.lower,
            "upperBound": split.upper,
            "numPartitions": str(split.partitions),
        }
    return options


def jdbc_query_options(url: str, query: str, properties: Mapping[str, str]) -> dict[str, str]:
    """Options of ``spark.read.format("jdbc")`` for a query that the database runs."""
    return {"url": url, "query": query, **properties}


def bounds_query(table: str, column: str) -> str:
    """Asks the database for the range of a column and the rows of its table."""
    return f"SELECT min({column}) AS lo, max({column}) AS hi, count(*) AS n FROM {table}"


def cut_points(low: Any, high: Any, parts: int) -> list[Any]:
    """Values strictly inside a range that cut it into at most so many equal parts, ascending and distinct."""
    if isinstance(low, bool) or not isinstance(low, (int, float, Decimal, dt.date)):
        raise SpecError(f"a table cannot be split by {type(low).__name__} values; name a numeric or date column")
    if isinstance(low, float) and not (math.isfinite(low) and math.isfinite(high)):
        raise SpecError("a column with non-finite values cannot split a table")
    whole = isinstance(low, int) or (isinstance(low, dt.date) and not isinstance(low, dt.datetime))
    points = []
    for k in range(1, parts):
        if isinstance(low, int):
            point = low + (high - low) * k // parts
        elif whole:
            point = low + dt.timedelta(days=(high - low).days * k // parts)
        else:
            point = low + (high - low) * k / parts
        if low < point and (not points or points[-1] < point):
            points.append(point)
    return points


def split_predicates(column: str, points: list[Any], dialect: Dialect) -> list[str]:
    """Conditions of which every row meets exactly one.

    The first takes the rows without a value, and both ends are open, so rows that came after the bounds were read are
    not lost.
    """
    if not points:
        return ["1 = 1"]
    texts = [dialect.literal(p) for p in points]
    inner = [f"{column} >= {a} AND {column} < {b}" for a, b in zip(texts, texts[1:])]
    return [f"{column} < {texts[0]} OR {column} IS NULL", *inner, f"{column} >= {texts[-1]}"]


@dataclass(frozen=True)
class JdbcSource:
    """One database."""

    spark: SparkSession
    url: str
    properties: Mapping[str, str] = field(default_factory=dict)

    @property
    def dialect(self) -> Dialect:
        return dialect_of(self.url)

    def _load(self, options: Mapping[str, str]) -> DataFrame:
        return self.spark.read.format("jdbc").options(**options).load()

    def _ranges(self, table: str, predicates: list[str]) -> DataFrame:
        return self.spark.read.jdbc(self.url, table, predicates=predicates, properties=dict(self.properties))

    def table(self, name: str, split: JdbcPartitioning | SplitBy | Single | None) -> DataFrame:
        """A table in as many tasks as its split says; without one it is refused, as a single task would read it all."""
        if split is None:
            raise SpecError(f"table {name}: say how to split it (SplitBy, JdbcPartitioning), or that it is small (Single)")
        if isinstance(split, SplitBy):
            return self._ranges(name, self.predicates(name, split))
        return self._load(jdbc_options(self.url, name, self.properties, split if isinstance(split, JdbcPartitioning) else None))

    def predicates(self, name: str, split: SplitBy) -> list[str]:
        """One condition per task, from bounds that the database is asked for."""
        row = self._load(jdbc_query_options(self.url, bounds_query(name, split.column), self.properties)).first()
        low, high, rows = row[0], row[1], int(row[2])
        if low is None:
            return ["1 = 1"]
        parts = min(MOST_TASKS, -(-rows // split.rows_per_task))
        return split_predicates(split.column, cut_points(low, high, parts), self.dialect)

    def query(self, text: str, params: Iterable[Param] = ()) -> DataFrame:
        """The rows of a query that the database runs, with parameters as literals of its dialect."""
        return self._load(jdbc_query_options(self.url, sql_with_literals(text, params, self.dialect), self.properties))
