"""What is sent to a database: literals, queries and ranges. A DuckDB connection of this process stands in for it."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

import duckdb
import pytest

from tagloom import Catalog, Item, JdbcPartitioning, Param, Single, SpecError, SplitBy, Staging, Tag, compute_tag
from tagloom.sources.jdbc import Dialect, JdbcSource, cut_points, dialect_of, jdbc_query_options, split_predicates
from tagloom.sources.sqltext import sql_with_literals

URL = "jdbc:postgresql://host/db"


class Stand(JdbcSource):
    """Takes what would go to the database and answers it from DuckDB."""

    def __init__(self, spark, con):
        super().__init__(spark, URL, {"user": "u"})
        object.__setattr__(self, "con", con)
        object.__setattr__(self, "sent", [])

    def _frame(self, sql):
        return self.spark.createDataFrame(self.con.execute(sql).df())

    def _load(self, options):
        assert options["url"] == URL and options["user"] == "u" and not {"query", "dbtable"} <= options.keys()
        self.sent.append(options)
        return self._frame(options.get("query") or f"SELECT * FROM {options['dbtable']}")

    def _ranges(self, table, predicates):
        self.sent.append({"dbtable": table, "predicates": predicates})
        frames = [self._frame(f"SELECT * FROM {table} WHERE {p}") for p in predicates]
        out = frames[0]
        for frame in frames[1:]:
            out = out.unionByName(frame)
        return out


@pytest.fixture
def stand(spark):
    con = duckdb.connect()
    con.execute("CREATE TABLE facts AS SELECT range AS k, range * 1.5 AS v, 'it''s ' || (range % 3) AS s FROM range(20)")
    return Stand(spark, con)


def catalog_of(stand, partitioning=None):
    catalog = Catalog.jdbc(stand.spark, URL, ["facts"], {"user": "u"}, partitioning)
    splits = partitioning or {}
    catalog._database = stand
    catalog._readers["facts"] = lambda: stand.table("facts", splits.get("facts"))
    return catalog


def test_sql_of_an_item_runs_in_the_database(stand):
    catalog = catalog_of(stand)
    params = (Param("low", "4"), Param("word", "it's"))
    item = Item("n", "sql", "SELECT k % 5 AS g, count(*) FROM facts WHERE k > #low AND s LIKE '#word %' GROUP BY 1;", type="int", params=params)
    key = Item("g", "key", "SELECT DISTINCT k % 5 FROM facts", key_kind="sql", type="int")
    result = compute_tag(catalog, Tag("t", (key, item)))
    assert sorted(tuple(r) for r in result.frame.collect()) == [(g, 3) for g in range(5)]
    queries = [o["query"] for o in stand.sent]
    assert "SELECT k % 5 AS g, count(*) FROM facts WHERE k > 4 AND s LIKE 'it''s %' GROUP BY 1" in queries
    assert len(queries) == 2 and not any("dbtable" in o for o in stand.sent)


def test_sql_over_staging_runs_in_spark(stand):
    catalog = catalog_of(stand, {"facts": Single()})
    staging = Staging("stg", "SELECT k, v FROM facts WHERE k < #top", (Param("top", 3, "int"),))
    items = (
        Item("k", "key", "k", table="facts", type="int"),
        Item("w", "sql", "SELECT k, v + 1 FROM stg", type="double", default="-1", staging=("stg",)),
        Item("x", "sql", "SELECT a.k, a.v FROM stg JOIN facts a ON a.k = stg.k", type="double", staging=("stg",)),
    )
    result = compute_tag(catalog, Tag("t", items, staging=(staging,)))
    rows = {r.k: (r.w, r.x) for r in result.frame.collect()}
    result.release()
    assert rows[2] == (4.0, 3.0) and rows[7] == (-1.0, 0.0) and len(rows) == 20
    # The staging query itself went to the database, the items that read it did not.
    assert [o["query"] for o in stand.sent if "query" in o] == ["SELECT k, v FROM facts WHERE k < 3"]


def test_a_frame_that_was_added_hides_the_database_table(stand):
    catalog = catalog_of(stand).scoped().add("facts", stand.spark.range(4).withColumnRenamed("id", "k"))
    assert catalog.sql("SELECT count(*) AS n FROM facts").first().n == 4 and not stand.sent


@pytest.mark.parametrize(
    "value, kind",
    [("4", None), ("x' OR '1'='1", "string"), ("2.5", None), (None, None), ("back\\slash", "string"), ("2024-01-02", "date"), (True, None)],
)
def test_literals_mean_what_parameters_mean(spark, value, kind):
    """A database with literals gives what Spark gives with bound parameters."""
    text = "SELECT #p AS bare, '<#p>' AS inside, '#px' AS other -- #p"
    params = [Param("p", value, kind)]
    own = duckdb.connect().execute(sql_with_literals(text, params, Dialect())).fetchone()
    bound = Catalog(spark).sql(text, params).first()
    assert tuple(map(str, own)) == tuple(map(str, bound))


def test_literals_of_dialects():
    mysql, hive, other = dialect_of("jdbc:mysql://h/d"), dialect_of("jdbc:hive2://h"), dialect_of("jdbc:oracle:thin:@h")
    hostile = [Param("p", "\\' OR 1=1 --", "string")]
    assert sql_with_literals("'#p'", hostile, mysql) == "'\\\\'' OR 1=1 --'"
    assert sql_with_literals("'#p'", hostile, other) == "'\\'' OR 1=1 --'"
    assert sql_with_literals('"#p"', [Param("p", 'a"b')], mysql) == '"a""b"'
    at = [Param("d", dt.datetime(2024, 1, 2, 3), "date")]
    assert sql_with_literals("#d", at, hive) == "CAST('2024-01-02 03:00:00' AS TIMESTAMP)"
    assert sql_with_literals("#d", at, other) == "TIMESTAMP '2024-01-02 03:00:00'"
    assert other.literal(Decimal("1.50")) == "1.50" and other.literal(dt.date(2024, 1, 2)) == "DATE '2024-01-02'"
    with pytest.raises(SpecError):
        other.literal(float("nan"))
    assert jdbc_query_options(URL, "SELECT 1", {"user": "u"}) == {"url": URL, "query": "SELECT 1", "user": "u"}


@pytest.mark.parametrize(
    "kind, values",
    [
        ("BIGINT", [5, 5, 5, 9, 12, 100, -3, None, None]),
        ("DOUBLE", [0.5, 0.25, -7.0, None, 3.0, 3.0]),
        ("DECIMAL(9,2)", ["1.10", "2.20", None, "9.99"]),
        ("DATE", ["2024-01-01", "2024-02-29", None, "2024-01-02"]),
        ("TIMESTAMP", ["2024-01-01 01:02:03", "2024-02-29 23:59:59.5", None]),
        ("BIGINT", [4, 4, 4]),
        ("BIGINT", [None, None]),
        ("BIGINT", []),
    ],
)
@pytest.mark.parametrize("rows_per_task", [1, 2, 1000])
def test_ranges_hold_every_row_once(spark, kind, values, rows_per_task):
    con = duckdb.connect()
    con.execute(f"CREATE TABLE t (c {kind})")
    if values:
        con.executemany("INSERT INTO t VALUES (?)", [(v,) for v in values])
    lo, hi, n = con.execute("SELECT min(c), max(c), count(*) FROM t").fetchone()
    points = [] if lo is None else cut_points(lo, hi, -(-n // rows_per_task))
    predicates = split_predicates("c", points, Dialect())
    # Rows outside the bounds that were read are taken as well.
    if lo is not None and kind == "BIGINT":
        con.execute("INSERT INTO t VALUES (-1000), (100000)")
    whole = sorted(map(str, con.execute("SELECT c FROM t").fetchall()))
    parts = [con.execute(f"SELECT c FROM t WHERE {p}").fetchall() for p in predicates]
    assert sorted(str(row) for part in parts for row in part) == whole
    assert len(predicates) == max(1, len(points) + 1) <= max(1, n)


def test_tables_are_split_as_the_database_says(stand):
    catalog = catalog_of(stand, {"facts": SplitBy("k", 5)})
    assert catalog.table("facts").count() == 20
    bounds, ranges = stand.sent
    assert bounds["query"] == "SELECT min(k) AS lo, max(k) AS hi, count(*) AS n FROM facts"
    assert ranges["predicates"] == ["k < 4 OR k IS NULL", "k >= 4 AND k < 9", "k >= 9 AND k < 14", "k >= 14"]
    assert stand.predicates("facts", SplitBy("k", 1)) != stand.predicates("facts", SplitBy("k", 100)) == ["1 = 1"]
    with pytest.raises(SpecError, match="numeric or date"):
        stand.predicates("facts", SplitBy("s"))


def test_a_table_without_a_split_is_refused(stand):
    with pytest.raises(SpecError, match="facts: say how to split it"):
        catalog_of(stand).table("facts")
    assert catalog_of(stand, {"facts": Single()}).table("facts").count() == 20
    catalog_of(stand, {"facts": JdbcPartitioning("k", "0", "20", 4)}).table("facts")
    assert stand.sent[-1]["numPartitions"] == "4" and "numPartitions" not in stand.sent[-2]
