"""Specification checks and ``#name`` parameters."""

from __future__ import annotations

import itertools

import pytest

from tagloom import Catalog, Item, JdbcPartitioning, Param, PostProcess, SpecError, Staging, Tag, compute_tag
from tagloom.sources import StagingViews, jdbc_options, sql_arguments
from tagloom.spec import formula_levels

KEY = Item("k", "key", "k", table="t")


def formula(name, *needs):
    return Item(name, "formula", "1", type="int", params=tuple(Param(n.lower(), n, "int", "tagitem") for n in needs))


def test_levels_do_not_depend_on_declaration_order():
    items = [formula("C", "B"), formula("B", "A", "unknown"), formula("A")]
    for order in itertools.permutations(items):
        assert [[i.name for i in level] for level in formula_levels(tuple(order))] == [["A"], ["B"], ["C"]]


def test_reference_to_a_raw_column_counts_as_dependency():
    a = Item("A", "formula", "1", type="int", post=PostProcess("weight"))
    assert [[i.name for i in level] for level in formula_levels((formula("B", "A_ctr"), a))] == [["A"], ["B"]]


def test_cycle_is_named():
    with pytest.raises(SpecError, match="A -> B -> A"):
        Tag("t", (KEY, formula("A", "B"), formula("B", "A"))).validate()


@pytest.mark.parametrize(
    "items",
    [
        (),
        (KEY, Item("K")),
        (KEY, Item("a"), Item("A")),
        (KEY, Item("a", post=PostProcess("weight")), Item("a_ctr")),
        (KEY, Item("a", kind="other")),
        (KEY, Item("a", extract="sometimes")),
    ],
)
def test_spoiled_tags(items):
    with pytest.raises(SpecError):
        Tag("t", items).validate()


def test_whole_names_only(spark):
    text, args = sql_arguments("SELECT 1 WHERE 5 > #a AND 5 > #ab", [Param("a", "1"), Param("ab", "2")])
    assert (text, args) == ("SELECT 1 WHERE 5 > :v_a AND 5 > :v_ab", {"v_a": 1, "v_ab": 2})
    assert spark.sql(text, args).count() == 1


def test_parameters_inside_literals(spark):
    catalog = Catalog(spark).add("t", spark.createDataFrame([("it's",), ("b#d",), ("x",)], "s string"))
    params = [Param("p", "it's"), Param("q", "#d"), Param("n", 3, "int")]
    assert [r[0] for r in catalog.sql("SELECT s FROM t WHERE s = '#p' -- #p\n", params).collect()] == ["it's"]
    assert [r[0] for r in catalog.sql("SELECT s FROM t WHERE s LIKE '%#q'", params).collect()] == ["b#d"]
    assert [r[0] for r in catalog.sql("SELECT s FROM t WHERE s = 'b#d'", params).collect()] == ["b#d"]
    assert [r[0] for r in catalog.sql('SELECT s FROM t WHERE s LIKE "%#q" OR s = "#n\'s"', params).collect()] == ["b#d"]
    assert catalog.sql("SELECT #n + 1 AS v FROM t", params).first()["v"] == 4


def test_typed_parameters(spark):
    catalog = Catalog(spark)
    params = [
        Param("d", "2024-01-02", "date"), Param("m", "1704067200000", "date"), Param("bad", "x", "int"),
        Param("f", "1.5"), Param("text", "1.5", "string"), Param("none", None),
    ]
    row = catalog.sql("SELECT #d AS d, #m AS m, #bad AS bad, #f AS f, #text AS text, #none AS none", params).first()
    assert (str(row["d"]), str(row["m"])) == ("2024-01-02 00:00:00", "2024-01-01 00:00:00")
    assert (row["bad"], row["f"], row["text"], row["none"]) == (0, 1.5, "1.5", None)


def test_hostile_parameter_stays_a_value(spark):
    catalog = Catalog(spark).add("t", spark.createDataFrame([("a",), ("b",)], "s string"))
    assert catalog.sql("SELECT s FROM t WHERE s = '#p'", [Param("p", "' OR '1' = '1")]).count() == 0


def test_catalog_names_ignore_case_and_scopes_do_not_leak(spark):
    catalog = Catalog(spark, {"People": lambda: spark.range(3)})
    assert catalog.table("PEOPLE").count() == 3 and catalog.sql("SELECT * FROM people").count() == 3
    scoped = catalog.scoped().add("only_here", spark.range(1))
    assert scoped.table("only_here").count() == 1
    with pytest.raises(SpecError):
        catalog.table("")


def _staged(spark, name, sql, uses):
    catalog = Catalog(spark).add("facts", spark.range(5).withColumnRenamed("id", "k"))
    items = (
        Item("k", "key", "k", table="facts", type="int"),
        Item("v", "sql", "SELECT k, n FROM stg", type="double", default="-1", staging=("stg",) if uses else ()),
        Item("w", "sql", "SELECT k, n + 1 FROM stg", type="double", default="-1", staging=("stg",) if uses else ()),
    )
    return catalog, Tag(name, items, staging=(Staging("stg", sql),) if uses else ())


@pytest.mark.parametrize("order", ["ab", "ba"])
def test_sql_items_see_no_tables_of_other_tags(spark, order):
    spark.range(7).createOrReplaceTempView("facts")
    spark.range(9).selectExpr("id AS k", "id AS n").createOrReplaceTempView("stg")
    tags = {"a": ("SELECT k, 10 * k AS n FROM facts", True), "b": ("", False)}
    for name in order:
        catalog, tag = _staged(spark, name, *tags[name])
        result = compute_tag(catalog, tag)
        rows = {r["k"]: r["v"] for r in result.frame.collect()}
        result.release()
        if name == "a":
            assert rows == {k: 10.0 * k for k in range(5)} and not result.failed
        else:
            assert rows == dict.fromkeys(range(5), -1.0) and result.failed == {"v", "w"}
    assert spark.table("facts").count() == 7 and spark.table("stg").count() == 9
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("__tagloom")]
    spark.catalog.dropTempView("facts")
    spark.catalog.dropTempView("stg")


def test_a_bad_default_fails_its_item_only(spark):
    catalog = Catalog(spark).add("facts", spark.range(2).withColumnRenamed("id", "k"))
    items = (
        Item("k", "key", "k", table="facts", type="int"),
        Item("good", "sql", "SELECT k, k + 1 FROM facts", type="int"),
        Item("bad", "sql", "SELECT k, 7 FROM facts", type="int", default="n/a"),
        Item("day", "sql", "SELECT k, DATE '2020-01-01' FROM facts", type="date", default="soon"),
        Item("big", "sql", "SELECT k, 7 FROM facts WHERE k > 9", type="int", default="9007199254740993"),
        Item("since", "sql", "SELECT k, DATE '2020-01-01' FROM facts WHERE k > 9", type="date", default="2021-02-03"),
    )
    result = compute_tag(catalog, Tag("t", items))
    row = result.frame.orderBy("k").first()
    assert result.failed == {"bad", "day"} and "n/a" in " ".join(result.messages)
    assert (row["good"], row["bad"], row["day"], row["big"], str(row["since"])) == (1, 0, None, 9007199254740993, "2021-02-03")


def test_staging_shared_by_several_items_is_written_once(spark):
    def plan(readers):
        catalog = Catalog(spark).add("t", spark.range(4).withColumnRenamed("id", "k"))
        items = [Item(f"i{n}", "sql", staging=("s",)) for n in range(readers)]
        StagingViews(catalog, [Staging("s", "SELECT k FROM t WHERE k > #low", (Param("low", "1"),))], items).ensure(["s"])
        frame = catalog.sql("SELECT * FROM s")
        assert sorted(r["k"] for r in frame.collect()) == [2, 3]
        return frame._jdf.queryExecution().toString()

    assert "staging-s" not in plan(1) and "staging-s" in plan(2)


def test_unknown_staging(spark):
    with pytest.raises(SpecError):
        StagingViews(Catalog(spark), [], []).ensure(["missing"])


def test_jdbc_options():
    split = JdbcPartitioning("id", "0", "1000", 20)
    options = jdbc_options("jdbc:x", "orders", {"user": "u"}, split)
    assert options["partitionColumn"] == "id" and options["numPartitions"] == "20" and options["user"] == "u"
    assert "partitionColumn" not in jdbc_options("jdbc:x", "orders", {}, None)
