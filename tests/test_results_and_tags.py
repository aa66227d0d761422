"""Result tables over several runs, failure isolation, properties of whole tags."""

from __future__ import annotations

import datetime as dt

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tagloom import Catalog, Item, Param, PostProcess, Staging, Tag, compute_tag
from tagloom.operators import result as R

VALUE = Item("v", "basic", "v", table="facts", key_column="k", type="double")
KEY = Item("k", "key", "k", table="people", type="int")


def as_dict(df, *columns):
    columns = columns or tuple(df.columns[1:])
    rows = {r[df.columns[0]]: tuple(r[c] for c in columns) for r in df.collect()}
    return {k: v[0] if len(v) == 1 else v for k, v in rows.items()}


def tables(spark, people, facts, schema="k long, v double"):
    return Catalog(spark).add("people", spark.createDataFrame([(p,) for p in people], "k long")).add(
        "facts", spark.createDataFrame(facts, schema)
    )


@pytest.fixture
def prior(spark):
    return spark.createDataFrame([(1, 10.0), (2, 20.0)], "k long, v double")


def test_merge_steps(spark, prior):
    spine = spark.createDataFrame([(2,), (3,)], "k long")
    base = R.base_result(prior, spine, [VALUE])
    assert as_dict(base) == {1: 10.0, 2: 20.0, 3: 0.0}
    frame = spark.createDataFrame([(2, 5.0), (9, 7.0)], "k long, v double")
    assert as_dict(R.update_existing(base, frame)) == {1: 10.0, 2: 5.0, 3: 0.0}
    assert as_dict(R.update_existing(base, frame, {"v": R.default_value(VALUE)})) == {1: 0.0, 2: 5.0, 3: 0.0}
    assert as_dict(R.reload_column(base, VALUE)) == {1: 0.0, 2: 0.0, 3: 0.0}
    assert as_dict(R.new_keys(spine, prior).withColumn("x", F.lit(1))) == {3: 1}


def test_update_writes_nulls_of_matched_rows(spark, prior):
    frame = spark.createDataFrame([(2, None)], "k long, v double")
    assert as_dict(R.update_existing(prior, frame)) == {1: 10.0, 2: None}


def test_whole_tag_over_a_prior_result(spark, prior):
    catalog = tables(spark, [2, 3], [(2, 5.0), (2, 8.0), (9, 7.0), (None, 1.0)])
    assert as_dict(compute_tag(catalog, Tag("t", (KEY, VALUE)), prior).frame) == {1: 10.0, 2: 8.0, 3: 0.0}
    reload = Item("v", "basic", "v", table="facts", key_column="k", type="double", extract="reload")
    assert as_dict(compute_tag(catalog, Tag("t", (KEY, reload)), prior).frame) == {1: 0.0, 2: 8.0, 3: 0.0}


def test_key_reload_starts_a_new_table(spark, prior):
    key = Item("k", "key", "k", table="people", type="int", extract="reload")
    catalog = tables(spark, [2, 3], [(2, 5.0)])
    assert as_dict(compute_tag(catalog, Tag("t", (key, VALUE)), prior).frame) == {2: 5.0, 3: 0.0}


def test_columns_are_added_retyped_and_kept(spark):
    prior = spark.createDataFrame([(1, "7", "extra"), (2, "x", None)], "k long, v string, other string")
    items = (KEY, VALUE, Item("grade", "basic", "g", table="facts", key_column="k", default="n/a"))
    catalog = tables(spark, [1], [(1, 1.0, "A")], "k long, v double, g string")
    out = compute_tag(catalog, Tag("t", items), prior).frame
    assert out.columns == ["k", "v", "grade", "other"]
    assert as_dict(out) == {1: (1.0, "A", "extra"), 2: (None, "n/a", None)}


def test_raw_column_is_kept_and_not_reset(spark):
    post = PostProcess("number", max=6.0)
    item = Item("v", "basic", "v", table="facts", key_column="k", type="double", extract="reload", post=post)
    prior = spark.createDataFrame([(1, 11.0, 6.0), (2, 3.0, 3.0)], "k long, v_ctr double, v double")
    out = compute_tag(tables(spark, [1, 2], [(2, 9.0)]), Tag("t", (KEY, item)), prior).frame
    assert as_dict(out, "v_ctr", "v") == {1: (11.0, 0.0), 2: (9.0, 6.0)}


def test_typed_defaults(spark):
    items = [
        Item("i", type="int"), Item("d", type="double"), Item("s"), Item("t", type="date"),
        Item("i2", type="int", default="3"), Item("d2", type="double", default="2.5"), Item("t2", type="date", default="2024-01-02"),
        Item("p", default="5", post=PostProcess("weight")),
    ]
    row = R.init_defaults(spark.range(1).withColumnRenamed("id", "k"), items).first()
    assert row[1:] == (0, 0.0, "", None, 3, 2.5, dt.date(2024, 1, 2), "5", 5.0)
    empty = R.init_defaults(spark.range(1).withColumnRenamed("id", "k"), items, "cell").first()
    assert empty[1:] == (None, None, None, None, 3, 2.5, dt.date(2024, 1, 2), "5", 5.0)


def test_cell_storage_fills_blanks_of_the_runs_keys_only(spark):
    prior = spark.createDataFrame([(1, " "), (2, ""), (3, "x")], "k long, s string")
    item = Item("s", "basic", "s", table="facts", key_column="k", default="none")
    catalog = tables(spark, [1, 3, 4], [(7, "q")], "k long, s string")
    out = compute_tag(catalog, Tag("t", (KEY, item), storage="cell"), prior).frame
    assert as_dict(out) == {1: "none", 2: "", 3: "x", 4: "none"}


def test_formulas_read_blank_cells_as_empty_values(spark):
    prior = spark.createDataFrame([(1, None, None)], "k long, s string, n long")
    params = (Param("s", "s", "string", "tagitem"), Param("n", "n", "int", "tagitem"))
    items = (KEY, Item("f", "formula", "concat('<', #s, '>', #n)", params=params))
    catalog = tables(spark, [1], [(1, 1.0)])
    assert as_dict(compute_tag(catalog, Tag("t", items, storage="cell"), prior).frame, "f") == {1: "<>0"}
    assert as_dict(compute_tag(catalog, Tag("t", items), prior).frame, "f") == {1: ""}


def test_formula_covers_rows_outside_the_run_and_sees_defaults(spark, prior):
    twice = Item("w", "formula", "#v * 2", type="double", params=(Param("v", "v", "double", "tagitem"),))
    out = compute_tag(tables(spark, [2, 3], [(2, 5.0)]), Tag("t", (KEY, twice, VALUE)), prior).frame
    assert as_dict(out, "w") == {1: 20.0, 2: 10.0, 3: 0.0}


def test_formula_without_value_keeps_the_old_one(spark):
    prior = spark.createDataFrame([(1, 4, 0, 77), (2, 4, 2, 77)], "k long, a long, b long, q long")
    params = (Param("a", "a", "int", "tagitem"), Param("b", "b", "int", "tagitem"))
    items = (KEY, Item("q", "formula", "#a div #b", type="int", params=params))
    assert as_dict(compute_tag(tables(spark, [1, 2], [(1, 1.0)]), Tag("t", items), prior).frame, "q") == {1: 77, 2: 2}


def test_incremental_runs(spark):
    facts = [(1, 9.0, dt.datetime(2024, 1, 1)), (1, 4.0, dt.datetime(2024, 3, 1)), (2, 5.0, dt.datetime(2024, 1, 5))]
    item = Item("v", "basic", "v", table="facts", key_column="k", type="double", extract="incremental", increment_column="t")
    for kind in ("timestamp", "timestamp_ntz", "date"):
        frame = spark.createDataFrame(facts, "k long, v double, t timestamp").withColumn("t", F.col("t").cast(kind))
        catalog = tables(spark, [1, 2], [(1, 1.0)]).add("facts", frame)
        first = compute_tag(catalog, Tag("t", (KEY, item))).frame
        assert as_dict(first) == {1: 9.0, 2: 5.0}
        second = compute_tag(catalog, Tag("t", (KEY, item)), first, dt.datetime(2024, 2, 1, 12)).frame
        assert as_dict(second) == {1: 4.0, 2: 5.0}
        at_mark = compute_tag(catalog, Tag("t", (KEY, item)), first, dt.datetime(2024, 3, 1)).frame
        assert as_dict(at_mark) == {1: 9.0, 2: 5.0}


def test_increment_column_of_another_type_is_an_item_error(spark):
    item = Item("v", "basic", "v", table="facts", key_column="k", type="double", extract="incremental", increment_column="v")
    result = compute_tag(tables(spark, [1], [(1, 1.0)]), Tag("t", (KEY, item)))
    assert result.failed == {"v"} and as_dict(result.frame) == {1: 0.0}


def test_every_kind_of_planning_error_stays_with_its_item(spark):
    broken = (
        Item("no_table", "basic", "v", table="nowhere", key_column="k", type="int", default="-1"),
        Item("no_column", "basic", "nope", table="facts", key_column="k", type="int"),
        Item("bad_sql", "sql", "SELEC 1", type="int"),
        Item("one_column", "sql", "SELECT k FROM facts", type="int"),
        Item("no_method", "method", "missing", table="facts", type="int"),
        Item("no_staging", "sql", "SELECT 1, 2", type="int", staging=("gone",)),
        Item("second_key", "key", "v", table="facts", type="int"),
        Item("bad_formula", "formula", "#x +", type="int", params=(Param("x", "v", "int", "tagitem"),)),
        Item("no_param", "formula", "#x", type="int", params=(Param("x", "absent", "int", "tagitem"),)),
    )
    result = compute_tag(tables(spark, [1], [(1, 4.0)]), Tag("t", (KEY, *broken, VALUE)))
    assert result.failed == {i.name for i in broken} and len(result.messages) == len(broken)
    assert as_dict(result.frame, "v", "no_table", "bad_formula") == {1: (4.0, -1, 0)}


def test_bad_casts_of_user_expressions_are_nulls(spark):
    catalog = tables(spark, [1, 2], [(1, "5"), (2, "x")], "k long, s string")
    items = (
        Item("a", "basic", "cast(s AS int)", table="facts", key_column="k", type="int", default="-1"),
        Item("b", "sql", "SELECT k, 10 / cast(s AS int) FROM facts", type="double", default="-1"),
        Item("c", "basic", "s", table="facts", key_column="k", filter="cast(s AS int) > 0", default="none"),
    )
    result = compute_tag(catalog, Tag("t", (KEY, *items)))
    assert as_dict(result.frame) == {1: (5, 2.0, "5"), 2: (-1, -1.0, "none")} and not result.messages
    assert spark.conf.get("spark.sql.ansi.enabled") == "true"


def test_methods_get_parameters_and_source(spark):
    def over(df, params):
        return df.where(F.col("v") > params["low"]).select("k", "v")

    item = Item("v", "method", over, table="facts", type="double", params=(Param("low", "2", "int"),))
    out = compute_tag(tables(spark, [1, 2], [(1, 1.0), (2, 3.0)]), Tag("t", (KEY, item))).frame
    assert as_dict(out) == {1: 0.0, 2: 3.0}


def test_staging_for_key_and_item(spark):
    staged = Staging("big", "SELECT k, v FROM facts WHERE v > #low", (Param("low", "2"),))
    key = Item("k", "key", "SELECT k FROM big", key_kind="sql", staging=("big",))
    item = Item("n", "sql", "SELECT k, count(*) FROM big GROUP BY k", type="int", staging=("big",))
    out = compute_tag(tables(spark, [1], [(1, 1.0), (2, 3.0), (2, 4.0)]), Tag("t", (key, item), (staged,))).frame
    assert as_dict(out) == {2: 2}


def test_cells_round_trip(spark):
    df = spark.sql("SELECT 1 AS k, 5L AS i, 2.5D AS d, 'a' AS s, date'2024-01-02' AS t")
    cells = R.encode_cells(df)
    assert cells.first()[:] == ("1", "5", "2.5", "a", "1704153600000")
    back = R.decode_cells(cells, {"i": "int", "d": "double", "s": "string", "t": "date"}).first()
    assert back[:] == ("1", 5, 2.5, "a", dt.date(2024, 1, 2))


def test_truncate_and_drop(spark, prior):
    assert R.truncate(prior).count() == 0 and R.truncate(prior).columns == ["k", "v"]
    assert R.drop_column(prior, "v").columns == ["k"]


KEYS = st.integers(0, 6)
ROWS = st.lists(st.tuples(st.one_of(st.none(), KEYS), st.one_of(st.none(), st.integers(-5, 5).map(float))), max_size=12)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(people=st.lists(st.one_of(st.none(), KEYS), max_size=8), facts=ROWS, old=st.dictionaries(KEYS, st.integers(-5, 5).map(float), max_size=5))
def test_properties_against_brute_force(spark, people, facts, old):
    """Rows are the union of both key sets, keys are unique, values are as computed by hand, reruns change nothing."""
    catalog = tables(spark, people, facts)
    prior = spark.createDataFrame(list(old.items()), "k long, v double")
    best: dict[int, float] = {}
    for k, v in facts:
        if k is not None and v is not None:
            best[k] = max(v, best.get(k, v))
    keys = {p for p in people if p is not None}
    twice = Item("w", "formula", "#v * 2", type="double", params=(Param("v", "v", "double", "tagitem"),))
    for items in ((KEY, VALUE, twice), (KEY, twice, VALUE)):
        frame = compute_tag(catalog, Tag("t", items), prior).frame.select("k", "v", "w")
        rows = [tuple(r) for r in frame.collect()]
        want = {k: best.get(k, old.get(k, 0.0)) for k in keys | old.keys()}
        assert sorted(rows) == sorted((k, v, v * 2) for k, v in want.items())
    again = compute_tag(catalog, Tag("t", (KEY, VALUE)), frame.select("k", "v")).frame
    assert as_dict(again) == want
    assert as_dict(compute_tag(catalog, Tag("t", (KEY, VALUE))).frame) == {k: best.get(k, 0.0) for k in keys}
