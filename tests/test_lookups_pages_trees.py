"""Dictionaries, pages, positions, category trees and grouped methods, with hot keys and exact copies."""

from __future__ import annotations

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tagloom import Catalog, GroupedMethod, SpecError
from tagloom.operators import lookup, methods, paging
from tagloom.operators import category
from tagloom.operators.category import category_ancestors, category_ancestors_of, category_paths, category_preorder
from tagloom.operators.lookup import code_map, decode, lookup_join, measured_bytes, multi_get, named_code_map
from tagloom.queries.extraction import _value_range


@pytest.fixture
def codes(spark):
    main = spark.createDataFrame([("c1", "sex"), ("c2", "kind")], "codeid string, codename string")
    items = spark.createDataFrame(
        [("c1", "1", "male"), ("c1", "2", "female"), ("c2", "1", "big"), ("c1", None, "odd")],
        "codeid string, itemvalue string, itemtext string",
    )
    return Catalog(spark).add("code_main", main).add("code_items", items)


def test_code_names_pick_their_catalog(spark, codes):
    empty = Catalog(spark).add("code_main", codes.table("code_main").limit(0)).add("code_items", codes.table("code_items"))
    for name, local, source in (("sex", codes, empty), ("local:sex", codes, empty), ("datasource:sex", empty, codes)):
        assert {tuple(r) for r in named_code_map(name, local, source).collect()} == {("1", "male"), ("2", "female")}
    assert code_map(codes.table("code_main"), codes.table("code_items"), "other").count() == 0
    with pytest.raises(SpecError):
        named_code_map("datasource:sex", codes)


def test_decode_keeps_unknown_codes(spark, codes):
    df = spark.createDataFrame([(1, 1), (2, 3), (3, None)], "k long, sex long")
    out = decode(df, "sex", named_code_map("sex", codes))
    assert {r["k"]: r["sex"] for r in out.collect()} == {1: "male", 2: "3", 3: None}
    kept = decode(df, "sex", named_code_map("sex", codes), "sex_text")
    assert {r["k"]: (r["sex"], r["sex_text"]) for r in kept.collect()}[1] == (1, "male")


@pytest.mark.parametrize("how", ["left", "inner", "left_semi"])
def test_split_lookup_equals_broadcast_lookup(spark, how):
    """One value holds most rows, many of them exact copies, and some rows have no value."""
    rows = spark.range(3000).select(
        F.when(F.col("id") % 3 > 0, F.lit(7)).when(F.col("id") % 9 == 0, F.lit(None)).otherwise(F.col("id") % 50).alias("v"),
        F.when(F.col("id") % 3 == 1, F.lit(-1)).otherwise(F.col("id")).alias("x"),
    ).repartition(6)
    lookup = spark.range(40).select(F.col("id").alias("v"), F.concat(F.lit("t"), "id").alias("text"))
    assert measured_bytes(lookup) > 40
    small = lookup_join(rows, "v", lookup, how)
    large = lookup_join(rows, "v", lookup, how, limit=0, heavy_values=5)
    assert "BroadcastHashJoin" in small._jdf.queryExecution().toString()
    assert "__salt" in large._jdf.queryExecution().toString()
    columns = small.columns
    assert large.select(columns).exceptAll(small).count() == 0 and small.exceptAll(large.select(columns)).count() == 0


def test_split_lookup_of_heavy_values_only(spark):
    """All rows have one of the heavy values, and the lookup lacks one of them."""
    rows = spark.range(4000).select((F.col("id") % 3).alias("v"))
    lookup = spark.range(2).select(F.col("id").alias("v"), F.lit("t").alias("text"))
    joined = lookup_join(rows, "v", lookup, limit=0)
    counts = {(r["v"], r["text"]): r["count"] for r in joined.groupBy("v", "text").count().collect()}
    assert counts == {(0, "t"): 1334, (1, "t"): 1333, (2, None): 1333}


@pytest.fixture
def eight_tasks(spark):
    """Every shuffle partition is a task of its own."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    for name, value in before.items():
        spark.conf.set(name, value)


@pytest.mark.parametrize("value", ["7", "cast(NULL AS int)"])
def test_salted_lookup_spreads_exact_copies_of_a_heavy_value(spark, eight_tasks, value):
    """All rows are the same row, or have no value at all."""
    rows = spark.range(0, 8000, 1, 32).selectExpr(f"{value} AS v", "1 AS x")
    lookup = spark.range(40).selectExpr("cast(id AS int) AS v", "id * 2 AS y")
    joined = lookup_join(rows, "v", lookup, limit=0)
    assert joined.where("y = 14").count() == (8000 if value == "7" else 0)
    share = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(share) == 8000 and max(share) <= 8000 / 2


def test_salted_lookup_reads_its_rows_once_beside_the_count(spark, eight_tasks):
    lines = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").select("l_suppkey", "l_quantity")
    lookup = spark.read.parquet("/root/testdata/sf0.001/supplier.parquet").selectExpr("s_suppkey AS l_suppkey", "s_name")
    joined = lookup_join(lines, "l_suppkey", lookup, limit=0)
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert plan.count("lineitem.parquet") == 1 and plan.count("Exchange hashpartitioning") == 2
    assert joined.count() == lines.count()


def test_long_key_lists_go_the_way_of_large_lookups(spark, eight_tasks, monkeypatch):
    rows = spark.range(0, 6000, 1, 16).selectExpr("if(id % 3 = 0, 7, id) AS k", "id AS x")
    monkeypatch.setattr(lookup, "measured_bytes", lambda frame: lookup.BROADCAST_BYTES + 1)
    keys = spark.range(3000).selectExpr("id AS k")
    found = multi_get(rows, "k", keys, ["x"])
    assert "__salt" in found._jdf.queryExecution().toString() and found.columns == ["k", "x"]
    assert found.count() == rows.join(keys, "k", "left_semi").count()


def test_multi_get(spark):
    df = spark.range(5000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"), F.lit(0).alias("other"))
    for keys in ([3, 9999], list(range(3, 4)) + list(range(6000, 8000)), spark.createDataFrame([(3,), (3,)], "x long")):
        out = multi_get(df, "k", keys, ["v"])
        assert out.columns == ["k", "v"] and [tuple(r) for r in out.collect()] == [(3, 6)]


@pytest.mark.parametrize("shallow", [10**6, 0])
def test_pages_of_any_depth(spark, shallow, monkeypatch):
    monkeypatch.setattr(paging, "SHALLOW_ROWS", shallow)
    df = spark.range(500).select((F.col("id") % 3).alias("g"), "id").repartition(7)
    want = sorted(((i % 3, i) for i in range(500)), key=lambda r: (-r[0], r[1]))
    for first, size in ((0, 5), (331, 9), (498, 10), (600, 5)):
        got = paging.grid_page(df, first, size, F.col("g").desc(), F.col("id")).collect()
        assert [tuple(r) for r in got] == want[first:first + size]


def test_table_page(spark):
    df = spark.range(50).selectExpr("id", "id % 2 AS odd", "'x' AS other")
    out = paging.table_page(df, ["id"], "odd = 1", 2, 3, F.col("id"))
    assert out.columns == ["id"] and [r[0] for r in out.collect()] == [5, 7, 9]
    assert paging.table_page(df, ["id"], None, 0, 0).count() == 50


def test_key_pages_are_in_byte_order(spark):
    df = spark.range(30)
    texts = sorted(str(i) for i in range(30))
    assert [r[0] for r in paging.key_page(df, "id", 10, 5).collect()] == texts[10:15]
    assert [r[0] for r in paging.key_page_from(df, "id", texts[10], 5).collect()] == texts[10:15]


def test_positions_of_empty_and_hot_groups(spark):
    assert paging.with_position(spark.range(0), F.col("id")).count() == 0
    df = spark.range(2000).select(F.when(F.col("id") % 3 == 0, F.col("id") % 11).otherwise(5).alias("g"), "id").repartition(8)
    got = {(r["g"], r["id"]): r["position"] for r in paging.with_position_in_group(df, "g", F.col("id").desc()).collect()}
    groups: dict[int, list[int]] = {}
    for i in range(2000):
        groups.setdefault(i % 11 if i % 3 == 0 else 5, []).append(i)
    assert got == {(g, i): n + 1 for g, ids in groups.items() for n, i in enumerate(reversed(ids))}


def test_pages_of_an_index_sort_nothing_again(spark, eight_tasks):
    df = spark.range(0, 20_000, 1, 6).selectExpr("id AS k", "id % 7 AS g", "concat('wide', id) AS text", "if(id % 5 = 0, NULL, id % 11) AS n")
    order = (F.col("g").desc(), F.col("n").asc_nulls_last(), F.col("k"))
    index = paging.OrderedIndex(df, "k", ["g", "n"], *order)
    want = [tuple(r) for r in df.orderBy(*order).collect()]
    assert index.count() == len(want)
    for first, size in ((0, 5), (7777, 20), (15_000, 3000), (19_990, 50), (20_000, 10), (3, 0)):
        assert [tuple(r) for r in index.page(first, size).collect()] == want[first : first + size]
    assert [tuple(r) for r in index.page_after(want[123][0], 4).collect()] == want[124:128]
    assert index.page_after(-1, 4).collect() == [] and index.page(5, 3).columns == df.columns
    plan = index.page(12_000, 30)._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and "Sort [" not in plan and "TakeOrderedAndProject" in plan
    assert "GreaterThan(position,12000)" in plan and "LessThanOrEqual(position,12030)" in plan
    index.release()


def test_wide_rows_stay_out_of_the_index(spark):
    df = spark.range(50).selectExpr("id AS k", "repeat('x', 1000) AS text")
    index = paging.OrderedIndex(df, "k", [], F.col("k").desc())
    assert index._index.columns == ["position", "key"]
    assert [r.k for r in index.page(48, 5).collect()] == [1, 0]


def test_count_where(spark):
    assert paging.count_where(spark.range(10), "id > 6").first()["n"] == 3
    assert paging.count_where(spark.range(10)).first()["n"] == 10


@pytest.fixture
def tree(spark):
    rows = [
        ("a", None, 1, "A"), ("b", "", 5, "B"), ("a1", "a", 1, "A1"), ("a2", "a", 9, "A2"), ("a11", "a1", 0, "A11"),
        ("lost", "nowhere", 1, "L"), ("x", "y", 1, "X"), ("y", "x", 1, "Y"),
    ]
    return spark.createDataFrame(rows, "id string, parent string, orderno int, name string")


def test_category_order(spark, tree):
    out = category_preorder(tree, "id", "parent", "orderno").orderBy("pos").collect()
    assert [(r["id"], r["depth"], r["pos"]) for r in out] == [("b", 0, 1), ("a", 0, 2), ("a2", 1, 3), ("a1", 1, 4), ("a11", 2, 5)]


def test_category_ancestors(spark, tree):
    out = category_ancestors(tree, "id", "parent", "orderno", "name")
    assert {r["id"]: r["path"] for r in out.collect()} == {"a": "A", "b": "B", "a1": "A/A1", "a2": "A/A2", "a11": "A/A1/A11"}


def test_deep_category_tree(spark):
    chain = spark.range(150).selectExpr("id", "if(id = 0, NULL, id - 1) AS parent", "0 AS orderno", "cast(id AS string) AS name")
    out = {r["id"]: r for r in category_paths(chain, "id", "parent", "orderno", "name").collect()}
    assert len(out) == 150 and out[149]["depth"] == 149
    assert out[149]["labels"] == [str(k) for k in range(150)]


def _forest(spark):
    """Chains of three below a root, a cycle, a category without its parent, and a self-parent."""
    rows = [("root", "", 1, "Root")]
    rows += [(f"{a}{n}", f"{chr(ord(a) - 1)}{n}" if a != "a" else "root", n, f"{a.upper()}{n}") for n in range(50) for a in "abc"]
    rows += [("x", "y", 1, "X"), ("y", "z", 1, "Y"), ("z", "x", 1, "Z"), ("lost", "gone", 1, "Lost"), ("own", "own", 1, "Own")]
    return spark.createDataFrame(rows, "id string, parent string, orderno int, name string")


@pytest.mark.parametrize("points", [1000, 3])
def test_ancestors_of_given_ids_equal_those_of_the_whole_tree(spark, monkeypatch, points):
    monkeypatch.setattr(category, "POINT_KEYS", points)
    forest = _forest(spark)
    ids = [*(f"c{n}" for n in range(0, 50, 7)), "b3", "root", "x", "lost", "own", "nowhere", "c7", None]
    paths = []
    found = category_ancestors_of(
        forest, spark.createDataFrame([(i,) for i in ids], "k string"), "id", "parent", "orderno", "name", paths=paths
    )
    whole = {r.id: r.path for r in category_ancestors(forest, "id", "parent", "orderno", "name").collect()}
    assert {r.id: r.path for r in found.collect()} == {i: whole[i] for i in ids if i in whole}
    assert found.count() == len({i for i in ids if i in whole}) and whole["c7"] == "Root/A7/B7/C7"
    assert len(paths) == 1
    none = category_ancestors_of(forest, spark.createDataFrame([], "k string"), "id", "parent", "orderno", "name")
    assert none.collect() == [] and none.columns == ["id", "path"]


def test_rounds_of_the_upward_walk_read_what_is_new_and_leave_nothing(spark, monkeypatch):
    read, kept = [], []
    write, free = category.written, category.emptied

    def watched(df, name, paths=None):
        out = write(df, name, paths)
        if name == "ancestors":
            read.append(sorted(r.id for r in out.collect()))
        kept.append(paths[-1])
        return out

    monkeypatch.setattr(category, "written", watched)
    monkeypatch.setattr(category, "emptied", lambda s, path: (kept.remove(path), free(s, path)))
    ids = spark.createDataFrame([("c1",), ("c2",), ("b2",), ("x",)], "k string")
    paths = []
    category_ancestors_of(_forest(spark), ids, "id", "parent", "orderno", "name", paths=paths).collect()
    # b2 is met in the first round and not read again; the cycle ends when it closes.
    assert read == [["b2", "c1", "c2", "x"], ["a2", "b1", "y"], ["a1", "root", "z"]]
    assert kept == paths and len(paths) == 1


def test_category_below_itself_is_named(spark):
    rows = [("a", None, 1), ("b", "a", 1), ("a", "b", 1)]
    looped = spark.createDataFrame(rows, "id string, parent string, orderno int")
    with pytest.raises(SpecError, match="category a "):
        category_preorder(looped, "id", "parent", "orderno")


def test_many_text_keys_on_a_number_column(spark):
    df = spark.range(6000).withColumn("v", F.col("id") * 2)
    for n in (3, 5000):
        keys = [str(k) for k in range(n)] + ["none", None]
        got = multi_get(df, "id", keys, ["v"]).collect()
        assert sorted((r["id"], r["v"]) for r in got) == [(k, 2 * k) for k in range(n)]
    assert multi_get(df, "id", [], ["v"]).count() == 0


def test_grouped_method_with_a_hot_key(spark):
    """The hot key spans many batches and partitions; every key still comes out once."""
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    try:
        df = spark.range(1500).select(
            F.when(F.col("id") % 3 > 0, F.lit(1)).otherwise(F.col("id") % 40).alias("user_id"),
            ((F.col("id") * 37) % 1009).cast("double").alias("value"),
            F.lit("unused").alias("wide"),
        ).repartition(9)
        got = sorted(tuple(r) for r in _value_range()(df, {}).collect())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    seen: dict[int, list[float]] = {}
    for i in range(1500):
        seen.setdefault(1 if i % 3 > 0 else i % 40, []).append(float(i * 37 % 1009))
    assert got == sorted((k, max(v) - min(v)) for k, v in seen.items())


def test_grouped_method_skips_missing_keys_and_empty_input(spark):
    df = spark.createDataFrame([(None, 1.0), (2, 5.0)], "user_id long, value double")
    assert [tuple(r) for r in _value_range()(df, {}).collect()] == [(2, 0.0)]
    assert _value_range()(df.where("false"), {}).count() == 0


def test_grouped_method_gets_parameters(spark):
    def count(pdf, params):
        return pdf.groupby("k", as_index=False).agg(n=("v", lambda v: int((v > params["low"]).sum())))

    def add(pdf, params):
        return pdf.groupby("k", as_index=False).agg(n=("n", "sum"))

    grouped = GroupedMethod(("k", "v"), "k long, n long", count, add, lambda: F.col("n") * 10)
    df = spark.createDataFrame([(1, 1.0), (1, 3.0), (1, 4.0)], "k long, v double")
    assert [tuple(r) for r in grouped(df, {"low": 2}).collect()] == [(1, 20)]


def _range_method():
    def partial(pdf, params):
        g = pdf.groupby("k")["v"]
        return pd.DataFrame({"k": list(g.groups), "lo": g.min().values, "hi": g.max().values})

    def merge(pdf, params):
        return pdf.groupby("k", as_index=False).agg({"lo": "min", "hi": "max"})

    return GroupedMethod(("k", "v"), "k long, lo double, hi double", partial, merge, "hi - lo")


def _third_on_one_key(spark, rows=30_000, parts=12):
    """A third of all rows on key 7, the others on keys of their own, some rows without a key."""
    key = F.expr("CASE WHEN id % 3 = 0 THEN 7 WHEN id % 1000 = 1 THEN NULL ELSE 1000 + id END")
    return spark.range(0, rows, 1, parts).select(key.alias("k"), F.col("id").cast("double").alias("v"))


def test_a_hot_key_of_a_grouped_method_sends_a_summary_per_task(spark, monkeypatch):
    grouped, df = _range_method(), _third_on_one_key(spark)
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")  # 25 batches a task
    monkeypatch.setattr(methods, "BUFFER_ROWS", 1000)
    try:
        partial, merge = (lambda rows: grouped.partial(rows, {})), (lambda rows: grouped.merge(rows, {}))
        summary = df.mapInPandas(methods._summaries(partial, merge), grouped.schema)
        sent = {r.k: r["count"] for r in summary.groupBy("k").count().collect()}
        # 2,500 rows a task, 1,667 of them on different keys: two flushes at most, so no more than two summaries a key and task.
        assert sent[7] <= 12 * 2 and None not in sent
        salted = summary.withColumn("__salt", F.pmod(F.spark_partition_id(), F.lit(methods.SALTS)))
        first = methods._merged(salted, [F.col("k"), F.col("__salt")], merge, grouped.schema)
        assert first.where("k = 7").count() <= min(12, methods.SALTS)
        found = {r.k: r.value for r in grouped(df, {}).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    want = {r.k: r.v for r in df.where("k IS NOT NULL").groupBy("k").agg((F.max("v") - F.min("v")).alias("v")).collect()}
    assert found == want


def test_summaries_are_merged_before_they_go_out(monkeypatch):
    monkeypatch.setattr(methods, "BUFFER_ROWS", 10)
    grouped = _range_method()
    task = methods._summaries(lambda rows: grouped.partial(rows, {}), lambda rows: grouped.merge(rows, {}))
    one_key = [pd.DataFrame({"k": [1, 1], "v": [float(n), -float(n)]}) for n in range(200)]
    assert [len(out) for out in task(iter(one_key))] == [1]
    many = [pd.DataFrame({"k": [2 * n, 2 * n + 1], "v": [0.0, 1.0]}) for n in range(50)]
    assert sum(len(out) for out in task(iter(many))) == 100
    assert list(task(iter([]))) == []
    assert list(task(iter([pd.DataFrame({"k": pd.Series([None], dtype="Int64"), "v": [1.0]})]))) == []
