"""Model runs: publishing, logging, high-water marks, failures while running, models from metadata tables."""

from __future__ import annotations

import datetime as dt
import json
import uuid

import pytest
from pyspark.sql import functions as F

from tagloom import (
    Catalog, Item, Model, Param, PathStore, PostProcess, RunLog, SpecError, Staging, TableStore, Tag, compute_tag, load_model,
    require_all, run_model,
)
from tagloom import DeltaStore
from tagloom.operators.result import drop_column, truncate
from tagloom.plans import model as model_module
from tagloom.plans.metadata import item_from_row, ordered_items, param_from_row
from tagloom.queries.profiles import _metadata
from tagloom.sources import staging as staging_module
from tagloom.streaming.runlog import messages_json

KEY = Item("k", "key", "k", table="people", type="int")
VALUE = Item("v", "basic", "v", table="facts", key_column="k", type="double")


@pytest.fixture
def catalog(spark):
    people = spark.createDataFrame([(1,), (2,)], "k long")
    facts = spark.createDataFrame(
        [(1, 3.0, "5", dt.datetime(2024, 1, 1)), (2, 4.0, "x", dt.datetime(2024, 1, 2))], "k long, v double, s string, t timestamp"
    )
    return Catalog(spark).add("people", people).add("facts", facts)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("kind", ["path", "table"])
def test_versions(spark, tmp_path, kind):
    store = PathStore(spark, str(tmp_path / "r")) if kind == "path" else TableStore(spark, f"r{uuid.uuid4().hex}", 4)
    assert store.read() is None
    for n in (1, 2, 3):
        prior = store.read()
        frame = spark.range(2).select(F.col("id").alias("k"), F.lit(n).alias("v"))
        if prior is not None:
            frame = frame.join(prior.select("k"), "k")
        store.publish(frame)
        assert rows(store.read()) == [(0, n), (1, n)] and store.version() == n


def test_a_failed_write_leaves_the_earlier_version(spark, tmp_path):
    store = PathStore(spark, str(tmp_path / "r"))
    store.publish(spark.range(2).withColumnRenamed("id", "k"))
    with pytest.raises(Exception, match="stop"):
        store.publish(spark.range(2).select(F.raise_error(F.lit("stop")).cast("int").alias("k")))
    assert store.version() == 1 and store.read().count() == 2
    store.publish(spark.range(3).withColumnRenamed("id", "k"))
    assert store.read().count() == 3


def test_bucketed_prior_result_joins_without_another_shuffle_of_its_rows(spark, catalog):
    store = TableStore(spark, f"b{uuid.uuid4().hex}")
    store.publish(spark.range(50).select(F.col("id").alias("k"), F.lit(1.0).alias("v")))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        frame = compute_tag(catalog, Tag("t", (KEY, VALUE)), store.read()).frame
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert rows(frame) == [(k, {1: 3.0, 2: 4.0}.get(k, 1.0)) for k in range(50)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # At most one exchange each for spine, all keys, and the item; none for the wide rows of the prior result.
    assert plan.count("Exchange hashpartitioning") <= 3 and "Bucketed: true" in plan


def test_bucketed_result_is_written_as_it_is_partitioned(spark, catalog):
    people = spark.range(2000).withColumnRenamed("id", "k")
    facts = people.select("k", F.col("k").cast("double").alias("v"))
    catalog.add("people", people).add("facts", facts)
    aligned, other = TableStore(spark, f"b{uuid.uuid4().hex}", 4), TableStore(spark, f"b{uuid.uuid4().hex}", 3)
    for store in (aligned, other):
        for _ in range(2):
            store.publish(compute_tag(catalog, Tag("t", (KEY, VALUE)), store.read()).frame)
        assert len(store.read().inputFiles()) <= 8
        assert rows(store.read()) == [(k, float(k)) for k in range(2000)]


@pytest.mark.parametrize("kind", ["path", "table"])
def test_truncated_and_narrowed_results_are_published(spark, tmp_path, kind):
    store = PathStore(spark, str(tmp_path / "r")) if kind == "path" else TableStore(spark, f"r{uuid.uuid4().hex}", 4)
    store.publish(spark.range(2).select(F.col("id").alias("k"), F.lit(1).alias("v"), F.lit(2).alias("w")))
    store.publish(drop_column(store.read(), "w"))
    assert rows(store.read()) == [(0, 1), (1, 1)]
    store.publish(truncate(store.read()))
    assert store.read().columns == ["k", "v"] and store.read().count() == 0


def test_items_that_fail_while_running_are_left_out(spark, catalog, tmp_path):
    group_mate = Item("bad_cast", "basic", "if(s = 'x', raise_error('no'), 1)", table="facts", key_column="k", type="int", default="-1")
    bad_sql = Item("bad_sql", "sql", "SELECT k, if(s = 'x', raise_error('no'), 1) FROM facts", type="int", default="-1")
    bad_formula = Item(
        "bad_formula", "formula", "if(#v > 3, raise_error('no'), 1)", type="int", params=(Param("v", "v", "double", "tagitem"),)
    )
    after = Item("after", "formula", "#b + 1", type="int", params=(Param("b", "bad_formula", "int", "tagitem"),))
    tag = Tag("t", (KEY, group_mate, VALUE, bad_sql, after, bad_formula))
    store, log = PathStore(spark, str(tmp_path / "r")), RunLog(spark, str(tmp_path / "log"))
    report = run_model(catalog, Model("m", (tag,)), lambda t: store, log)
    assert report.status == "failed"
    assert {m.split("item ")[1].split(":")[0] for m in report.messages} == {"bad_cast", "bad_sql", "bad_formula"}
    out = store.read()
    assert rows(out.select("k", "v", "bad_cast", "bad_sql", "bad_formula", "after")) == [(1, 3.0, -1, -1, 0, 1), (2, 4.0, -1, -1, 0, 1)]
    run = log.runs().first()
    assert run["status"] == "failed" and len(json.loads(run["messages"])) == 3 and log.last_success("m") is None


def test_a_failed_tag_does_not_stop_the_next(spark, catalog, tmp_path):
    no_key = Tag("no_key", (VALUE,))
    bad_spine = Tag("bad_spine", (Item("k", "key", "k", table="nowhere"), VALUE))
    good = Tag("good", (KEY, VALUE))
    stores = {}

    def store_for(tag):
        return stores.setdefault(tag.name, PathStore(spark, str(tmp_path / tag.name)))

    log = RunLog(spark, str(tmp_path / "log"))
    report = run_model(catalog, Model("m", (no_key, bad_spine, good), ("seen before",)), store_for, log)
    assert len(report.messages) == 3 and report.messages[0] == "seen before"
    assert rows(stores["good"].read()) == [(1, 3.0), (2, 4.0)] and stores["bad_spine"].read() is None


def test_the_high_water_mark_is_the_start_of_the_last_successful_run(spark, catalog, tmp_path):
    item = Item("v", "basic", "v", table="facts", key_column="k", type="double", extract="incremental", increment_column="t")
    store, log = PathStore(spark, str(tmp_path / "r")), RunLog(spark, str(tmp_path / "log"))
    model = Model("m", (Tag("t", (KEY, item)),))
    assert log.last_success("m") is None and log.rows().count() == 0
    assert run_model(catalog, model, lambda t: store, log, dt.datetime(2024, 1, 1, 12)).status == "success"
    assert log.last_success("m") == dt.datetime(2024, 1, 1, 12) and log.last_success("other") is None
    newer = spark.createDataFrame(
        [(1, 1.0, dt.datetime(2024, 1, 1)), (2, 9.0, dt.datetime(2024, 2, 1))], "k long, v double, t timestamp"
    )
    catalog.add("facts", newer)
    assert run_model(catalog, model, lambda t: store, log, dt.datetime(2024, 3, 1)).status == "success"
    assert rows(store.read()) == [(1, 3.0), (2, 9.0)]
    log.start("m", dt.datetime(2025, 1, 1))
    assert log.last_success("m") == dt.datetime(2024, 3, 1)
    assert sorted(r["status"] for r in log.runs().collect()) == ["running", "success", "success"]
    assert run_model(catalog, model, lambda t: store, log).status == "success"
    assert log.last_success("m") > dt.datetime(2026, 1, 1) or log.last_success("m").year >= 2024


def test_messages_are_appended_to_the_json_array():
    assert messages_json([]) is None and messages_json([], '["a"]') == '["a"]'
    assert json.loads(messages_json(["b", "c"], messages_json(["a"]))) == ["a", "b", "c"]


def test_run_settings_hold_for_one_run(spark, catalog, tmp_path):
    seen = []

    def watch(df, params):
        seen.append(spark.conf.get("spark.sql.shuffle.partitions"))
        return df.select("k", "v")

    tag = Tag("t", (KEY, Item("v", "method", watch, table="facts", type="double")))
    settings = {"configcontent": '{"spark.sql.shuffle.partitions": "3", "spark.driver.memory": "1g", "spark.own.key": "x"}'}
    log = RunLog(spark, str(tmp_path / "log"))
    report = run_model(catalog, Model("m", (tag,), config=settings), lambda t: PathStore(spark, str(tmp_path / "r")), log)
    assert report.status == "success" and seen == ["3"] and spark.conf.get("spark.sql.shuffle.partitions") == "8"


def test_a_run_frees_the_staging_queries_it_wrote(spark, catalog, tmp_path, monkeypatch):
    freed = []
    emptied = staging_module.emptied
    monkeypatch.setattr(staging_module, "emptied", lambda s, path: (freed.append(path), emptied(s, path)))
    items = tuple(Item(n, "sql", f"SELECT k, {n} FROM big", type="double", staging=("big",)) for n in ("v", "w"))
    tag = Tag("t", (KEY, *items), (Staging("big", "SELECT k, v, v * 2 AS w FROM facts"),))
    store = PathStore(spark, str(tmp_path / "r"))
    run_model(catalog, Model("m", (tag,)), lambda t: store, RunLog(spark, str(tmp_path / "log")))
    assert rows(store.read()) == [(1, 3.0, 6.0), (2, 4.0, 8.0)]
    assert len(freed) == 1 and spark.read.parquet(freed[0]).count() == 0


def test_require_all(spark, catalog):
    tag = Tag("t", (KEY, Item("bad", "sql", "SELECT x")))
    with pytest.raises(SpecError, match="bad"):
        require_all(compute_tag(catalog, tag), tag)


def test_metadata_rows():
    item = item_from_row(
        {
            "itemanothername": "v", "itemtype": "BASIC", "itemcontent": "c", "returntype": "odd", "extracttype": 3,
            "itemattribute": "-", "postprocessingtype": "weight", "postprocessing": '{"standard": 2}', "keytype": None,
            "stagingtableguids": "s1,s9",
        },
        staging_names={"s1": "stage"},
    )
    assert (item.kind, item.type, item.extract, item.lower_is_better, item.staging) == ("basic", "string", "reload", True, ("stage",))
    assert item.post == PostProcess("weight", standard=2.0)
    assert item_from_row({"itemanothername": "v", "itemtype": "???", "extracttype": None}).kind == "basic"
    assert param_from_row({"paramname": "p", "paramvalue": "1", "accesstype": "odd"}) == Param("p", "1", None, "constant")


def test_model_from_metadata_tables(spark):
    metadata = _metadata(spark)
    model = load_model(metadata, "m1")
    (tag,) = model.tags
    assert [i.name for i in tag.items] == ["cust_id", "n_closed", "bal", "score"]
    assert tag.staging[0].params == (Param("st", "F"),) and tag.storage == "table"
    with pytest.raises(SpecError):
        load_model(metadata, "m2")


def test_item_order(spark):
    categories = spark.createDataFrame(
        [("c1", None, 1), ("c2", None, 2), ("c3", "c1", 1)], "itemcategoryguid string, parentguid string, orderno int"
    )
    items = spark.createDataFrame(
        [("a", "c1", 1, 1), ("b", "c1", 2, 1), ("c", "c2", 1, 1), ("d", "c3", 1, 0), ("e", "gone", 1, 1)],
        "itemanothername string, itemcategoryguid string, orderno int, isenabled int",
    )

    def names(*args):
        return [r["itemanothername"] for r in ordered_items(items, categories, *args).collect()]

    assert names() == ["c", "b", "a"] and names(["a", "d"]) == ["a"] and names(None, False) == ["c", "b", "a", "d"]


def test_unusable_tags_of_a_model_are_listed(spark):
    metadata = _metadata(spark)
    links = spark.createDataFrame([("m1", "gone", 2), ("m1", "t1", 1)], "modelguid string, tagguid string, orderno int")
    model = load_model(metadata.scoped().add("model_tag", links), "m1")
    assert [t.name for t in model.tags] == ["customer_spend"] and "gone" in model.problems[0]


def test_messages_are_kept_when_a_run_never_ends(spark, tmp_path):
    log = RunLog(spark, str(tmp_path / "log"))
    started = log.now()
    run = log.start("m", started)
    log.append(run, "m", started, ["a"])
    log.append(run, "m", started, [])
    log.append(run, "m", started, ["b", "c"])
    row = log.runs().first()
    assert (row["status"], row["messages"]) == ("running", '["a", "b", "c"]')
    log.finish(run, "m", started)
    row = log.runs().first()
    assert (row["status"], row["messages"]) == ("failed", '["a", "b", "c"]')


def test_path_store_frees_older_versions(spark, tmp_path):
    store = PathStore(spark, str(tmp_path / "r"))
    for n in range(1, 5):
        store.publish(spark.range(n * 100))
    assert store.read().count() == 400
    size = lambda v: sum(f.stat().st_size for f in (tmp_path / "r" / f"v={v}").glob("*.parquet"))
    assert size(1) < size(3) and size(2) < size(3) and spark.read.parquet(str(tmp_path / "r" / "v=3")).count() == 300


def test_interleaved_writers_keep_all_messages(spark, tmp_path):
    one, two = (RunLog(spark, str(tmp_path / "log")) for _ in range(2))
    started = one.now()
    run = one.start("m", started)
    want = []
    for n in range(3):
        for name, log in (("one", one), ("two", two)):
            log.append(run, "m", started, [f"{name} {n} a", f'{name} {n} "b", é'])
            want += [f"{name} {n} a", f'{name} {n} "b", é']
    two.finish(run, "m", started, ["end of two"])
    one.append(run, "m", started, ["late"])
    row = one.runs().first()
    assert row["status"] == "failed" and json.loads(row["messages"]) == [*want, "end of two", "late"]
    assert row["messages"] == json.dumps([*want, "end of two", "late"], ensure_ascii=False)
    # A later run with more text in its messages is not the newer state of this one.
    other = two.start("m", started)
    two.finish(other, "m", started)
    assert {r.run_id: r.status for r in two.runs().collect()} == {run: "failed", other: "success"}


def test_appending_reads_nothing_and_takes_one_job(spark, tmp_path):
    log = RunLog(spark, str(tmp_path / "log"))
    spark.sparkContext.setJobGroup("log-jobs", "")
    try:
        run = log.start("m", dt.datetime(2024, 1, 1))
        log.append(run, "m", dt.datetime(2024, 1, 1), ["a", "b"])
        log.finish(run, "m", dt.datetime(2024, 1, 1))
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("log-jobs")) == 3
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_compaction_keeps_every_row_once(spark, tmp_path, monkeypatch):
    log = RunLog(spark, str(tmp_path / "log"))
    assert log.compact() == []
    started = log.now()
    runs = [log.start("m", started) for _ in range(3)]
    for run in runs[:2]:
        log.append(run, "m", started, ["x", "y"])
        log.finish(run, "m", started)
    before = sorted(map(tuple, log.runs().collect()))
    assert log.compact(files=2) == []  # today's folder is still written to
    today = log._today()
    monkeypatch.setattr(RunLog, "_today", lambda self: "9999-12-31")
    assert log.compact(files=100) == [] and log.compact(files=2) == [today]
    files = list((tmp_path / "log" / f"day={today}").glob("*.parquet"))
    assert len(files) == 1 and sorted(map(tuple, log.runs().collect())) == before
    # A job that dies after writing the new file leaves rows twice, which readers take once.
    spark.read.parquet(str(files[0])).write.mode("append").parquet(str(tmp_path / "log" / f"day={today}"))
    assert sorted(map(tuple, log.runs().collect())) == before and log.last_success("m") is None


@pytest.mark.parametrize("where", [0, 13, 16, 31])
def test_one_fault_in_32_parts_takes_six_jobs(spark, monkeypatch, where):
    jobs = []
    run = model_module._runs
    monkeypatch.setattr(model_module, "_runs", lambda frames: (jobs.append(len(frames)), run(frames))[1])
    frame = lambda n: spark.range(2).select(F.when(F.lit(n == where), F.raise_error(F.lit(f"no {n}"))).otherwise(F.col("id")))
    found = model_module.faults(range(32), frame)
    assert [p for p, _ in found] == [where] and f"no {where}" in str(found[0][1]) and len(jobs) <= 6


def test_all_faults_are_found(monkeypatch):
    import random

    rng = random.Random(4)
    for n in (*range(0, 9), 33):
        for _ in range(30):
            bad, jobs = {k for k in range(n) if rng.random() < rng.choice([0, 0.1, 0.6, 1])}, []

            def runs(frames):
                jobs.append(frames)
                first = next((k for k in frames if k in bad), None)
                return None if first is None else ValueError(first)

            monkeypatch.setattr(model_module, "_runs", runs)
            found = model_module.faults(range(n), lambda k: k)
            assert {p for p, _ in found} == bad and all(e.args[0] == p for p, e in found)
            assert len(jobs) <= len(bad) * (n.bit_length() + 1) + n.bit_length() + 1


def test_the_report_counts_rows_per_item(spark, catalog, tmp_path):
    some = Item("some", "sql", "SELECT k, v FROM facts WHERE k = 2 UNION ALL SELECT 77, 1", type="double")
    none = Item("none", "sql", "SELECT k, v FROM facts WHERE k > 99", type="double")
    bad = Item("bad", "sql", "SELECT nothing FROM facts", type="double")
    tags = (Tag("a", (KEY, VALUE, some, none, bad)), Tag("b", (KEY, VALUE)), Tag("c", (VALUE,)))
    stores = {"a": PathStore(spark, str(tmp_path / "a")), "b": DeltaStore(spark, str(tmp_path / "b"), 4)}
    log = RunLog(spark, str(tmp_path / "log"))
    report = run_model(catalog, Model("m", tags), lambda t: stores[t.name], log)
    assert report.counts == {"a": {"": 2, "v": 2, "some": 1, "none": 0}, "b": {"": 2, "v": 2}}
    assert report.seconds.keys() == {"a", "b", "c"} and len(report.messages) == 2
    again = run_model(catalog, Model("m", tags[:2]), lambda t: stores[t.name], log)
    assert again.counts["b"] == {"": 2, "v": 2}
