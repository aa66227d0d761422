"""Results by key bucket: what a run reads, writes and leaves in place."""

from __future__ import annotations

import datetime as dt
import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tagloom import Catalog, DeltaStore, Item, Param, PathStore, PostProcess, Tag, compute_delta, run_tag
from tagloom.plans.delta import OLD, Snapshot, bucket_of, formula_mark

KEY = Item("k", "key", "k", table="facts", type="int", extract="incremental", increment_column="t")
VALUE = Item("v", "basic", "v", table="facts", key_column="k", type="double", extract="incremental", increment_column="t",
             post=PostProcess("number", max=50.0))
TEXT = Item("s", "sql", "SELECT k, s, t FROM facts", extract="incremental", increment_column="t", default="none")
TWICE = Item("w", "formula", "#v * 2", type="double", params=(Param("v", "v_ctr", "double", "tagitem"),))
TAG = Tag("t", (KEY, VALUE, TEXT, TWICE))


def day(n):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=n)


def tables(spark, rows):
    return Catalog(spark).add("facts", spark.createDataFrame(rows, "k long, v double, s string, t timestamp"))


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def files(store):
    return {f.split("/v=")[1] for f in store.read().inputFiles()}


@pytest.fixture
def store(spark, tmp_path):
    return DeltaStore(spark, str(tmp_path / "r"), 16)


def facts(n=400):
    return [(k, float(k), f"s{k}", day(0)) for k in range(n)]


def test_an_incremental_run_writes_the_buckets_of_its_keys_only(spark, store):
    old = facts()
    run_tag(tables(spark, old), TAG, store)
    before, snapshot = files(store), store.snapshot()
    assert store.version() == 1 and len(snapshot.folders) == 16
    earlier = store.read()
    # One key in a hundred of one bucket, and no key of any other.
    keys = spark.range(400).where(bucket_of(F.col("id"), 16) == 3).orderBy("id").collect()
    new = [(r.id, -1.0, "new", day(2)) for r in keys[: max(1, len(keys) // 100)]]
    catalog = tables(spark, old + new)
    planned = compute_delta(catalog, TAG, store, day(1))
    read = {f for f in planned.frame.inputFiles() if "/v=" in f}
    assert not planned.whole and read and all("tagloom_bucket=3/" in f for f in read)
    run_tag(catalog, TAG, store, day(1))
    after = files(store)
    assert {f for f in before if "bucket=3/" not in f} == {f for f in after if "bucket=3/" not in f}
    assert all(f.startswith("2/") for f in after if "bucket=3/" in f)
    # Readers of the earlier version see what they saw.
    assert rows(earlier.select("k", "v_ctr", "s", "w")) == [(k, v, s, 2 * v) for k, v, s, _ in sorted(old, key=repr)]
    changed = {r[0]: r for r in new}
    want = [(k, *changed.get(k, (k, float(k), f"s{k}"))[1:3]) for k in range(400)]
    assert rows(store.read().select("k", "v_ctr", "s")) == sorted(want, key=repr)


def test_a_run_without_changes_writes_no_rows(spark, store):
    catalog = tables(spark, facts(50))
    run_tag(catalog, TAG, store)
    before = files(store)
    result = compute_delta(catalog, TAG, store, None)  # a full run that finds the same values
    assert result.whole and store.publish(result.frame, result.mark) == set()
    run_tag(catalog, TAG, store, day(5))
    assert files(store) == before and store.version() == 3


def test_new_and_changed_keys_of_a_full_run(spark, store):
    full = Tag("t", tuple(replace(i, extract="full") for i in TAG.items))
    run_tag(tables(spark, facts(100)), full, store)
    later = [(k, v, s, t) for k, v, s, t in facts(102) if k != 7] + [(7, 7.5, None, day(0))]
    result = compute_delta(tables(spark, later), full, store)
    touched = store.publish(result.frame, result.mark)
    buckets = spark.range(102).where("id IN (7, 100, 101)").select(bucket_of(F.col("id"), 16)).distinct().collect()
    assert touched == {b[0] for b in buckets}
    found = {r.k: r for r in store.read().collect()}
    # The text of key 7 is no longer there, so its cell keeps the earlier one.
    assert len(found) == 102 and (found[7].v, found[7].s, found[7].w) == (7.5, "s7", 15.0) and found[101].s == "s101"


def test_changed_formulas_and_columns_reach_all_rows(spark, store):
    catalog = tables(spark, facts(60))
    run_tag(catalog, TAG, store)
    thrice = replace(TAG, items=(KEY, VALUE, TEXT, replace(TWICE, content="#v * 3")))
    run_tag(catalog, thrice, store, day(1))
    assert rows(store.read().select("k", "w")) == sorted([(k, 3.0 * k) for k in range(60)], key=repr)
    more = replace(thrice, items=(KEY, VALUE, Item("extra", type="int", default="4", table="facts", content="k", key_column="k",
                                                  extract="incremental", increment_column="t"), *thrice.items[2:]))
    run_tag(catalog, more, store, day(1))
    assert rows(store.read().select("k", "extra", "w")) == sorted([(k, 4, 3.0 * k) for k in range(60)], key=repr)
    # Another number of buckets rewrites everything once.
    wider = DeltaStore(spark, store.path, 5)
    run_tag(catalog, more, wider, day(1))
    assert wider.read().count() == 60 and len(wider.snapshot().folders) == 5


def test_old_folders_go_and_failed_writes_leave_the_version(spark, store, tmp_path):
    old = facts(40)
    run_tag(tables(spark, old), TAG, store)
    first = store.snapshot().folders
    for n in (2, 3):
        catalog = tables(spark, old + [(k, float(n), "x", day(n)) for k in range(40)])
        run_tag(catalog, TAG, store, day(n - 1))
    assert not any((tmp_path / "r" / f"v=1/tagloom_bucket={b}").exists() for b in first)
    assert store.snapshots(2)[1].read().count() == 40
    with pytest.raises(Exception, match="stop"):
        store.publish(store.read().withColumn("v", F.raise_error(F.lit("stop")).cast("double")))
    assert store.version() == 3 and store.read().count() == 40
    with pytest.raises(ValueError, match="cannot replace"):
        store.publish(store.read().drop("s"), whole=False)


@pytest.mark.parametrize("storage", ["table", "cell"])
def test_runs_equal_those_of_a_store_that_rewrites_everything(spark, tmp_path, storage):
    rng = random.Random(storage)
    delta, path = DeltaStore(spark, str(tmp_path / "d"), 7), PathStore(spark, str(tmp_path / "p"))
    tag, data = replace(TAG, storage=storage), []
    for n in range(4):
        for _ in range(30):
            k, v = rng.randrange(60), rng.choice([1.0, 60.0, None, float("nan")])
            data.append((k, v, rng.choice(["a", "", None, "b"]), day(n)))
        for store in (delta, path):
            run_tag(tables(spark, data), tag, store, day(n - 1) if n else None)
        assert rows(delta.read()) == rows(path.read())


def test_marks_tell_formulas_that_may_change(spark):
    mark = formula_mark(TAG)
    assert mark and mark == formula_mark(replace(TAG, name="other"))
    for content in ("#v * 3", ):
        assert formula_mark(replace(TAG, items=(KEY, VALUE, TEXT, replace(TWICE, content=content)))) not in (mark, None)
    for content in ("rand() * #v", "if(current_date() > date'2020-01-01', #v, 0)", "unix_millis(now())", lambda p: p["v"]):
        assert formula_mark(replace(TAG, items=(KEY, VALUE, replace(TWICE, content=content)))) is None


def test_fingerprints_tell_where_a_null_stands(spark):
    pair = spark.createDataFrame([(1, None, 5), (1, 5, None)], "k long, a int, b int")
    shot = Snapshot(spark, schema=pair.schema)
    a, b = (r for r in pair.select("*").collect())
    assert a != b
    assert shot.tracked().columns == ["k", "a", "b", *OLD]
    from tagloom.plans.delta import _fingerprint

    assert pair.select(*_fingerprint(pair.columns)).distinct().count() == 2


def test_empty_results(spark, store):
    run_tag(tables(spark, []), TAG, store)
    assert store.read().count() == 0 and store.snapshot().folders == {}
    run_tag(tables(spark, facts(3)), TAG, store, day(-1))
    assert rows(store.read().select("k")) == [(0,), (1,), (2,)]
