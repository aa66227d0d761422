"""What the physical plans look like: shuffles, pushed filters, pruned columns, no Python workers."""

from __future__ import annotations

import pytest

from tagloom.queries import queries

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture
def plan_of(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield lambda name: queries()[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def shuffles(plan):
    return plan.count("Exchange hashpartitioning") + plan.count("Exchange rangepartitioning") + plan.count("SinglePartition")


@pytest.mark.parametrize(
    "name, expected",
    [
        ("basic_item_max", 1),
        ("basic_item_latest", 1),
        ("basic_items_shared_scan", 2),  # spine and one aggregation for three items
        ("formula_chain", 3),  # spine and the two items the formula needs
        ("post_weight_positive", 1),
        ("user_profile", 1),  # the spine, two counts and last_type share one scan
        ("customer_profile", 8),  # spine, three items of orders in one, and two SQL items with their joins
        ("basic_item_aggregates", 2),  # spine and one aggregation for six items
        ("save_update_existing", 2),
        ("formula_coerce_negative_compat", 1),  # spine and item share one scan
        ("init_defaults", 1),
    ],
)
def test_shuffle_counts(plan_of, name, expected):
    assert shuffles(plan_of(name)) == expected


@pytest.mark.parametrize("name", [n for n in queries() if n.startswith(("formula_", "post_")) or n.endswith("_profile")])
def test_no_python_workers(plan_of, name):
    plan = plan_of(name)
    assert "Python" not in plan and "InPandas" not in plan and "InArrow" not in plan


def test_filters_and_columns_reach_the_scan(plan_of):
    plan = plan_of("basic_item_incremental")
    assert "GreaterThan(o_orderdate" in plan
    assert "ReadSchema: struct<o_custkey:bigint,o_totalprice:double,o_orderdate:timestamp_ntz>" in plan
    assert "In(c_custkey, [1,5,7,999999])" in plan_of("multi_get")


@pytest.mark.parametrize(
    "name, table, scans", [("customer_profile", "orders", 2), ("user_profile", "events", 1), ("basic_item_aggregates", "lineitem", 1)]
)
def test_scan_counts(plan_of, name, table, scans):
    assert plan_of(name).count(f"/{table}.parquet") == scans


def test_no_cross_joins(plan_of):
    for name in ("customer_profile", "two_pass_incremental", "code_decode", "cell_storage"):
        plan = plan_of(name)
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan
