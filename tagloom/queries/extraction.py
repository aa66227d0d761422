"""Key, basic, SQL and method items, invalid values, staging."""

from __future__ import annotations

from dataclasses import replace

import pandas as pd
from pyspark.sql import functions as F

from ..operators.items import basic_frame, basic_pairs, declared_pairs, key_spine, one_per_key, sql_pairs
from ..operators.methods import GroupedMethod, method, method_result, register_grouped
from ..operators.values import distinct_pairs
from ..spec import Item, Param, Staging, Tag
from .common import CUSTOMER, ORDERING_CUSTOMER, USER, Query, at, catalog, customer_tag, result_of


def key_basic(spark, folder):
    return key_spine(catalog(spark, folder), replace(CUSTOMER, filter="c_acctbal > 0"))


def key_sql(spark, folder):
    key = Item("cust_id", "key", "SELECT o_custkey FROM orders WHERE o_totalprice > 300000", key_kind="sql")
    return key_spine(catalog(spark, folder), key)


def key_incremental(spark, folder):
    key = replace(ORDERING_CUSTOMER, extract="incremental", increment_column="o_orderdate")
    return key_spine(catalog(spark, folder), key, at("2001-07-01"))


def _order_item(name: str, column: str, **options) -> Item:
    return Item(name, "basic", column, table="orders", key_column="o_custkey", **options)


def basic_item_distinct(spark, folder):
    item = _order_item("priority", "o_orderpriority", filter="o_orderstatus = 'F'")
    return distinct_pairs(basic_pairs(catalog(spark, folder), CUSTOMER, item))


def basic_item_max(spark, folder):
    item = _order_item("top_price", "o_totalprice", filter="o_orderstatus = 'F'", type="double")
    return basic_frame(catalog(spark, folder), CUSTOMER, [item])


def basic_item_latest(spark, folder):
    item = _order_item(
        "last_price", "o_totalprice", increment_column="o_orderdate", duplicates="latest", type="double"
    )
    return basic_frame(catalog(spark, folder), CUSTOMER, [item])


def basic_item_incremental(spark, folder):
    item = _order_item(
        "new_top", "o_totalprice", increment_column="o_orderdate", extract="incremental", type="double"
    )
    return basic_frame(catalog(spark, folder), CUSTOMER, [item], at("2001-01-01"))


def basic_items_shared_scan(spark, folder):
    """Three items of one table and key column: one scan and one aggregation answer them all."""
    tag = customer_tag(
        _order_item("top_price", "o_totalprice", type="double"),
        _order_item("top_urgent", "o_totalprice", filter="o_orderpriority = '1-URGENT'", type="double"),
        _order_item("last_status", "o_orderstatus", increment_column="o_orderdate", duplicates="latest", default="none"),
    )
    return result_of(spark, folder, tag)


def basic_item_aggregates(spark, folder):
    """Counts and totals of lines under filters of their own: one scan and one aggregation answer all items."""
    lines = lambda name, content, **more: Item(
        name, "basic", content, table="lineitem", key_column="l_suppkey", **more
    )
    key = Item("supp_id", "key", "s_suppkey", table="supplier", type="int")
    tag = Tag(
        "supplier",
        (
            key,
            lines("n_lines", "1", type="int", duplicates="count"),
            lines("n_returned", "l_orderkey", type="int", duplicates="count", filter="l_returnflag = 'R'"),
            lines("n_odd", "if(l_linenumber = 2, NULL, 'x')", type="int", duplicates="count", default="-1"),
            lines("quantity", "l_quantity", type="double", duplicates="sum"),
            lines("late", "l_linenumber", type="int", duplicates="sum", filter="l_shipdate > date'2001-10-01'", default="-1"),
            lines("dearest", "l_extendedprice", type="double"),
        ),
    )
    return result_of(spark, folder, tag)


def _sql(spark, folder, item, watermark=None):
    return one_per_key(sql_pairs(catalog(spark, folder), CUSTOMER, item, watermark), CUSTOMER, item)


def sql_item_latest(spark, folder):
    """A full SQL item of which the value with the latest third column counts."""
    text = "SELECT o_custkey, o_totalprice, o_orderdate FROM orders"
    return _sql(spark, folder, Item("last_price", "sql", text, type="double", duplicates="latest"))


def sql_item_rollup(spark, folder):
    """Grand totals, totals per customer and their parts in one grouping; the largest count of a customer is its total."""
    text = """
    SELECT o_custkey, n FROM (
      SELECT o_custkey, o_orderstatus, count(*) AS n FROM orders GROUP BY ROLLUP (o_custkey, o_orderstatus)
    ) WHERE o_custkey IS NOT NULL
    """
    return _sql(spark, folder, Item("most", "sql", text, type="int"))


def staging_scope(spark, folder):
    """Two tags whose staging queries have the same name and different SQL."""
    found = []
    for tag, status in (("a", "O"), ("b", "F")):
        staging = Staging("counted", f"SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderstatus = '{status}' GROUP BY 1")
        item = Item("n", "sql", "SELECT k, n FROM counted", type="double", default="-1", staging=("counted",))
        frame = result_of(spark, folder, customer_tag(item, staging=(staging,)), "cust_id", "n")
        found.append(frame.where("n >= 0").select(F.lit(tag).alias("tag"), "cust_id", "n"))
    return found[0].unionByName(found[1])


def sql_item(spark, folder):
    text = """
    SELECT o_custkey, sum(n) FROM orders JOIN
      (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_orderkey)
      ON l_orderkey = o_orderkey
    GROUP BY o_custkey
    """
    return _sql(spark, folder, Item("n_returned", "sql", text, type="int"))


def sql_item_params(spark, folder):
    text = """
    SELECT o_custkey, count(*) FROM orders
    WHERE o_totalprice > #min AND o_orderstatus = '#min_status' GROUP BY o_custkey
    """
    params = (Param("min", "200000"), Param("min_status", "O"))
    return _sql(spark, folder, Item("n_big", "sql", text, type="int", params=params))


def sql_item_incremental(spark, folder):
    item = Item(
        "n_orders",
        "sql",
        "SELECT o_custkey, count(*), max(o_orderdate) AS last_dt FROM orders GROUP BY o_custkey",
        type="int",
        extract="incremental",
        increment_column="last_dt",
    )
    return _sql(spark, folder, item, at("2001-07-01"))


@method("event_types_per_user")
def event_types_per_user(df, params):
    """Number of different event types of every user."""
    return df.groupBy("user_id").agg(F.count_distinct("event_type"))


def method_dataframe(spark, folder):
    item = Item("n_types", "method", "event_types_per_user", table="events", type="int")
    return one_per_key(declared_pairs(method_result(catalog(spark, folder), item), USER, item), USER, item)


def _value_range() -> GroupedMethod:
    # Inner functions travel to the Python workers by value, so these need no installed package.
    def bounds(pdf: pd.DataFrame, params) -> pd.DataFrame:
        return pdf.groupby("user_id", as_index=False).agg(low=("value", "min"), high=("value", "max"))

    def merge(pdf: pd.DataFrame, params) -> pd.DataFrame:
        return pdf.groupby("user_id", as_index=False).agg(low=("low", "min"), high=("high", "max"))

    return GroupedMethod(
        columns=("user_id", "value"),
        schema="user_id long, low double, high double",
        partial=bounds,
        merge=merge,
        value="high - low",
    )


register_grouped("value_range_per_user", _value_range())


def method_grouped(spark, folder):
    item = Item("value_range", "method", "value_range_per_user", table="events", type="double")
    return one_per_key(declared_pairs(method_result(catalog(spark, folder), item), USER, item), USER, item)


_SPOILED = Item(
    "tag_value",
    "sql",
    """
    SELECT user_id, CASE event_type WHEN 'error' THEN 'NaN' WHEN 'view' THEN '' WHEN 'click' THEN NULL
                                    ELSE event_type END
    FROM events
    """,
)


def exclude_invalid(spark, folder):
    return distinct_pairs(sql_pairs(catalog(spark, folder), USER, _SPOILED))


def exclude_invalid_compat(spark, folder):
    return distinct_pairs(sql_pairs(catalog(spark, folder), USER, _SPOILED, mode="compat"))


_SHIPPED = Staging(
    "shipped",
    """
    SELECT o_custkey AS k, rev, n FROM orders JOIN
      (SELECT l_orderkey, sum(l_quantity) AS rev, count(*) AS n FROM lineitem WHERE l_linestatus = '#status'
       GROUP BY l_orderkey)
      ON l_orderkey = o_orderkey
    """,
    (Param("status", "O"),),
)


def staging_item(spark, folder):
    revenue = Item("revenue", "sql", "SELECT k, sum(rev) FROM shipped GROUP BY k", type="double", staging=("shipped",))
    key = Item("cust_id", "key", "SELECT k FROM shipped", key_kind="sql", staging=("shipped",))
    return result_of(spark, folder, Tag("shipping", (key, revenue), (_SHIPPED,)))


def staging_shared(spark, folder):
    """A staging query that two items read: written once, with columns still pruned by each reader."""
    revenue = Item("revenue", "sql", "SELECT k, sum(rev) FROM shipped GROUP BY k", type="double", staging=("shipped",))
    lines = Item("n_lines", "sql", "SELECT k, sum(n) FROM shipped GROUP BY k", type="int", staging=("shipped",))
    return result_of(spark, folder, customer_tag(revenue, lines, staging=(_SHIPPED,)))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        key_basic,
        key_sql,
        key_incremental,
        basic_item_distinct,
        basic_item_max,
        basic_item_latest,
        basic_item_incremental,
        basic_items_shared_scan,
        basic_item_aggregates,
        sql_item,
        sql_item_latest,
        sql_item_rollup,
        staging_scope,
        sql_item_params,
        sql_item_incremental,
        method_dataframe,
        method_grouped,
        exclude_invalid,
        exclude_invalid_compat,
        staging_item,
        staging_shared,
    )
}
