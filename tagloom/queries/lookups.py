"""Code dictionaries, pages, counts, point reads, categories, the run log."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import category, lookup, paging
from ..plans.metadata import ordered_items
from ..sources import Catalog
from ..streaming.highwater import last_success
from .common import Query, catalog


def _codes(tables: Catalog) -> Catalog:
    """Suppliers of each nation as one dictionary per nation."""
    return Catalog(tables.spark).add(
        "code_main", tables.table("nation").selectExpr("n_nationkey AS codeid", "n_name AS codename")
    ).add(
        "code_items",
        tables.table("supplier").selectExpr("s_nationkey AS codeid", "s_suppkey AS itemvalue", "s_name AS itemtext"),
    )


def code_map(spark, folder):
    return lookup.named_code_map("local:NATION_9", _codes(catalog(spark, folder)))


def code_decode(spark, folder):
    tables = catalog(spark, folder)
    codes = tables.table("nation").selectExpr("cast(n_nationkey AS string) AS itemvalue", "n_name AS itemtext")
    rows = tables.table("customer").selectExpr("c_custkey AS cust_id", "c_nationkey AS nation")
    return lookup.decode(rows, "nation", codes)


def code_decode_lines(spark, folder):
    """Suppliers of all order lines decoded through one nation's dictionary; unknown codes stay."""
    tables = catalog(spark, folder)
    codes = lookup.named_code_map("datasource:NATION_9", Catalog(spark), _codes(tables))
    rows = tables.table("lineitem").selectExpr("l_orderkey", "l_linenumber", "l_suppkey AS supplier")
    return lookup.decode(rows, "supplier", codes)


def page_with_tiebreak(spark, folder):
    customers = catalog(spark, folder).table("customer").select("c_custkey", "c_mktsegment")
    return paging.grid_page(customers, 40, 20, F.col("c_mktsegment").desc(), F.col("c_custkey"))


def page_with_condition(spark, folder):
    orders = catalog(spark, folder).table("orders")
    order = (F.col("o_totalprice").desc(), F.col("o_orderkey"))
    return paging.table_page(orders, ["o_orderkey", "o_totalprice"], "o_orderstatus = 'F'", 30, 15, *order)


def row_positions(spark, folder):
    """Position of every order by falling price: what a page of any depth is cut from."""
    orders = catalog(spark, folder).table("orders").select("o_orderkey", "o_totalprice")
    return paging.with_position(orders, F.col("o_totalprice").desc(), F.col("o_orderkey")).select("o_orderkey", "position")


def deep_pages(spark, folder):
    """Two pages of wide rows deep in one order, cut from an index that is built once."""
    orders = catalog(spark, folder).table("orders")
    by_price = (F.col("o_totalprice").desc(), F.col("o_orderkey"))
    index = paging.OrderedIndex(orders, "o_orderkey", ["o_totalprice"], *by_price)
    first = index.page(500, 40)
    return first.unionByName(index.page(1200, 30)).select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")


def key_page(spark, folder):
    return paging.key_page(catalog(spark, folder).table("customer"), "c_custkey", 100, 10)


def key_page_from(spark, folder):
    return paging.key_page_from(catalog(spark, folder).table("customer"), "c_custkey", "109", 10)


def count_where(spark, folder):
    return paging.count_where(catalog(spark, folder).table("orders"), "o_orderstatus = 'F'")


def multi_get(spark, folder):
    customers = catalog(spark, folder).table("customer")
    return lookup.multi_get(customers, "c_custkey", [1, 5, 7, 999999], ["c_name", "c_acctbal"])


def multi_get_frame(spark, folder):
    """Customers looked up by the keys of another frame."""
    tables = catalog(spark, folder)
    keys = tables.table("orders").where("o_totalprice > 490000").select("o_custkey")
    return lookup.multi_get(tables.table("customer"), "c_custkey", keys, ["c_name"])


def watermark_latest(spark, folder):
    events = catalog(spark, folder).table("events")
    return last_success(
        events, F.col("event_type"), status=F.col("value") < 100, operated_at=F.col("ts")
    )


def runlog_messages(spark, folder):
    """Messages of every run in order, numbered; a run of any length is spread over many tasks."""
    events = catalog(spark, folder).table("events")
    messages = events.select(F.col("user_id").alias("run_id"), F.col("event_id").cast("string").alias("msg"), "event_id")
    return paging.with_position_in_group(messages, "run_id", F.col("event_id"), name="seq").select("run_id", "seq", "msg")


def _tree(tables: Catalog):
    """Regions, their nations and their customers as one category tree."""
    region = tables.table("region").selectExpr(
        "concat('r', r_regionkey) AS id", "'' AS parent", "r_regionkey AS orderno", "r_name AS name"
    )
    nation = tables.table("nation").selectExpr(
        "concat('n', n_nationkey) AS id", "concat('r', n_regionkey) AS parent", "n_nationkey AS orderno", "n_name AS name"
    )
    customer = tables.table("customer").selectExpr(
        "concat('c', c_custkey) AS id", "concat('n', c_nationkey) AS parent", "c_custkey AS orderno", "c_name AS name"
    )
    return region.unionByName(nation).unionByName(customer)


def category_preorder(spark, folder):
    return category.category_preorder(_tree(catalog(spark, folder)), "id", "parent", "orderno")


def category_ancestors(spark, folder):
    return category.category_ancestors(_tree(catalog(spark, folder)), "id", "parent", "orderno", "name")


def category_ancestors_of(spark, folder):
    """Paths of the customers in debt, and of their nations: the tree is walked upward from them."""
    tables = catalog(spark, folder)
    poor = tables.table("customer").where("c_acctbal < 0")
    ids = poor.selectExpr("concat('c', c_custkey) AS x").union(poor.selectExpr("concat('n', c_nationkey)"))
    return category.category_ancestors_of(_tree(tables), ids, "id", "parent", "orderno", "name")


def item_order(spark, folder):
    """Suppliers as items of their nation, in the order in which a tag runs its items."""
    tables = catalog(spark, folder)
    categories = _tree(tables).selectExpr("id AS itemcategoryguid", "parent AS parentguid", "orderno")
    items = tables.table("supplier").selectExpr(
        "concat('n', s_nationkey) AS itemcategoryguid",
        "s_name AS itemanothername",
        "s_suppkey AS orderno",
        "if(s_acctbal > 0, 1, 0) AS isenabled",
    )
    return ordered_items(items, categories).select("category_pos", "orderno", "itemanothername")


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        code_map,
        code_decode,
        code_decode_lines,
        page_with_tiebreak,
        page_with_condition,
        row_positions,
        deep_pages,
        key_page,
        key_page_from,
        count_where,
        multi_get,
        multi_get_frame,
        watermark_latest,
        runlog_messages,
        category_preorder,
        category_ancestors,
        category_ancestors_of,
        item_order,
    )
}
