"""Specifications several queries share."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..plans.tag import compute_tag, require_all
from ..sources import Catalog
from ..spec import Item, Param, PostProcess, Staging, Tag

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()

Query = Callable[[SparkSession, str], DataFrame]


def catalog(spark: SparkSession, folder: str) -> Catalog:
    return Catalog.parquet(spark, folder, TABLES)


def at(text: str) -> dt.datetime:
    return dt.datetime.fromisoformat(text)


CUSTOMER = Item("cust_id", "key", "c_custkey", table="customer", type="int")
ORDERING_CUSTOMER = Item("cust_id", "key", "o_custkey", table="orders", type="int")
USER = Item("user_id", "key", "user_id", table="events", type="int")

N_ORDERS = Item("n_orders", "sql", "SELECT o_custkey, count(*) FROM orders GROUP BY o_custkey", type="int")
N_OPEN = Item(
    "n_open",
    "sql",
    "SELECT o_custkey, count(*) FROM orders WHERE o_orderstatus = '#status' AND o_orderdate > #since GROUP BY o_custkey",
    type="int",
    params=(Param("status", "O"), Param("since", "1999-01-01 00:00:00", "date")),
)
TOTAL = Item("total", "basic", "o_totalprice", table="orders", key_column="o_custkey", type="double")

# Lines are summed per order before they meet the orders, so neither side of the join repeats a key.
RETURNED_QTY = Item(
    "returned_qty",
    "sql",
    """
    SELECT o_custkey, sum(q) FROM orders JOIN
      (SELECT l_orderkey, sum(l_quantity) AS q FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_orderkey)
      ON l_orderkey = o_orderkey
    GROUP BY o_custkey
    """,
    type="double",
)


def tagitem(name: str, column: str, type: str) -> Param:
    """Formula parameter bound to a column of the result."""
    return Param(name, column, type, "tagitem")


def customer_tag(*items: Item, **options) -> Tag:
    return Tag("customer", (CUSTOMER, *items), **options)


def base_tag(*items: Item, **options) -> Tag:
    """Order counts and the top price per customer, with further items on top."""
    return customer_tag(N_ORDERS, N_OPEN, TOTAL, *items, **options)


def result_of(spark: SparkSession, folder: str, tag: Tag, *columns: str, **run) -> DataFrame:
    """Planned result of a tag, all columns or the named ones; no item may fail."""
    frame = require_all(compute_tag(catalog(spark, folder), tag, **run), tag).frame
    return frame.select(*columns) if columns else frame


__all__ = [
    "CUSTOMER",
    "N_OPEN",
    "N_ORDERS",
    "ORDERING_CUSTOMER",
    "PostProcess",
    "Query",
    "RETURNED_QTY",
    "Staging",
    "TABLES",
    "TOTAL",
    "USER",
    "at",
    "base_tag",
    "catalog",
    "customer_tag",
    "result_of",
    "tagitem",
]
