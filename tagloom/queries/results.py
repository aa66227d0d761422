"""Result tables: defaults, new keys, columns, updates, resets, encodings, repeated runs."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import functions as F

from ..functions import date_text, lenient_date, lenient_double, trim_token_end
from ..operators import result as R
from ..operators.items import basic_frame, key_spine
from ..plans.delta import DeltaStore
from ..plans.model import run_tag
from ..plans.tag import compute_tag
from ..sources import shared_folder
from ..spec import Item
from ..types import normalize_types as to_system_types
from .common import CUSTOMER, TOTAL, Query, at, base_tag, catalog, customer_tag

_SEGMENT = Item("segment", "basic", "c_mktsegment", table="customer", key_column="c_custkey", default="unknown")


def init_defaults(spark, folder):
    items = [
        Item("n_orders", type="int"),
        Item("score", type="double", default="1.5"),
        Item("segment", type="string", default="unknown"),
    ]
    return R.init_defaults(key_spine(catalog(spark, folder), CUSTOMER), items)


def init_new_keys(spark, folder):
    tables = catalog(spark, folder)
    rich = tables.table("customer").where("c_acctbal > 5000")
    prior = rich.selectExpr("c_custkey AS cust_id", "c_mktsegment AS segment")
    return R.init_new_keys(prior, key_spine(tables, CUSTOMER), [_SEGMENT])


def new_keys_only(spark, folder):
    tables = catalog(spark, folder)
    prior = tables.table("orders").where("o_totalprice > 400000").selectExpr("o_custkey AS cust_id").distinct()
    return R.new_keys(key_spine(tables, CUSTOMER), prior)


def add_missing_columns(spark, folder):
    prior = catalog(spark, folder).table("customer").selectExpr("c_custkey AS cust_id", "c_acctbal AS bal")
    items = [Item("bal", type="double"), Item("risk", type="double"), Item("grade", default="n/a")]
    return R.add_missing_columns(prior, items)


def modify_column_type(spark, folder):
    prior = catalog(spark, folder).table("customer").selectExpr("c_custkey AS cust_id", "c_nationkey AS nation")
    return R.modify_column_types(prior, [Item("nation", type="string")])


def backfill_blank(spark, folder):
    prior = catalog(spark, folder).table("customer").selectExpr(
        "c_custkey AS cust_id", "if(c_mktsegment = 'BUILDING', ' ', c_mktsegment) AS segment"
    )
    return R.backfill_blank(prior, [_SEGMENT])


def cell_storage(spark, folder):
    """A cell-store run: blank cells of the run's keys are filled, other rows and cells stay."""
    tables = catalog(spark, folder)
    prior = tables.table("customer").selectExpr(
        "c_custkey AS cust_id",
        "if(c_mktsegment = 'BUILDING', '', c_mktsegment) AS segment",
        "cast(NULL AS double) AS top_price",
    )
    key = replace(CUSTOMER, filter="c_acctbal > 0")
    top = Item("top_price", "basic", "o_totalprice", table="orders", key_column="o_custkey", type="double",
               filter="o_totalprice > 400000")
    segment = Item("segment", "basic", "c_mktsegment", table="customer", key_column="c_custkey", default="unknown",
                   filter="c_acctbal > 9000")
    tag = replace(customer_tag(segment, top, storage="cell"), items=(key, segment, top))
    return compute_tag(tables, tag, prior).frame


def save_update_existing(spark, folder):
    tables = catalog(spark, folder)
    spine = key_spine(tables, replace(CUSTOMER, filter="c_acctbal > 0"))
    item = replace(TOTAL, name="top_price", filter="o_totalprice > 400000", default="-1.0")
    return R.update_existing(R.init_defaults(spine, [item]), basic_frame(tables, CUSTOMER, [item]))


def reload_column(spark, folder):
    tables = catalog(spark, folder)
    prior = tables.table("customer").selectExpr("c_custkey AS cust_id", "c_acctbal AS top_price")
    item = replace(
        TOTAL, name="top_price", filter="o_orderstatus = 'F' AND o_totalprice > 400000", extract="reload"
    )
    return compute_tag(tables, customer_tag(item), prior).frame


def drop_column(spark, folder):
    prior = catalog(spark, folder).table("customer").selectExpr("c_custkey AS cust_id", "c_name", "c_acctbal")
    return R.drop_column(prior, "c_acctbal")


def two_pass_incremental(spark, folder):
    """A full run over the orders of the time and an incremental one over the newer orders, both through one store."""
    tables, store = catalog(spark, folder), DeltaStore(spark, f"{shared_folder(spark)}/two-pass-{uuid.uuid4().hex}", 8)
    early = replace(TOTAL, name="price", filter="o_orderdate <= timestamp_ntz'2001-01-01 00:00:00'")
    later = replace(TOTAL, name="price", extract="incremental", increment_column="o_orderdate")
    for item, watermark in ((early, None), (later, at("2001-01-01"))):
        _complete(run_tag(tables, customer_tag(item), store, watermark))
    return store.read()


def update_few_buckets(spark, folder):
    """Customers whose top price the last days' orders changed, and how many of them lie in buckets left in place (none)."""
    tables, store = catalog(spark, folder), DeltaStore(spark, f"{shared_folder(spark)}/few-{uuid.uuid4().hex}", 64)
    last = at("2001-07-25")
    early = replace(TOTAL, name="price", filter=f"o_orderdate <= timestamp_ntz'{last}'")
    later = replace(TOTAL, name="price", extract="incremental", increment_column="o_orderdate")
    _complete(run_tag(tables, customer_tag(early), store))
    _complete(run_tag(tables, customer_tag(later), store, last))
    now, before = store.snapshots(2)
    written = [b for b, folder in now.folders.items() if before.folders.get(b) != folder]
    both = before.read().withColumnRenamed("price", "old").join(now.read(), "cust_id", "full")
    changed = ~F.col("price").eqNullSafe(F.col("old"))
    count = lambda condition: F.count(F.when(condition, 1))
    return both.agg(
        F.count(F.lit(1)).alias("n_rows"),
        count(changed).alias("n_changed"),
        count(changed & ~now.inside("cust_id", written)).alias("n_changed_outside"),
    )


def _complete(messages):
    if messages:
        raise RuntimeError("; ".join(messages))


def error_isolation(spark, folder):
    """An item that cannot be planned keeps its default; the others are computed."""
    broken = Item("broken", "sql", "SELECT no_such_column, 1 FROM orders", type="double", default="-1.0")
    result = compute_tag(catalog(spark, folder), base_tag(broken))
    if result.failed != {"broken"}:
        raise RuntimeError(f"failed items: {result.failed}")
    return result.frame.select("cust_id", "n_orders", "broken")


def error_isolation_default(spark, folder):
    """An item whose declared default is no value of its type fails alone, and its column has the type's own default."""
    broken = Item("broken", "sql", "SELECT o_custkey, 7 FROM orders", type="int", default="n/a")
    result = compute_tag(catalog(spark, folder), base_tag(broken))
    if result.failed != {"broken"}:
        raise RuntimeError(f"failed items: {result.failed}")
    return result.frame.select("cust_id", "n_orders", "broken")


def truncate_result(spark, folder):
    """Rows and columns of a stored result before and after it is truncated."""
    tables, store = catalog(spark, folder), DeltaStore(spark, f"{shared_folder(spark)}/truncate-{uuid.uuid4().hex}", 8)
    _complete(run_tag(tables, base_tag(), store))
    before = store.read()
    store.publish(R.truncate(before))
    size = lambda df, step: df.agg(
        F.lit(step).alias("step"), F.count(F.lit(1)).alias("n_rows"), F.lit(len(df.columns)).alias("n_columns")
    )
    return size(before, "before").unionByName(size(store.read(), "after"))


def lenient_dates(spark, folder):
    """Order dates as the text forms in use, some of them no dates, read back."""
    orders = catalog(spark, folder).table("orders")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    forms = (
        F.when(F.col("o_orderkey") % 4 == 0, F.unix_millis(F.col("o_orderdate").cast("timestamp")).cast("string"))
        .when(F.col("o_orderkey") % 4 == 1, F.concat(F.lit(" "), day, F.lit(" 00:00:00")))
        .when(F.col("o_orderkey") % 4 == 2, day)
        .otherwise(F.concat(F.lit("on "), day))
    )
    return orders.select("o_orderkey", lenient_date(forms).cast("timestamp_ntz").alias("d"))


def normalize_types(spark, folder):
    return to_system_types(catalog(spark, folder).table("lineitem"))


def date_encode(spark, folder):
    return R.encode_cells(catalog(spark, folder).table("orders"))


def cell_decode(spark, folder):
    """Orders written as text cells, with blanked ones, and read back as typed columns."""
    cells = R.encode_cells(catalog(spark, folder).table("orders")).selectExpr(
        "o_orderkey",
        "if(o_orderstatus = 'P', '', o_custkey) AS o_custkey",
        "if(o_orderstatus = 'P', ' ', o_totalprice) AS o_totalprice",
        "if(o_orderstatus = 'P', NULL, o_orderpriority) AS o_orderpriority",
        "if(o_orderstatus = 'P', NULL, o_orderdate) AS o_orderdate",
    )
    types = {"o_custkey": "int", "o_totalprice": "double", "o_orderpriority": "string", "o_orderdate": "date"}
    return R.decode_cells(cells, types)


def lenient_parse(spark, folder):
    events = catalog(spark, folder).table("events")
    return events.select("event_id", lenient_double(F.get_json_object("props", "$.k")).alias("k"))


def trim_token(spark, folder):
    part = catalog(spark, folder).table("part")
    return part.select("p_type", trim_token_end(F.col("p_type"), "Y").alias("trimmed")).distinct()


def date_format(spark, folder):
    orders = catalog(spark, folder).table("orders")
    return orders.select(F.col("o_orderdate").alias("d"), date_text(F.col("o_orderdate"), "yyyyMMdd").alias("s")).distinct()


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        init_defaults,
        init_new_keys,
        new_keys_only,
        add_missing_columns,
        modify_column_type,
        backfill_blank,
        cell_storage,
        save_update_existing,
        reload_column,
        drop_column,
        two_pass_incremental,
        update_few_buckets,
        error_isolation,
        error_isolation_default,
        truncate_result,
        lenient_dates,
        normalize_types,
        date_encode,
        cell_decode,
        lenient_parse,
        trim_token,
        date_format,
    )
}
