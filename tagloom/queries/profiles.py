"""Whole profiles: everything together."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..plans.metadata import load_model
from ..plans.model import run_model
from ..plans.store import PathStore
from ..sources import Catalog, shared_folder
from ..spec import Item, Model, PostProcess, Tag
from ..streaming.runlog import RunLog
from .common import (
    CUSTOMER,
    RETURNED_QTY,
    TOTAL,
    USER,
    Query,
    catalog,
    result_of,
    tagitem,
)
from dataclasses import replace

CUSTOMER_PROFILE = Tag(
    "customer_profile",
    (
        CUSTOMER,
        Item(
            "nation",
            "sql",
            "SELECT c_custkey, n_name FROM customer JOIN nation ON n_nationkey = c_nationkey",
        ),
        Item("n_orders", "basic", "1", table="orders", key_column="o_custkey", type="int", duplicates="count"),
        Item(
            "n_open",
            "basic",
            "1",
            table="orders",
            key_column="o_custkey",
            filter="o_orderstatus = 'O' AND o_orderdate > timestamp_ntz'1999-01-01 00:00:00'",
            type="int",
            duplicates="count",
        ),
        Item(
            "open_ratio",
            "formula",
            "#open / #all",
            type="double",
            params=(tagitem("open", "n_open", "int"), tagitem("all", "n_orders", "int")),
        ),
        replace(TOTAL, post=PostProcess("number", min=0.0, max=450000.0)),
        RETURNED_QTY,
    ),
)

USER_PROFILE = Tag(
    "user_profile",
    (
        USER,
        Item("n_events", "basic", "1", table="events", key_column="user_id", type="int", duplicates="count"),
        Item(
            "n_errors",
            "basic",
            "1",
            table="events",
            key_column="user_id",
            filter="event_type = 'error'",
            type="int",
            duplicates="count",
        ),
        Item(
            "last_type",
            "basic",
            "event_type",
            table="events",
            key_column="user_id",
            increment_column="ts",
            duplicates="latest",
        ),
        Item(
            "error_rate",
            "formula",
            "#errors / #all",
            type="double",
            params=(tagitem("errors", "n_errors", "int"), tagitem("all", "n_events", "int")),
        ),
        Item(
            "health",
            "formula",
            "#rate",
            type="double",
            params=(tagitem("rate", "error_rate", "double"),),
            post=PostProcess("weight", standard=0.2),
            lower_is_better=True,
        ),
    ),
)


def customer_profile(spark, folder):
    return result_of(spark, folder, CUSTOMER_PROFILE)


def user_profile(spark, folder):
    return result_of(spark, folder, USER_PROFILE)


def _metadata(spark) -> Catalog:
    """A model as metadata tables: one tag over customers and their orders."""

    def rows(schema: str, *values: tuple):
        return spark.createDataFrame(list(values), schema)

    items = (
        "itemguid string, itemcategoryguid string, itemname string, itemanothername string, itemtype string, "
        "itemcontent string, tablename string, filtercondition string, associatedstructname string, "
        "returntype string, defaultvalue string, itemattribute string, postprocessingtype string, "
        "postprocessing string, stagingtableguids string, extracttype int, isenabled int, orderno int"
    )
    return (
        Catalog(spark)
        .add("model", rows("modelguid string, configguid string", ("m1", "g1")))
        .add("runconfig", rows("configguid string, savetype string", ("g1", "mysql")))
        .add("model_tag", rows("modelguid string, tagguid string, orderno int", ("m1", "t1", 1)))
        .add("tag", rows("tagguid string, taganothername string", ("t1", "customer_spend")))
        .add(
            "stagingtable",
            rows(
                "stagingtableguid string, tagguid string, stagingtableanothername string, sqlcontent string",
                ("s1", "t1", "closed_orders", "SELECT o_custkey, o_totalprice FROM orders WHERE o_orderstatus = '#st'"),
            ),
        )
        .add(
            "stagingtable_param",
            rows("stagingtableguid string, paramname string, paramvalue string, orderno int", ("s1", "st", "F", 1)),
        )
        .add(
            "tag_item_category",
            rows("itemcategoryguid string, parentguid string, tagguid string, orderno int", ("c1", None, "t1", 1)),
        )
        .add(
            "tag_item",
            rows(
                items,
                ("i1", "c1", "key", "cust_id", "key", "c_custkey", "customer", None, None, "int", None, None, None,
                 None, None, 1, 1, 9),
                ("i2", "c1", "orders", "n_closed", "sql", "SELECT o_custkey, count(*) FROM closed_orders GROUP BY 1",
                 None, None, None, "int", "0", None, None, None, "s1", 1, 1, 8),
                ("i3", "c1", "balance", "bal", "basic", "c_acctbal", "customer", "c_acctbal > 0", "c_custkey",
                 "double", "-1", None, "weight", '{"standard": "1000", "weight": ""}', None, 1, 1, 7),
                ("i4", "c1", "score", "score", "formula", "#b + #n", None, None, None, "double", None, None, None,
                 None, None, 1, 1, 6),
                ("i5", "c1", "off", "off", "basic", "c_name", "customer", None, "c_custkey", "string", None, None,
                 None, None, None, 1, 0, 5),
            ),
        )
        .add(
            "tag_item_param",
            rows(
                "itemguid string, paramname string, paramvalue string, paramtype string, accesstype string",
                ("i4", "b", "bal", "double", "tagitem"),
                ("i4", "n", "n_closed", "int", "tagitem"),
            ),
        )
    )


def model_run(spark, folder):
    """A model read from metadata tables, run, logged and published; the published table is the result."""
    where = f"{shared_folder(spark)}/model-run-{uuid.uuid4().hex}"
    model = load_model(_metadata(spark), "m1")
    store = PathStore(spark, f"{where}/result")
    report = run_model(catalog(spark, folder), model, lambda tag: store, RunLog(spark, f"{where}/log"))
    if report.messages:
        raise RuntimeError("; ".join(report.messages))
    return store.read()


def model_two_sources(spark, folder):
    """Two tags of one model, each over a data source of its own, and one whose source is missing."""
    where = f"{shared_folder(spark)}/model-run-{uuid.uuid4().hex}"
    tables = catalog(spark, folder)
    sales = Catalog(spark, {"facts": lambda: tables.table("orders").selectExpr("o_custkey AS k", "o_totalprice AS v")})
    stock = Catalog(spark, {"facts": lambda: tables.table("supplier").selectExpr("s_suppkey AS k", "s_acctbal AS v")})
    items = (
        Item("id", "key", "k", table="facts", type="int"),
        Item("top", "basic", "v", table="facts", key_column="k", type="double", default="-1e9"),
    )
    tags = tuple(Tag(name, items, source=name) for name in ("sales", "stock", "nowhere"))
    stores = {tag.name: PathStore(spark, f"{where}/{tag.name}") for tag in tags}
    report = run_model(
        {"sales": sales, "stock": stock}, Model("two", tags), lambda tag: stores[tag.name], RunLog(spark, f"{where}/log")
    )
    if len(report.messages) != 1 or "nowhere not found" not in report.messages[0]:
        raise RuntimeError("; ".join(report.messages))
    named = [stores[n].read().select(F.lit(n).alias("tag"), "id", "top") for n in ("sales", "stock")]
    return named[0].unionByName(named[1])


def run_counts(spark, folder):
    """How many rows each item of a run wrote into, as the report of the run tells."""
    where = f"{shared_folder(spark)}/run-counts-{uuid.uuid4().hex}"
    store = PathStore(spark, f"{where}/result")
    model = Model("counts", (CUSTOMER_PROFILE,))
    report = run_model(catalog(spark, folder), model, lambda tag: store, RunLog(spark, f"{where}/log"))
    if report.messages:
        raise RuntimeError("; ".join(report.messages))
    rows = [(tag, item or "(rows)", n) for tag, counts in report.counts.items() for item, n in counts.items()]
    return spark.createDataFrame(rows, "tag string, item string, n_rows bigint")


def runlog_append(spark, folder):
    """Messages of a run, one of them about the events, added step by step to one JSON array."""
    events = catalog(spark, folder).table("events")
    few = events.where("event_type = 'error'").groupBy("event_type").agg(F.count("event_id").alias("n")).first()
    log = RunLog(spark, f"{shared_folder(spark)}/run-log-{uuid.uuid4().hex}")
    started = log.now()
    run = log.start("m", started)
    log.append(run, "m", started, ["first"])
    log.append(run, "m", started, [f"{few['n'] if few else 0} errors", "third"])
    log.finish(run, "m", started, ["last"])
    return log.runs().select("model", "status", "messages")


QUERIES: dict[str, Query] = {
    f.__name__: f for f in (customer_profile, user_profile, model_run, model_two_sources, run_counts, runlog_append)
}
