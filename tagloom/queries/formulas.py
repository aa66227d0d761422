"""Formula items and post-processing."""

from __future__ import annotations

from ..operators.formula import apply_formula
from ..operators.items import basic_frame, one_per_key, sql_pairs
from ..operators.postprocess import post_process
from ..spec import Item, Param, PostProcess, Tag
from .common import CUSTOMER, N_ORDERS, Query, base_tag, catalog, customer_tag, result_of, tagitem

_OPEN = tagitem("open", "n_open", "int")
_ALL = tagitem("all", "n_orders", "int")
_TOTAL = tagitem("total", "total", "double")


def _formula(spark, folder, name, text, type, *params, **options):
    item = Item(name, "formula", text, type=type, params=params)
    return result_of(spark, folder, base_tag(item, **options), "cust_id", name)


def formula_expr(spark, folder):
    return _formula(spark, folder, "open_pct", "#open / #all * 100.0", "double", _OPEN, _ALL)


def formula_div_zero_double(spark, folder):
    return _formula(spark, folder, "ratio", "#all / #open", "double", _OPEN, _ALL)


def formula_div_zero_int(spark, folder):
    item = Item("ratio_i", "formula", "#all div #open", type="int", params=(_OPEN, _ALL))
    return apply_formula(result_of(spark, folder, base_tag()), "cust_id", item)


def formula_sum(spark, folder):
    return _formula(spark, folder, "s", "sum", "int", _ALL, _OPEN, _TOTAL)


def formula_chain(spark, folder):
    first = Item("score1", "formula", "#open / #all", type="double", params=(_OPEN, _ALL))
    second = Item(
        "score2", "formula", "#s * 2.0 + 1.0", type="double", params=(tagitem("s", "score1", "double"),)
    )
    return result_of(spark, folder, base_tag(second, first), "cust_id", "score2")


def formula_constant(spark, folder):
    return _formula(spark, folder, "fifth", "#total / #five", "double", _TOTAL, Param("five", "5", "int", "variable"))


def formula_callable(spark, folder):
    """A formula given as a Python function of columns."""
    return _formula(spark, folder, "gap", lambda p: p["all"] - p["open"], "int", _ALL, _OPEN)


def formula_string(spark, folder):
    return _formula(spark, folder, "s", "#all", "string", _ALL)


def formula_sum_mixed(spark, folder):
    day = Item("last_day", "basic", "o_orderdate", table="orders", key_column="o_custkey", type="date")
    item = Item(
        "s",
        "formula",
        "sum",
        type="double",
        params=(_ALL, Param("plus", "12.5", "string"), tagitem("day", "last_day", "date")),
    )
    return result_of(spark, folder, base_tag(day, item), "cust_id", "s")


def formula_coerce_prefix(spark, folder):
    key = Item("p_partkey", "key", "p_partkey", table="part", type="int")
    brand = Item("brand", "basic", "p_brand", table="part", key_column="p_partkey")
    number = Item(
        "brand_no",
        "formula",
        "substr(#brand, 7) || 'x'",
        type="int",
        params=(tagitem("brand", "brand", "string"),),
    )
    return result_of(spark, folder, Tag("part", (key, brand, number)), "p_partkey", "brand_no")


_BALANCE = Item("bal", "basic", "c_acctbal", table="customer", key_column="c_custkey", type="double")


def formula_coerce_negative_compat(spark, folder):
    item = Item("shown", "formula", "#bal", type="double", params=(tagitem("bal", "bal", "double"),))
    frame = result_of(spark, folder, customer_tag(_BALANCE, item, values="compat"))
    return frame.selectExpr("cust_id", "shown AS bal")


def _post(spark, folder, post, lower_is_better=False):
    item = Item(
        "bal",
        "basic",
        "c_acctbal",
        table="customer",
        key_column="c_custkey",
        type="double",
        post=post,
        lower_is_better=lower_is_better,
    )
    return post_process(basic_frame(catalog(spark, folder), CUSTOMER, [item]), item)


def post_weight_positive(spark, folder):
    return _post(spark, folder, PostProcess("weight", standard=5000.0, weight=0.3))


def post_weight_negative(spark, folder):
    return _post(spark, folder, PostProcess("weight", standard=5000.0, weight=0.3), True)


def post_number_clamp(spark, folder):
    return _post(spark, folder, PostProcess("number", min=0.0, max=8000.0))


def post_long_round(spark, folder):
    item = Item("n", "sql", N_ORDERS.content, type="int", post=PostProcess("weight", standard=7.0))
    return post_process(one_per_key(sql_pairs(catalog(spark, folder), CUSTOMER, item), CUSTOMER, item), item)


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        formula_expr,
        formula_div_zero_double,
        formula_div_zero_int,
        formula_sum,
        formula_chain,
        formula_constant,
        formula_callable,
        formula_string,
        formula_sum_mixed,
        formula_coerce_prefix,
        formula_coerce_negative_compat,
        post_weight_positive,
        post_weight_negative,
        post_number_clamp,
        post_long_round,
    )
}
