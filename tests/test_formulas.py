"""Formula binding, evaluation and coercion."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from tagloom.lenient import lenient_analysis
from tagloom.operators.formula import apply_formula, evaluate, prepared_formula
from tagloom.spec import Item, Param


def run(spark, text, type, rows, schema, *params, mode="strict"):
    df = spark.createDataFrame(rows, schema)
    out = evaluate(df, [Item("f", "formula", text, type=type, params=params)], mode)
    return [r["__f_f"] for r in out.orderBy("k").collect()]


def col(name, type="double", column=None):
    return Param(name, column or name, type, "tagitem")


@pytest.mark.parametrize(
    "value, type, strict, compat",
    [
        (-5.0, "double", -5.0, 0.0),
        (12345678.9, "double", 12345678.9, 1.23456789),
        (0.0001, "double", 0.0001, 1.0),
        (3.7, "int", 3, 3),
        (-3.7, "int", -3, 0),
        (math.inf, "double", 0.0, 0.0),
        (math.nan, "int", 0, 0),
    ],
)
def test_number_coercion(spark, value, type, strict, compat):
    for mode, expected in (("strict", strict), ("compat", compat)):
        assert run(spark, "#x", type, [(1, value)], "k long, x double", col("x"), mode=mode) == [expected]


def test_text_coercion_keeps_leading_digits(spark):
    rows = [(1, "12abc"), (2, "-3"), (3, "1.5.2"), (4, "."), (5, ""), (6, None)]
    assert run(spark, "#x", "int", rows, "k long, x string", col("x", "string")) == [12, 0, 1, 0, 0, None]
    assert run(spark, "#x", "double", rows, "k long, x string", col("x", "string")) == [12.0, 0.0, 1.5, 0.0, 0.0, None]
    assert run(spark, "#x", "string", rows, "k long, x string", col("x", "string"))[5] == ""


def test_division_by_zero(spark):
    rows = [(1, 6, 0), (2, 6, 3)]
    params = (col("a", "int"), col("b", "int"))
    assert run(spark, "#a / #b", "double", rows, "k long, a long, b long", *params) == [0.0, 2.0]
    assert run(spark, "#a div #b", "int", rows, "k long, a long, b long", *params) == [None, 2]
    assert spark.conf.get("spark.sql.ansi.enabled") == "true"


def test_arithmetic_mode_is_restored_after_errors(spark):
    with pytest.raises(RuntimeError), lenient_analysis(spark):
        raise RuntimeError
    assert spark.conf.get("spark.sql.ansi.enabled") == "true"


def test_number_parameters_read_unusable_cells_as_zero(spark):
    rows = [(1, "7"), (2, "x"), (3, None), (4, "2.5")]
    assert run(spark, "#x + 1", "int", rows, "k long, x string", col("x", "int")) == [8, 1, 1, 1]
    assert run(spark, "#x + 1", "double", rows, "k long, x string", col("x")) == [8.0, 1.0, 1.0, 3.5]


def test_names_in_literals_stay(spark):
    assert run(spark, "concat('#x', #x)", "string", [(1, "v")], "k long, x string", col("x", "string")) == ["#xv"]
    assert run(spark, "#x + #xx", "int", [(1, 1, 20)], "k long, x long, xx long", col("x", "int"), col("xx", "int")) == [21]


def test_constants(spark):
    rows, schema = [(1, 4.0)], "k long, x double"
    assert run(spark, "#x * #c", "double", rows, schema, col("x"), Param("c", "3", "int")) == [12.0]
    assert run(spark, "#c", "string", rows, schema, Param("c", "3", "int", "variable"), mode="compat") == ["3.0"]
    assert run(spark, "year(#c)", "int", rows, schema, Param("c", "2024-05-06", "date")) == [2024]
    assert run(spark, "#c", "string", rows, schema, Param("c", "text")) == ["text"]


def test_sum_takes_every_type(spark):
    schema = "k long, a long, s string, d date, b boolean, n double"
    df = spark.createDataFrame([(1, 2, "1.5", None, True, None), (2, 1, "bad", None, True, 0.4)], schema)
    df = df.withColumn("d", F.lit("1970-01-01").cast("date"))
    params = [col(c, None) for c in "asdbn"]
    for type, expected in (("double", [3.5, 1.4]), ("int", [4, 1]), ("string", ["3.5", "1.4"]), ("date", [None, None])):
        out = evaluate(df, [Item("f", "formula", "sum", type=type, params=tuple(params))])
        assert [r["__f_f"] for r in out.orderBy("k").collect()] == expected


def test_registered_and_callable_formulas(spark):
    @prepared_formula("widest")
    def widest(params, returntype):
        return F.greatest(*[p.column for p in params.values()])

    rows, schema = [(1, 2.0, 9.0)], "k long, a double, b double"
    assert run(spark, "widest", "double", rows, schema, col("a"), col("b")) == [9.0]
    assert run(spark, lambda p: p["a"] - p["b"], "double", rows, schema, col("a"), col("b")) == [-7.0]


def test_formula_frame_leaves_out_rows_without_value(spark):
    df = spark.createDataFrame([(1, 6, 0), (2, 6, 3)], "k long, a long, b long")
    item = Item("f", "formula", "#a div #b", type="int", params=(col("a", "int"), col("b", "int")))
    assert [tuple(r) for r in apply_formula(df, "k", item).collect()] == [(2, 2)]
