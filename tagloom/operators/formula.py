"""Formula items: expressions over other columns of the same result row.

A formula is a Spark SQL expression with ``#name`` parameters, the name of a prepared formula, or a Python
callable from parameter columns to a column. Everything stays a column expression of the wide frame: no join,
no shuffle, no Python worker.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import blank, round_half_up
from ..lenient import lenient_analysis
from ..sources.sqltext import constant, parse_date, replace_names
from ..spec import Item, Param, SpecError
from ..types import epoch_millis, is_instant, spark_type, system_type_of


@dataclass(frozen=True)
class Bound:
    """A parameter as a column and its type."""

    column: Column
    type: T.DataType


PreparedFormula = Callable[[Mapping[str, Bound], str], Column]
_PREPARED: dict[str, PreparedFormula] = {}


def prepared_formula(name: str) -> Callable[[PreparedFormula], PreparedFormula]:
    """Register ``fn(params, returntype) -> Column`` under a name that formula items can use."""

    def register(fn: PreparedFormula) -> PreparedFormula:
        _PREPARED[name] = fn
        return fn

    return register


@prepared_formula("sum")
def sum_of_params(params: Mapping[str, Bound], returntype: str) -> Column:
    """Sum of all parameters; numeric text counts, dates count as epoch millis, anything else as zero."""
    total = F.lit(0.0)
    for bound in params.values():
        if isinstance(bound.type, T.StringType):
            number = F.trim(bound.column).try_cast("double")
        elif is_instant(bound.type):
            number = epoch_millis(bound.column).cast("double")
        elif system_type_of(bound.type) in ("int", "double"):
            number = bound.column.cast("double")
        else:
            continue
        total = total + F.coalesce(number, F.lit(0.0))
    if returntype == "int":
        return round_half_up(total)
    if returntype == "double":
        return total
    if returntype == "string":
        return total.cast("string")
    return F.lit(None).cast(spark_type(returntype))


def is_user_code(item: Item) -> bool:
    """True for callables and user-registered formulas: they may change between runs without a trace in the specification."""
    prepared = _PREPARED.get(str(item.content).strip())
    return callable(item.content) or (prepared is not None and prepared is not sum_of_params)


def bind_constant(param: Param, mode: str) -> Bound:
    """Typed literal of a constant or variable parameter."""
    kind = param.type or "string"
    if kind == "int":
        target = T.DoubleType() if mode == "compat" else T.LongType()
        return Bound(F.lit(constant(param)).cast(target), target)
    if kind == "double":
        return Bound(F.lit(constant(param)).cast("double"), T.DoubleType())
    if kind == "date":
        value = parse_date(param.value)
        text = F.lit(None if value is None else value.isoformat(sep=" "))
        return Bound(text.cast("timestamp_ntz"), T.TimestampNTZType())
    return Bound(F.lit(None if param.value is None else str(param.value)).cast("string"), T.StringType())


def bind_column(fields: Mapping[str, T.StructField], param: Param, storage: str = "table") -> Bound:
    """Result column of a tagitem parameter; number parameters read unusable cells as zero.

    In ``cell`` storage blank text cells read as ''.
    """
    field = fields.get(str(param.value).lower())
    if field is None:
        raise SpecError(f"parameter #{param.name}: the result has no column {param.value}")
    column, dtype = F.col(f"`{field.name}`"), field.dataType
    if param.type not in ("int", "double"):
        if storage == "cell" and isinstance(dtype, T.StringType):
            column = F.when(blank(column), F.lit("")).otherwise(column)
        return Bound(column, dtype)
    target = spark_type(param.type)
    if is_instant(dtype):
        column = epoch_millis(column)
    elif isinstance(dtype, T.StringType):
        column = F.trim(column)
    if dtype != target:
        column = column.try_cast(target)
    return Bound(F.coalesce(column, F.lit(0).cast(target)), target)


def bind_params(
    fields: Mapping[str, T.StructField], item: Item, mode: str, storage: str = "table"
) -> dict[str, Bound]:
    """Bind all parameters; for floating-point results whole numbers become floating-point first."""
    bound = {}
    for param in item.params:
        one = bind_column(fields, param, storage) if param.access == "tagitem" else bind_constant(param, mode)
        if item.system_type == "double" and system_type_of(one.type) == "int":
            one = Bound(one.column.cast("double"), T.DoubleType())
        bound[param.name] = one
    return bound


def coerce_result(value: Column, dtype: T.DataType, returntype: str, mode: str = "strict") -> Column:
    """Bring a formula result to its declared type.

    Numbers are truncated to whole numbers or kept; a division by zero in floating point gives 0. Text (and in
    ``compat`` mode the printed form of numbers) keeps its leading digits, with one dot for ``double``.
    """
    numeric = system_type_of(dtype) in ("int", "double")
    fractional = system_type_of(dtype) == "double"
    if returntype == "string":
        return F.coalesce(value.cast("string"), F.lit(""))
    if returntype == "date":
        return value.cast("date") if is_instant(dtype) else value.cast("string").try_cast("date")
    if returntype == "byte":
        return value.cast("string").cast("binary") if not isinstance(dtype, T.BinaryType) else value
    if numeric and mode != "compat":
        if fractional:
            number = value.cast("double")
            finite = ~F.isnan(number) & (F.abs(number) != F.lit(float("inf")))
            number = F.when(finite, number).otherwise(F.lit(0.0))
            return number.try_cast("bigint") if returntype == "int" else number
        return value.cast("bigint") if returntype == "int" else F.coalesce(value.cast("double"), F.lit(0.0))
    text = value.cast("double" if isinstance(dtype, T.DecimalType) else dtype).cast("string")
    if returntype == "int":
        digits = F.regexp_extract(text, "^[0-9]+", 0)
        result = F.when(digits == "", F.lit(0).cast("bigint")).otherwise(digits.try_cast("bigint"))
        missing = F.lit(0).cast("bigint")
    else:
        digits = F.regexp_extract(text, "^[0-9]*\\.?[0-9]*", 0)
        result = F.when(digits.isin("", "."), F.lit(0.0)).otherwise(digits.try_cast("double"))
        missing = F.lit(0.0)
    if fractional or (numeric and returntype == "double"):
        return F.coalesce(result, missing)
    return result


def _expression(item: Item, bound: Mapping[str, Bound], names: Mapping[str, str]) -> Column:
    if callable(item.content):
        return item.content({name: b.column for name, b in bound.items()})
    prepared = _PREPARED.get(str(item.content).strip())
    if prepared is not None:
        return prepared(bound, item.system_type)
    return F.expr(replace_names(str(item.content), names, lambda n: f"`{names[n]}`"))


def evaluate(df: DataFrame, items: Sequence[Item], mode: str = "strict", storage: str = "table") -> DataFrame:
    """Add ``__f_<item>`` columns with the coerced results of formulas that do not refer to each other."""
    fields = {field.name.lower(): field for field in df.schema.fields}
    with lenient_analysis(df.sparkSession):
        inputs: dict[str, Column] = {}
        formulas: dict[str, Column] = {}
        for item in items:
            bound, names = {}, {}
            for name, one in bind_params(fields, item, mode, storage).items():
                names[name] = f"__p_{item.name}_{name}"
                inputs[names[name]] = one.column
                bound[name] = Bound(F.col(f"`{names[name]}`"), one.type)
            formulas[f"__f_{item.name}"] = _expression(item, bound, names)
        raw = (df.withColumns(inputs) if inputs else df).withColumns(formulas)
        types = {field.name: field.dataType for field in raw.schema.fields}
        coerced = {
            name: coerce_result(F.col(f"`{name}`"), types[name], item.system_type, mode)
            for name, item in zip(formulas, items, strict=True)
        }
        return raw.withColumns(coerced).drop(*inputs)


def apply_formula(df: DataFrame, key: str, item: Item, mode: str = "strict") -> DataFrame:
    """``(key, value)`` frame of one formula over a result; rows without a value are left out."""
    name = f"__f_{item.name}"
    return (
        evaluate(df, [item], mode)
        .select(F.col(f"`{key}`"), F.col(f"`{name}`").alias(item.name))
        .where(F.col(f"`{item.name}`").isNotNull())
    )
