"""The five system types and how Spark columns are brought to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The system types and the Spark type each one is held in.
SYSTEM_TYPES: dict[str, T.DataType] = {
    "int": T.LongType(),
    "double": T.DoubleType(),
    "string": T.StringType(),
    "date": T.DateType(),
    "byte": T.BinaryType(),
}

# Database type names of every system type; any other name is a string.
DATABASE_TYPES: dict[str, tuple[str, ...]] = {
    "byte": ("binary", "bit", "blob", "longblob", "mediumblob", "tinyblob", "varbinary"),
    "date": ("date", "datetime", "time", "timestamp"),
    "double": ("decimal", "double", "float", "numeric", "year"),
    "int": ("int", "bigint", "integer", "mediumint", "smallint", "tinyint"),
}


def system_type_of_name(name: str | None) -> str:
    """System type of a database type name such as ``varchar`` or ``MEDIUMINT``."""
    lowered = (name or "").strip().lower()
    for system, names in DATABASE_TYPES.items():
        if lowered in names:
            return system
    return "string"


def system_type_of(dtype: T.DataType) -> str:
    """System type of a Spark data type; nested and boolean types count as text."""
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "int"
    if isinstance(dtype, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "double"
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "date"
    if isinstance(dtype, T.BinaryType):
        return "byte"
    return "string"


def spark_type(system: str) -> T.DataType:
    return SYSTEM_TYPES.get(system, T.StringType())


def is_instant(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType))


def epoch_millis(col: Column) -> Column:
    """Epoch milliseconds of a date or timestamp column, in the session time zone."""
    return F.unix_millis(col.cast("timestamp"))


def to_system(col: Column, dtype: T.DataType, system: str) -> Column:
    """Cast to a system type; a value that does not fit becomes null instead of failing the job."""
    target = spark_type(system)
    if dtype == target:
        return col
    source = system_type_of(dtype)
    if system == "string":
        if isinstance(dtype, (T.ArrayType, T.MapType, T.StructType)):
            return F.to_json(col)
        return col.cast("string")
    if source == "date":
        if system == "date":
            return col.cast("date")
        if system == "byte":
            return col.cast("string").cast("binary")
        return epoch_millis(col).cast(target)
    if system == "date":
        if source in ("int", "double"):
            return F.timestamp_millis(col.cast("bigint")).cast("date")
        return col.cast("string").try_cast("date")
    if system == "byte":
        return col.cast("string").cast("binary")
    if source == "byte" or isinstance(dtype, (T.ArrayType, T.MapType, T.StructType)):
        return to_system(col, T.StringType(), "string").cast("string").try_cast(target)
    return col.try_cast(target)


def normalize_types(df: DataFrame) -> DataFrame:
    """Bring every column of ``df`` to its system type in one projection."""
    return df.select(
        *[
            to_system(F.col(f"`{field.name}`"), field.dataType, system_type_of(field.dataType)).alias(field.name)
            for field in df.schema.fields
        ]
    )
