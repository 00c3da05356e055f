"""Type names, their Spark types, typed NULLs, and predicates over types."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import Unsupported

#: Types that Spark has, and those that it widens: unsigned integers, half floats, coarse and nanosecond times.
_SIMPLE: dict[str, T.DataType] = {
    "null": T.NullType(), "boolean": T.BooleanType(), "int8": T.ByteType(), "int16": T.ShortType(), "int32": T.IntegerType(), "int64": T.LongType(),
    "uint8": T.ShortType(), "uint16": T.IntegerType(), "uint32": T.LongType(), "uint64": T.DecimalType(20, 0),
    "float16": T.FloatType(), "float32": T.FloatType(), "float64": T.DoubleType(), "date32": T.DateType(), "date64": T.DateType(),
    "binary": T.BinaryType(), "largebinary": T.BinaryType(), "binaryview": T.BinaryType(), "configuredbinary": T.BinaryType(),
    "utf8": T.StringType(), "largeutf8": T.StringType(), "utf8view": T.StringType(),
    "duration": T.DayTimeIntervalType(), "interval_year_month": T.YearMonthIntervalType(), "interval_day_time": T.DayTimeIntervalType(),
}


def spark_type(name: str, *, zone: str | None = None, unit: str | None = None) -> T.DataType:
    """The Spark type of a named type: "int64", "decimal(10,2)", "varchar(5)", "fixed_binary(16)", "timestamp", "time32"."""
    name = name.lower()
    if name in _SIMPLE:
        return _SIMPLE[name]
    if name == "timestamp":
        return T.TimestampNTZType() if zone is None else T.TimestampType()
    if name in ("time32", "time64"):
        if unit not in ({"time32": ("s", "ms"), "time64": ("us", "ns")}[name]):
            raise ValueError(f"{name} has no unit {unit}")
        return T.TimeType({"s": 0, "ms": 3}.get(unit, 6))
    if m := re.fullmatch(r"(decimal|decimal256)\((\d+),\s*(\d+)\)", name):
        most, p, s = 76 if m[1] == "decimal256" else 38, int(m[2]), int(m[3])
        if not 1 <= p <= most or s > p:
            raise ValueError(f"no such decimal: precision {p}, scale {s}")
        if p > 38:
            raise Unsupported(f"a decimal of {p} digits; Spark has 38")
        return T.DecimalType(p, s)
    if m := re.fullmatch(r"(varchar|char)\((\d+)\)", name):
        return T.VarcharType(int(m[2])) if m[1] == "varchar" else T.CharType(int(m[2]))
    if re.fullmatch(r"fixed_binary\(\d+\)", name):
        return T.BinaryType()
    raise Unsupported(f"type {name}")


def list_of(element: T.DataType, nullable: bool = True) -> T.ArrayType:
    return T.ArrayType(element, nullable)


def map_of(key: T.DataType, value: T.DataType, nullable: bool = True) -> T.MapType:
    return T.MapType(key, value, nullable)


def union_of(fields: dict[str, T.DataType]) -> T.StructType:
    """A tagged union: tag names the field that holds the value."""
    out = T.StructType([T.StructField("tag", T.StringType(), False)])
    for n, t in fields.items():
        out = out.add(n, t)
    return out


def null_of(t: T.DataType) -> Column:
    return F.lit(None).cast(t)


def into_schema(t: T.DataType, name: str = "value", nullable: bool = True) -> T.StructType:
    """The fields of a struct type; any other type as one field."""
    return t if isinstance(t, T.StructType) else T.StructType([T.StructField(name, t, nullable)])


def is_integer(t: T.DataType) -> bool:
    return isinstance(t, T.IntegralType)


def is_floating(t: T.DataType) -> bool:
    return isinstance(t, (T.FloatType, T.DoubleType))


def is_numeric(t: T.DataType) -> bool:
    return isinstance(t, T.NumericType)


def is_temporal(t: T.DataType) -> bool:
    return isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType, T.TimeType, T.DayTimeIntervalType, T.YearMonthIntervalType))


def is_string(t: T.DataType) -> bool:
    return isinstance(t, (T.StringType, T.VarcharType, T.CharType))


def is_binary(t: T.DataType) -> bool:
    return isinstance(t, T.BinaryType)


def is_nested(t: T.DataType) -> bool:
    return isinstance(t, (T.ArrayType, T.StructType, T.MapType))


def of_length(c: Column, n: int) -> Column:
    """An array or binary value of exactly n items; an error otherwise."""
    return F.when(c.isNull() | (F.size(c) == n), c).otherwise(F.raise_error(F.lit(f"not of length {n}")))
