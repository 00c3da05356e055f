"""Three-valued tests, the twelve binary operators, SIMILAR TO and null-safe comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import Unsupported

_BINARY = {
    "eq": lambda a, b: a == b,
    "neq": lambda a, b: a != b,
    "lt": lambda a, b: a < b,
    "lteq": lambda a, b: a <= b,
    "gt": lambda a, b: a > b,
    "gteq": lambda a, b: a >= b,
    "add": lambda a, b: a + b,
    "subtract": lambda a, b: a - b,
    "multiply": lambda a, b: a * b,
    "divide": lambda a, b: a / b,
    "and": lambda a, b: a & b,
    "or": lambda a, b: a | b,
}


def binary(name: str, *arguments: Column, integral: bool = False) -> Column:
    """One of the twelve operators by name. integral: division of whole numbers, which cuts towards zero."""
    if name not in _BINARY:
        raise Unsupported(f"function {name}")
    if len(arguments) != 2:
        raise ValueError(f"{name} takes two arguments, not {len(arguments)}")
    if name == "divide" and integral:
        return F.call_function("div", *arguments)
    return _BINARY[name](*arguments)


def is_true(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def is_not_true(c: Column) -> Column:
    return ~is_true(c)


def is_false(c: Column) -> Column:
    return F.coalesce(~c, F.lit(False))


def is_not_false(c: Column) -> Column:
    return ~is_false(c)


def is_unknown(c: Column) -> Column:
    return c.isNull()


def is_not_unknown(c: Column) -> Column:
    return c.isNotNull()


def between(c: Column, low, high, negated: bool = False) -> Column:
    found = c.between(low, high)
    return ~found if negated else found


def in_list(c: Column, values, negated: bool = False) -> Column:
    found = c.isin(*values)
    return ~found if negated else found


def is_distinct_from(a: Column, b: Column) -> Column:
    return ~a.eqNullSafe(b)


def is_not_distinct_from(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def similar_pattern(pattern: str, escape: str | None = "\\", case_insensitive: bool = False) -> str:
    """A Java regular expression for a SIMILAR TO pattern: % and _ are wild, | * + ? {} () [] keep their meaning."""
    out, i, inside = [], 0, False
    while i < len(pattern):
        c = pattern[i]
        if escape and c == escape and i + 1 < len(pattern):
            i += 1
            out.append("\\" + pattern[i] if not pattern[i].isalnum() else pattern[i])
        elif inside:
            inside = c != "]"
            out.append(c)
        elif c == "[":
            inside = True
            out.append(c)
        elif c in "%_":
            out.append(".*" if c == "%" else ".")
        elif c in "|*+?{}()":
            out.append(c)
        else:
            out.append(c if c.isalnum() or c.isspace() else "\\" + c)
        i += 1
    return f"(?{'i' if case_insensitive else ''}s)^(?:{''.join(out)})$"


def similar_to(c: Column, pattern: str, *, negated: bool = False, escape: str | None = "\\", case_insensitive: bool = False) -> Column:
    found = c.rlike(similar_pattern(pattern, escape, case_insensitive))
    return ~found if negated else found


def in_subquery(df: DataFrame, column: str, other: DataFrame, negated: bool = False) -> DataFrame:
    """Rows whose column is (not) among the first column of other.

    NOT IN keeps every row where other is empty, else none where other has a NULL, and no row with a NULL. It is an
    equi-join that keeps what does not match and two scalars over other, not a nested loop.
    """
    key = other.select(F.col(other.columns[0]).alias("_k"))
    same = F.col(column) == F.col("_k")
    if not negated:
        return df.join(key, same, "left_semi")
    empty = key.select(F.count(F.lit(1)) == 0).scalar()
    known = key.select(F.count_if(F.col("_k").isNull()) == 0).scalar()
    return df.join(key, same, "left_anti").where(empty | (known & F.col(column).isNotNull()))
