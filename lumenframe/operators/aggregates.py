"""Grouping, grouping extensions, distinct rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def aggregate(df: DataFrame, keys: Sequence[Column | str], *aggregates: Column, having: Column | None = None, with_keys: bool = True) -> DataFrame:
    """Groups; without keys always one row. with_keys=False leaves the keys out of the result."""
    out = df.groupBy(*keys).agg(*aggregates)
    if having is not None:
        out = out.filter(having)
    return out if with_keys else out.select(*out.columns[len(keys) :])


def rollup(df: DataFrame, keys: Sequence[Column | str], *aggregates: Column) -> DataFrame:
    return df.rollup(*keys).agg(*aggregates)


def cube(df: DataFrame, keys: Sequence[Column | str], *aggregates: Column) -> DataFrame:
    return df.cube(*keys).agg(*aggregates)


def grouping_sets(df: DataFrame, sets: Sequence[Sequence[str]], keys: Sequence[str], *aggregates: Column) -> DataFrame:
    return df.groupingSets([[F.col(c) for c in s] for s in sets], *keys).agg(*aggregates)


def deduplicate(df: DataFrame, columns: Sequence[str] | None = None, within_watermark: bool = False) -> DataFrame:
    if within_watermark:
        return df.dropDuplicatesWithinWatermark(list(columns) if columns else None)
    return df.dropDuplicates(list(columns)) if columns else df.distinct()


def call(name: str, *arguments: Column | str, distinct: bool = False, where: str | None = None, ignore_nulls: bool = False, order_by: str | None = None) -> Column:
    """A function by name, with the modifiers of SQL. Arguments of modified calls are SQL text."""
    if not (distinct or where or ignore_nulls or order_by):
        return F.call_function(name, *(F.col(a) if isinstance(a, str) else a for a in arguments))
    text = f"{name}({'DISTINCT ' if distinct else ''}{', '.join(map(str, arguments))})"
    text += f" WITHIN GROUP (ORDER BY {order_by})" if order_by else ""
    text += f" FILTER (WHERE {where})" if where else ""
    return F.expr(text + (" IGNORE NULLS" if ignore_nulls else ""))
