"""Sort, limit, samples, partitions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_ORDER = {("asc", "first"): F.asc_nulls_first, ("asc", "last"): F.asc_nulls_last, ("desc", "first"): F.desc_nulls_first, ("desc", "last"): F.desc_nulls_last}


def order(column: str, direction: str = "asc", nulls: str | None = None) -> Column:
    """Unspecified nulls come first when ascending and last when descending."""
    return _ORDER[direction, nulls or ("first" if direction == "asc" else "last")](column)


def sort(df: DataFrame, *orders: Column | str, within_partitions: bool = False) -> DataFrame:
    return df.sortWithinPartitions(*orders) if within_partitions else df.orderBy(*orders)


def limit(df: DataFrame, n: int | None = None, skip: int = 0) -> DataFrame:
    df = df.offset(skip) if skip else df
    return df if n is None else df.limit(n)


def tail(df: DataFrame, n: int, *orders: Column) -> DataFrame:
    """The last n rows. With orders (those of the reversed sort) a top-k; else an action that fetches n rows."""
    return df.orderBy(*orders).limit(n) if orders else df.sparkSession.createDataFrame(df.tail(n), df.schema)


def sample(df: DataFrame, upper: float, lower: float = 0.0, *, with_replacement: bool = False, seed: int | None = None) -> DataFrame:
    """The share of rows whose random number is in [lower, upper)."""
    if with_replacement or not lower:
        return df.sample(with_replacement, upper - lower, seed)
    weights = [lower, upper - lower] + ([1 - upper] if upper < 1 else [])
    return df.randomSplit(weights, seed)[1]


def sample_by(df: DataFrame, column: str, fractions: Mapping, seed: int | None = None) -> DataFrame:
    return df.sampleBy(column, dict(fractions), seed)


def repartition(df: DataFrame, n: int | None = None, by: Sequence[Column | str] = (), *, shuffle: bool = True, by_range: bool = False) -> DataFrame:
    if not shuffle:
        return df.coalesce(n)
    if by_range:
        return df.repartitionByRange(n, *by) if n else df.repartitionByRange(*by)
    return df.repartition(n, *by) if n else df.repartition(*by)
