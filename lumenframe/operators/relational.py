"""Projection, naming, hints, parameters and metrics."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def project(df: DataFrame, *exprs: Column | str) -> DataFrame:
    return df.select(*exprs)


def with_columns(df: DataFrame, columns: Mapping[str, Column], metadata: Mapping[str, dict] | None = None) -> DataFrame:
    df = df.withColumns(dict(columns))
    for name, data in (metadata or {}).items():
        df = df.withMetadata(name, data)
    return df


def rename(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Unknown names are ignored."""
    return df.withColumnsRenamed(dict(names))


def drop(df: DataFrame, *columns: Column | str) -> DataFrame:
    """By name or by expression; unknown names are ignored."""
    return df.drop(*columns)


def to_df(df: DataFrame, *names: str) -> DataFrame:
    return df.toDF(*names)


def to_schema(df: DataFrame, schema: StructType) -> DataFrame:
    """Reorders, and casts where no value can be lost."""
    return df.to(schema)


def alias(df: DataFrame, name: str, columns: Sequence[str] | None = None) -> DataFrame:
    return (df.toDF(*columns) if columns else df).alias(name)


def hint(df: DataFrame, name: str, *parameters) -> DataFrame:
    return df.hint(name, *parameters)


def star(
    df: DataFrame, *, ilike: str | None = None, exclude: Sequence[str] = (), replace: Mapping[str, Column] | None = None, rename: Mapping[str, str] | None = None
) -> DataFrame:
    """* with options: names LIKE a pattern regardless of case, without some, with others replaced, then renamed."""
    names = df.columns
    if ilike is not None:
        pattern = "".join(".*" if c == "%" else "." if c == "_" else re.escape(c) for c in ilike)
        names = [n for n in names if re.fullmatch(pattern, n, re.IGNORECASE | re.DOTALL)]
    left_out, new, to = {x.lower() for x in exclude}, replace or {}, rename or {}
    return df.select(*(new.get(n, F.col(f"`{n}`")).alias(to.get(n, n)) for n in names if n.lower() not in left_out))


def regex_columns(df: DataFrame, pattern: str) -> DataFrame:
    return df.select(df.colRegex(f"`{pattern}`"))


def collect_metrics(df: DataFrame, name: str, *metrics: Column) -> tuple[DataFrame, Observation]:
    """The frame and an observation whose get has the metrics once an action has run."""
    seen = Observation(name)
    return df.observe(seen, *metrics), seen
