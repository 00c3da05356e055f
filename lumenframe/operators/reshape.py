"""Pivot, unpivot, generators."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pivot(df: DataFrame, keys: Sequence[str], columns: Sequence[str], values: Mapping[str, Sequence], *aggregates: Column) -> DataFrame:
    """values: name -> one value for each of columns. Several columns are compared together; one pass, partial sums first.

    Without keys, every column that is not pivoted is a key of the caller's making: pass them.
    """
    tests = []
    for name, wanted in values.items():
        same = F.lit(True)
        for c, v in zip(columns, wanted if isinstance(wanted, (list, tuple)) else [wanted]):
            same = same & F.col(c).eqNullSafe(F.lit(v))
        tests.append(F.when(same, F.lit(name)))
    return df.withColumn("_p", F.coalesce(*tests)).groupBy(*keys).pivot("_p", list(values)).agg(*aggregates)


def unpivot(df: DataFrame, ids: Sequence[str] | None, values: Mapping[str, Sequence[str]], variable: str, names: Sequence[str], include_nulls: bool = False) -> DataFrame:
    """values: label -> one column for each of names. ids None: all other columns. NULL rows go unless asked for."""
    used = {c for cols in values.values() for c in cols}
    keep = list(ids) if ids is not None else [c for c in df.columns if c not in used]
    rows = F.array(*(F.struct(F.lit(label).alias(variable), *(F.col(c).alias(n) for c, n in zip(cols, names))) for label, cols in values.items()))
    out = df.select(*keep, F.inline(rows))
    if include_nulls:
        return out
    some = F.lit(False)
    for n in names:
        some = some | F.col(n).isNotNull()
    return out.filter(some)


def lateral_view(df: DataFrame, generator: Column, *names: str) -> DataFrame:
    """Each row with what the generator makes of it; an outer generator keeps rows that it makes nothing of."""
    return df.select("*", generator.alias(*names))
