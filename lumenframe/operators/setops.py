"""Union, intersection and difference."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def aligned(left: DataFrame, right: DataFrame, allow_missing: bool = False) -> tuple[DataFrame, DataFrame]:
    """Both with the same columns in the same order; missing ones are NULL where that is allowed."""
    extra = [c for c in right.columns if c not in left.columns]
    missing = [c for c in left.columns if c not in right.columns]
    if (extra or missing) and not allow_missing:
        raise ValueError(f"columns on one side only: {extra + missing}")
    for c in extra:
        left = left.withColumn(c, F.lit(None).cast(right.schema[c].dataType))
    for c in missing:
        right = right.withColumn(c, F.lit(None).cast(left.schema[c].dataType))
    return left, right.select(*left.columns)


def set_operation(left: DataFrame, right: DataFrame, kind: str, *, all_rows: bool = False, by_name: bool = False, allow_missing: bool = False) -> DataFrame:
    if by_name:
        left, right = aligned(left, right, allow_missing)
    if kind == "union":
        return left.union(right) if all_rows else left.union(right).distinct()
    if kind == "intersect":
        return left.intersectAll(right) if all_rows else left.intersect(right)
    if kind == "except":
        return left.exceptAll(right) if all_rows else left.subtract(right)
    raise ValueError(f"unknown set operation {kind}")
