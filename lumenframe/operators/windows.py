"""Window specifications."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

UNBOUNDED_PRECEDING, CURRENT_ROW, UNBOUNDED_FOLLOWING = Window.unboundedPreceding, Window.currentRow, Window.unboundedFollowing


def window(partition_by: Sequence[str | Column] = (), order_by: Sequence[str | Column] = (), frame: tuple[str, int, int] | None = None) -> WindowSpec:
    """frame: "rows" or "range" and both bounds as signed offsets; none gives Spark's default."""
    spec = Window.partitionBy(*partition_by)
    if order_by:
        spec = spec.orderBy(*order_by)
    if frame is None:
        return spec
    kind, low, high = frame
    if kind not in ("rows", "range"):
        raise ValueError(f"unknown frame type {kind}")
    return spec.rowsBetween(low, high) if kind == "rows" else spec.rangeBetween(low, high)


def top_k(df: DataFrame, k: int, partition_by: Sequence[str], order_by: Sequence[Column]) -> DataFrame:
    """The first k rows of each group."""
    return df.withColumn("_n", F.row_number().over(window(partition_by, order_by))).where(F.col("_n") <= k).drop("_n")
