"""Joins, with those that the DataFrame API has no name for."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KINDS = {"inner", "full_outer", "left_outer", "right_outer", "left_semi", "left_anti", "right_semi", "right_anti", "cross"}


def join(left: DataFrame, right: DataFrame, kind: str = "inner", *, on: Column | None = None, using: Sequence[str] | None = None, natural: bool = False) -> DataFrame:
    """Any join type with a condition, shared columns, all common columns, or no criteria (every pair)."""
    if kind not in KINDS:
        raise ValueError(f"unknown join type {kind}")
    if natural:
        using = [c for c in left.columns if c in right.columns]
    by = on if on is not None else list(using) if using else None
    if kind == "cross" or by is None and kind == "inner":
        return left.crossJoin(right)
    if kind in ("right_semi", "right_anti"):
        return right.join(left, by, kind.replace("right", "left")) if by is not None else right.join(left, F.lit(True), kind.replace("right", "left"))
    return left.join(right, by if by is not None else F.lit(True), kind)


def asof(left: DataFrame, right: DataFrame, *, using: Sequence[str], left_time: str, right_time: str, values: Sequence[str], bucket: str = "day", direction: str = "backward", tolerance: str | None = None) -> DataFrame:
    """Each left row with the values of the last right row of its keys at or before its time (or the first at or after).

    Both sides are put together and the last value is carried on within a key and a bucket of time; what the
    buckets before had last is carried on from a row per key and bucket. So a key with very many rows is spread over
    its buckets, and nothing multiplies. Rows with a NULL key or time match nothing. Of right rows of one time the one
    with the greatest values is taken, forward that with the least. tolerance: an interval.
    """
    if direction not in ("backward", "forward"):
        raise ValueError(f"unknown direction {direction}")
    back = direction == "backward"
    keys, held = list(using), F.struct(F.col(right_time).alias("_at"), *values)
    some = F.lit(True)
    for k in keys:
        some = some & F.col(k).isNotNull()
    rows = left.select(*keys, F.col(left_time).alias("_t"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_row"), F.lit(None).cast(right.select(held.alias("h")).schema["h"].dataType).alias("_h"))
    facts = right.where(some & F.col(right_time).isNotNull()).select(*keys, F.col(right_time).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(rows.schema["_row"].dataType).alias("_row"), held.alias("_h"))
    both = rows.unionByName(facts).withColumn("_b", F.date_trunc(bucket, "_t"))
    order = [F.col("_t").asc() if back else F.col("_t").desc(), F.col("_side").asc(), F.col("_h").asc() if back else F.col("_h").desc()]
    own = Window.partitionBy(*keys, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    pick = F.max_by if back else F.min_by
    ends = facts.withColumn("_b", F.date_trunc(bucket, "_t")).groupBy(*keys, "_b").agg(pick("_h", F.struct("_t", "_h")).alias("_e"))
    marks = both.where("_side = 1").select(*keys, "_b").distinct().join(ends, [*keys, "_b"], "full_outer")
    over = Window.partitionBy(*keys).orderBy(F.col("_b").asc() if back else F.col("_b").desc()).rowsBetween(Window.unboundedPreceding, -1)
    marks = marks.select(*(F.col(k).alias(f"_k_{k}") for k in keys), F.col("_b").alias("_mb"), F.last("_e", ignorenulls=True).over(over).alias("_m"))
    same = F.col("_b") == F.col("_mb")
    for k in keys:
        same = same & (F.col(k) == F.col(f"_k_{k}"))
    found = both.withColumn("_o", F.last("_h", ignorenulls=True).over(own)).where("_side = 1").join(marks, same, "left")
    found = found.withColumn("_f", F.when(some, F.coalesce("_o", "_m")))
    if tolerance:
        gap = F.expr(f"INTERVAL {tolerance}")
        near = F.col("_f._at") + gap >= F.col("_t") if back else F.col("_f._at") - gap <= F.col("_t")
        found = found.withColumn("_f", F.when(near, F.col("_f")))
    return found.select("_row.*", *(F.col(f"_f.{v}").alias(v) for v in values))


def interval_join(points: DataFrame, spans: DataFrame, *, point: str, start: str, end: str, width: float) -> DataFrame:
    """Points (numbers) with the spans [start, end) that hold them, through buckets: an equi-join, no nested loop.

    A span longer than width goes to buckets of twice, four times ... the width, so that it is in three buckets at most
    however long it is; points go to a bucket of each width that the spans need. Spans must be finite.
    """
    level = F.greatest(F.lit(0), F.ceil(F.log2((F.col(end) - F.col(start)) / width))).cast("int")
    s = spans.where(F.col(start) < F.col(end)).withColumn("_l", level)
    levels = sorted(r[0] for r in s.select("_l").distinct().collect())
    size = F.lit(float(width)) * F.pow(F.lit(2.0), F.col("_l"))
    s = s.withColumn("_b", F.explode(F.sequence(F.floor(F.col(start) / size), F.floor(F.col(end) / size))))
    p = points.withColumn("_l", F.explode(F.array(*map(F.lit, levels)).cast("array<int>"))).withColumn("_b", F.floor(F.col(point) / size))
    return p.join(s, ["_l", "_b"]).where((F.col(point) >= F.col(start)) & (F.col(point) < F.col(end))).drop("_l", "_b")
