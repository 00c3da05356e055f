"""Python functions in plans, by kind."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Evaluation kinds of Python functions by their public codes: the API that makes each. Fixed values.
EVALUATION = {
    100: "udf", 101: "udf useArrow", 200: "pandas_udf Series -> Series", 201: "applyInPandas", 202: "pandas_udf Series -> scalar",
    203: "pandas_udf over a window", 204: "pandas_udf Iterator", 205: "mapInPandas", 206: "cogroup applyInPandas", 207: "mapInArrow",
    208: "applyInPandasWithState", 300: "udtf", 301: "udtf useArrow",
}


def is_table_function(code: int) -> bool:
    if code not in EVALUATION:
        raise ValueError(f"unknown evaluation kind {code}")
    return code in (300, 301)


def scalar(fn: Callable, returns: str, *, arrow: bool = True, deterministic: bool = True):
    made = F.udf(fn, returns, useArrow=arrow)
    return made if deterministic else made.asNondeterministic()


def vectorised(fn: Callable, returns: str):
    return F.pandas_udf(fn, returns)


def map_partitions(df: DataFrame, fn: Callable, schema: str, *, arrow: bool = True, barrier: bool = False) -> DataFrame:
    return df.mapInArrow(fn, schema, barrier=barrier) if arrow else df.mapInPandas(fn, schema, barrier=barrier)


def _sorted(fn: Callable, sort_by: Sequence[str], arrow: bool) -> Callable:
    """fn over the rows of its group in order."""
    if arrow:
        return lambda rows: fn(rows.sort_by([(c, "ascending") for c in sort_by]))
    return lambda rows: fn(rows.sort_values(list(sort_by), ignore_index=True))


def group_map(df: DataFrame, keys: Sequence[str | Column], fn: Callable, schema: str, *, arrow: bool = False, sort_by: Sequence[str] = ()) -> DataFrame:
    """fn of each group's rows, in the order of sort_by; a group must fit a task."""
    grouped, run = df.groupBy(*keys), _sorted(fn, sort_by, arrow) if sort_by else fn
    return grouped.applyInArrow(run, schema) if arrow else grouped.applyInPandas(run, schema)


def cogroup_map(left: DataFrame, left_keys: Sequence[str], right: DataFrame, right_keys: Sequence[str], fn: Callable, schema: str, *, left_sort: Sequence[str] = (), right_sort: Sequence[str] = ()) -> DataFrame:
    """fn(key, left rows, right rows) for each key of either side, each side's rows in order."""

    def run(key, a, b):
        a = a.sort_values(list(left_sort), ignore_index=True) if left_sort else a
        b = b.sort_values(list(right_sort), ignore_index=True) if right_sort else b
        return fn(key, a, b)

    return left.groupBy(*left_keys).cogroup(right.groupBy(*right_keys)).applyInPandas(run, schema)


def register(spark: SparkSession, name: str, fn: Callable, returns: str | None = None) -> None:
    spark.udf.register(name, fn, returns) if returns else spark.udf.register(name, fn)


def register_table_function(spark: SparkSession, name: str, cls) -> None:
    spark.udtf.register(name, cls)


def register_java(spark: SparkSession, name: str, class_name: str, returns: str | None = None, *, aggregate: bool = False) -> None:
    """A function of a class on the class path."""
    if aggregate:
        spark.udf.registerJavaUDAF(name, class_name)
    else:
        spark.udf.registerJavaFunction(name, class_name, returns)
