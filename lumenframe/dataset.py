"""The user-facing data set: a DataFrame by its first few operations."""

from __future__ import annotations

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession


class Dataset:
    """Immutable and lazy: each transformation is a new Dataset over a new plan."""

    def __init__(self, df: DataFrame):
        self.df = df

    @property
    def context(self) -> SparkSession:
        return self.df.sparkSession

    def logical_plan(self) -> str:
        return self.df._jdf.queryExecution().logical().toString()

    def select(self, *names: str | Column) -> Dataset:
        return Dataset(self.df.select(*names))

    def filter(self, predicate: Column | str) -> Dataset:
        return Dataset(self.df.filter(predicate))

    def cache(self) -> Dataset:
        return self.persist(StorageLevel.MEMORY_ONLY)

    def persist(self, level: StorageLevel) -> Dataset:
        return Dataset(self.df.persist(level))

    def collect(self) -> list[pa.RecordBatch]:
        return self.df.toArrow().to_batches()

    def count(self) -> int:
        return self.df.count()
