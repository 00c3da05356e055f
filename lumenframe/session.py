"""Sessions, named relations and relations without an input."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .dataset import Dataset

SETTINGS = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"}


class Engine:
    """A Spark session with the relations that the API can make or remember.

    Settings are made only on sessions that this class builds; a session that is passed in stays as it is.
    """

    def __init__(self, spark: SparkSession | None = None, **settings: str):
        if spark is None:
            builder = SparkSession.builder
            for k, v in (SETTINGS | {k.replace("__", "."): v for k, v in settings.items()}).items():
                builder = builder.config(k, v)
            spark = builder.getOrCreate()
        self.spark = spark
        self._known: dict[str, DataFrame] = {}

    def range(self, start: int, end: int | None = None, step: int = 1, partitions: int | None = None) -> Dataset:
        """Half-open, one column id; start defaults to 0; a negative step counts down and zero is an error."""
        if end is None:
            start, end = 0, start
        return Dataset(self.spark.range(start, end, step, partitions))

    def empty(self, one_row: bool = False) -> DataFrame:
        """No columns; no row, or one."""
        return self.spark.range(1).select() if one_row else self.spark.createDataFrame([], StructType([]))

    def project(self, *columns: Column) -> DataFrame:
        """SELECT without FROM: one row."""
        return self.spark.range(1).select(*columns)

    def values(self, rows: Sequence[Sequence[Column]], names: Sequence[str]) -> DataFrame:
        """Rows of expressions."""
        return self.spark.range(1).select(F.inline(F.array(*(F.struct(*(e.alias(n) for e, n in zip(r, names))) for r in rows))))

    def local(self, data, schema=None) -> DataFrame:
        """Rows held by the caller: Arrow IPC bytes, an Arrow table, pandas, or rows."""
        if isinstance(data, (bytes, bytearray)):
            import pyarrow as pa

            data = pa.ipc.open_stream(bytes(data)).read_all()
        return self.spark.createDataFrame(data, schema) if schema is not None else self.spark.createDataFrame(data)

    def remember(self, key: str, df: DataFrame) -> DataFrame:
        """Names a relation, by hash or by id."""
        self._known[key] = df
        return df

    def recall(self, key: str) -> DataFrame:
        return self._known[key]

    def sql(self, text: str, args: dict | Iterable | None = None, **frames: DataFrame) -> DataFrame:
        """A query with parameters (:name or ?) over named frames."""
        return self.spark.sql(text, args=args if args is None or isinstance(args, dict) else list(args), **frames)
