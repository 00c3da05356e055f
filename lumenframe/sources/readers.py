"""Tables, files and rows of text as DataFrames."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import shared_path


def read_table(spark: SparkSession, name: str, options: Mapping[str, str] | None = None, *, streaming: bool = False) -> DataFrame:
    reader = spark.readStream if streaming else spark.read
    return reader.options(**(options or {})).table(name)


def read(spark: SparkSession, fmt: str, paths: str | Sequence[str] | None = None, *, schema=None, options: Mapping[str, str] | None = None, predicates: Sequence[str] = (), streaming: bool = False) -> DataFrame:
    """Files or a connector. predicates: for jdbc a partition each; for other formats the rows that meet any of them."""
    options = dict(options or {})
    if fmt == "jdbc" and predicates:
        return spark.read.jdbc(options.pop("url"), options.pop("dbtable"), predicates=list(predicates), properties=options)
    reader = (spark.readStream if streaming else spark.read).format(fmt).options(**options)
    if schema is not None:
        reader = reader.schema(schema)
    df = reader.load() if paths is None else reader.load(paths if isinstance(paths, str) or streaming else list(paths))
    return df.filter(reduce(lambda a, b: a | b, map(F.expr, predicates))) if predicates else df


def parse(df: DataFrame, column: str, fmt: str, schema: str, options: Mapping[str, str] | None = None) -> DataFrame:
    """A column of JSON or CSV lines as columns of a schema; other columns stay."""
    fn = {"json": F.from_json, "csv": F.from_csv}[fmt]
    return df.withColumn("_parsed", fn(F.col(column), schema, dict(options or {}))).select(*df.columns, "_parsed.*")


def infer_json_schema(df: DataFrame, column: str) -> str:
    """The schema that fits all lines: they are written as text once, and Spark's reader infers it."""
    path = shared_path(df.sparkSession, "lines")
    df.where(F.col(column).isNotNull()).select(F.translate(column, "\r\n", "  ").alias("value")).write.text(path)
    return df.sparkSession.read.json(path).schema.simpleString()
