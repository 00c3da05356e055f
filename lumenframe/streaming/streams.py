"""Structured Streaming: sources, windows, state and sinks."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ..scratch import shared_path

TIMEOUTS = {"none": GroupStateTimeout.NoTimeout, "processing_time": GroupStateTimeout.ProcessingTimeTimeout, "event_time": GroupStateTimeout.EventTimeTimeout}


def read_files(spark: SparkSession, path: str, schema, fmt: str = "parquet", files_per_trigger: int | None = None) -> DataFrame:
    """Files as they come. A path of one file is read through its folder, as file streams need."""
    reader = spark.readStream.schema(schema).format(fmt)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).isFile(at):
        path, reader = at.getParent().toString(), reader.option("pathGlobFilter", at.getName())
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)


def with_watermark(df: DataFrame, column: str, delay: str) -> DataFrame:
    """Times without a zone are taken as the session's, as watermarks need."""
    return df.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, delay)


def tumbling(df: DataFrame, time: str, size: str, keys: Sequence[str | Column], *aggregates: Column) -> DataFrame:
    return df.groupBy(F.window(time, size), *keys).agg(*aggregates)


def sliding(df: DataFrame, time: str, size: str, every: str, keys: Sequence[str | Column], *aggregates: Column) -> DataFrame:
    return df.groupBy(F.window(time, size, every), *keys).agg(*aggregates)


def sessions(df: DataFrame, time: str, gap: str, keys: Sequence[str | Column], *aggregates: Column) -> DataFrame:
    return df.groupBy(F.session_window(time, gap), *keys).agg(*aggregates)


def with_state(df: DataFrame, keys: Sequence[str], fn: Callable, output: str, state: str, mode: str = "append", timeout: str = "none") -> DataFrame:
    return df.groupBy(*keys).applyInPandasWithState(fn, output, state, mode, TIMEOUTS[timeout])


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_initial_state(df: DataFrame, keys: Sequence[str], processor, output: str, initial: DataFrame, mode: str = "update") -> DataFrame:
    """A stateful processor that starts from rows of known state. The session must use ROCKSDB for its state."""
    return df.groupBy(*keys).transformWithStateInPandas(statefulProcessor=processor, outputStructType=output, outputMode=mode, timeMode="None", initialState=initial.groupBy(*keys))


def run_once(df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there and gives its result as a table in the shared folder.

    append writes files as they come. complete and update write each batch to a folder of its own, named by its number,
    so that a batch that is tried again replaces what it wrote before. complete gives the last batch; update all, with
    their numbers as _batch.
    """
    spark, path = df.sparkSession, shared_path(df.sparkSession, name)
    writer = df.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{path}/checkpoint")
    if mode == "append":
        writer.format("parquet").option("path", f"{path}/out").start().awaitTermination()
        return spark.read.parquet(f"{path}/out")
    numbers: list[int] = []

    def keep(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out/_batch={n}")
        numbers.append(n)

    writer.foreachBatch(keep).start().awaitTermination()
    if not numbers:
        empty = spark.createDataFrame([], df.schema)
        return empty if mode == "complete" else empty.withColumn("_batch", F.lit(0))
    if mode == "complete":
        return spark.read.schema(df.schema).parquet(f"{path}/out/_batch={max(numbers)}")
    return spark.read.option("basePath", f"{path}/out").parquet(*(f"{path}/out/_batch={n}" for n in sorted(set(numbers))))
