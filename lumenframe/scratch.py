"""Folders that the driver and all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: dict[tuple[str, str], str] = {}


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in this application's folder, which is removed at exit.

    The folder is below spark.checkpoint.dir, as the session has it. Where that is unset a local session, as in tests,
    has a temporary folder; on a cluster it is an error, as executors would write to disks of their own.
    """
    base, app = spark.conf.get("spark.checkpoint.dir", None) or "", spark.sparkContext.applicationId
    check_shared(base, spark.sparkContext.master)
    if (base, app) not in _made:
        _made[base, app] = f"{base or 'file://' + tempfile.mkdtemp(prefix='lumenframe-')}/lumenframe-tables-{app}"
        atexit.register(_remove, spark, _made[base, app])
    return f"{_made[base, app]}/{name}-{uuid.uuid4().hex}"


def check_shared(base: str, master: str) -> None:
    """Raises where executors have no folder in common with the driver."""
    if not base and (not master.startswith("local") or master.startswith("local-cluster")):
        raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session may have ended before; then the cluster's own cleaning has to do it
        pass


def written(df: DataFrame, name: str, fmt: str = "parquet") -> DataFrame:
    """df written to the shared folder and read again."""
    path = shared_path(df.sparkSession, name)
    df.write.format(fmt).save(path)
    return df.sparkSession.read.format(fmt).schema(df.schema).load(path)
