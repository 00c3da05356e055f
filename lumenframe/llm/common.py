"""What the operators of this subpackage share: shared storage, code shipping, block counts."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import shared_path, written

#: Words are the runs of bytes other than space and \t \n \v \f \r; bytes.split() cuts at the same six.
WORD_BREAK = r"[\x20\x09-\x0D]+"


_caches: dict[str, list[dict]] = {}


def worker_cache(kind: str) -> dict:
    """A dictionary that lives as long as a Python worker serves tasks of that kind (see only)."""
    found: dict = {}
    _caches.setdefault(kind, []).append(found)
    return found


def only(kind: str) -> None:
    """Empties the caches of other kinds: Spark hands its workers round between operators, and all of them share memory."""
    for other, own in _caches.items():
        if other != kind:
            for cache in own:
                cache.clear()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table of that name."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the driver and all executors share."""
    return shared_path(spark, name)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: lineage ends there, and lost executors lose nothing."""
    return written(df, name)


def ship(spark: SparkSession) -> None:
    """Makes this package importable in the Python workers of every executor."""
    sc = spark.sparkContext
    if getattr(sc, "_lumenframe_shipped", False):
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if os.path.isdir(top):
        path = os.path.join(tempfile.mkdtemp(prefix="lumenframe-code-"), "lumenframe.zip")
        with zipfile.ZipFile(path, "w") as z:
            for folder, _, names in os.walk(top):
                for n in names:
                    if n.endswith(".py"):
                        full = os.path.join(folder, n)
                        z.write(full, os.path.relpath(full, os.path.dirname(top)))
        sc.addPyFile(path)
    sc._lumenframe_shipped = True


def row_key(doc_id: str, text: str) -> Column:
    """A 128-bit hash of a row's id and text, which tells rows apart also where ids are null or repeat; a null text is empty."""
    own, id_ = F.coalesce(F.col(text), F.lit("")), F.col(doc_id).cast("bigint")
    return F.struct(F.xxhash64(id_, own).alias("a"), F.xxhash64(F.lit(1), own, id_).alias("b"))


def text_bytes(docs: DataFrame, text_col: str = "text") -> int:
    """Bytes of all texts; one pass that reads only that column."""
    return int(docs.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()[0])
