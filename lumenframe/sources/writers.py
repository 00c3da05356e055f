"""Sinks, and the table commands that built-in tables lack."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write(df: DataFrame, *, path: str | None = None, table: str | None = None, fmt: str = "parquet", mode: str = "errorifexists", partition_by: Sequence[str] = (), bucket_by: tuple[int, Sequence[str]] | None = None, sort_by: Sequence[str] = (), cluster_by: Sequence[str] = (), options: Mapping[str, str] | None = None) -> None:
    writer = df.write.format(fmt).mode(mode).options(**(options or {}))
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if bucket_by:
        writer = writer.bucketBy(bucket_by[0], *bucket_by[1])
    if sort_by:
        writer = writer.sortBy(*sort_by)
    if cluster_by:
        writer = writer.clusterBy(*cluster_by)
    writer.saveAsTable(table) if table else writer.save(path)


def insert_into(df: DataFrame, table: str, *, overwrite: bool = False, dynamic: bool = False) -> None:
    """Columns by position. dynamic: an overwrite replaces only the partitions that df has rows of.

    insertInto does not read the writer's option for that, so the session's setting is changed while it runs.
    """
    if not dynamic:
        df.write.insertInto(table, overwrite=overwrite)
        return
    conf, name = df.sparkSession.conf, "spark.sql.sources.partitionOverwriteMode"
    before = conf.get(name)
    try:
        conf.set(name, "dynamic")
        df.write.insertInto(table, overwrite=overwrite)
    finally:
        conf.set(name, before)


def overwrite_where(old: DataFrame, new: DataFrame, condition: str, to: str) -> None:
    """REPLACE WHERE for files: the old rows that do not meet the condition and the new ones, at a new place."""
    kept = old.filter(~F.coalesce(F.expr(condition), F.lit(False)))
    kept.unionByName(new).write.parquet(to)


def merge(target: DataFrame, source: DataFrame, keys: Sequence[str], *, update: Sequence[str] = (), update_when: str = "true", delete_when: str = "false", insert: bool = True, delete_unmatched_when: str = "false") -> DataFrame:
    """MERGE for files: the target as it is afterwards.

    Matched rows go where delete_when holds, else take the source's columns of update where update_when holds. insert:
    source rows without a match are added, with NULL in columns that the source lacks. Target rows without a match
    go where delete_unmatched_when holds. Conditions name target columns plainly and source columns as source.<name>; NULL is
    false. NULL keys match nothing. A target row that several source rows match is an error, as in SQL.
    """
    one = source.groupBy(*keys).agg(F.first(F.struct(*source.columns)).alias("source"), F.count("*").alias("_n"))
    one = one.select(*(F.col(k).alias(f"_key_{k}") for k in keys), "source", "_n")
    same = F.lit(True)
    for k in keys:
        same = same & (F.col(k) == F.col(f"_key_{k}"))
    both = target.join(one, same, "left")
    matched, holds = F.col("_n").isNotNull(), lambda c: F.coalesce(F.expr(c), F.lit(False))
    once = F.when(F.col("_n") > 1, F.raise_error(F.lit("several source rows match one target row")).cast("boolean")).otherwise(True)
    both = both.where(once & F.when(matched, ~holds(delete_when)).otherwise(~holds(delete_unmatched_when)))
    new = lambda c: F.when(matched & holds(update_when), F.col("source")[c]).otherwise(F.col(c)).alias(c)
    kept = both.select(*(new(c) if c in update else F.col(c) for c in target.columns))
    if not insert:
        return kept
    added = source.join(target.select(*keys).distinct(), list(keys), "left_anti")
    return kept.union(added.select(*(F.col(f.name) if f.name in source.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in target.schema)))


def create_or_replace_table(spark: SparkSession, table: str, df: DataFrame, fmt: str = "parquet") -> None:
    """df may read the table that it replaces: the new rows are written before the old table goes."""
    if not spark.catalog.tableExists(table):
        df.write.format(fmt).saveAsTable(table)
        return
    fresh = f"{table}_{uuid.uuid4().hex}"
    df.write.format(fmt).saveAsTable(fresh)
    spark.sql(f"DROP TABLE {table}")
    spark.sql(f"ALTER TABLE {fresh} RENAME TO {table}")


def overwrite_directory(df: DataFrame, path: str, fmt: str = "parquet", options: Mapping[str, str] | None = None) -> None:
    df.write.format(fmt).options(**(options or {})).mode("overwrite").save(path)
