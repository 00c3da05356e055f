"""Missing values and descriptive statistics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def fill_na(df: DataFrame, value, columns: Sequence[str] | None = None) -> DataFrame:
    return df.na.fill(value) if isinstance(value, Mapping) else df.na.fill(value, list(columns) if columns else None)


def drop_na(df: DataFrame, columns: Sequence[str] | None = None, min_non_nulls: int | None = None) -> DataFrame:
    return df.na.drop(how="any", thresh=min_non_nulls, subset=list(columns) if columns else None)


def replace(df: DataFrame, replacements: Mapping, columns: Sequence[str] | None = None) -> DataFrame:
    return df.na.replace(dict(replacements), subset=list(columns) if columns else None)


def summary(df: DataFrame, *statistics: str) -> DataFrame:
    return df.summary(*statistics)


def describe(df: DataFrame, *columns: str) -> DataFrame:
    return df.describe(*columns)


def crosstab(df: DataFrame, left: str, right: str) -> DataFrame:
    return df.crosstab(left, right)


def cov(df: DataFrame, left: str, right: str) -> DataFrame:
    return df.agg(F.covar_samp(left, right).alias("cov"))


def average_ranks(df: DataFrame, column: str, buckets: int = 64) -> DataFrame:
    """value and its rank, ties averaged, for each distinct value; NULLs have none.

    Values are counted, and running sums are made within ranges between approximate quantiles and then over the
    ranges, of which there are at most buckets: no window over all rows in one task.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    cuts = sorted(set(df.approxQuantile(column, [i / buckets for i in range(1, buckets)], 0.005)))
    bucket = sum(((F.col("value") > c).cast("int") for c in cuts), F.lit(0))
    counts = counts.withColumn("bucket", bucket)
    sums = counts.groupBy("bucket").agg(F.sum("n").alias("total"))
    sums = sums.select("bucket", (F.sum("total").over(Window.orderBy("bucket")) - F.col("total")).alias("before"))
    within = F.sum("n").over(Window.partitionBy("bucket").orderBy("value")) - F.col("n")
    return counts.withColumn("within", within).join(F.broadcast(sums), "bucket").select("value", (F.col("before") + F.col("within") + (F.col("n") + 1) / 2).alias("rank"))


def corr(df: DataFrame, left: str, right: str, method: str = "pearson") -> DataFrame:
    """Pearson's or Spearman's correlation, over rows where both are known."""
    if method == "pearson":
        return df.agg(F.corr(left, right).alias("corr"))
    if method != "spearman":
        raise ValueError(f"unknown method {method}")
    both = df.where(F.col(left).isNotNull() & F.col(right).isNotNull()).select(F.col(left).alias("a"), F.col(right).alias("b"))
    ra = average_ranks(both, "a").select(F.col("value").alias("a"), F.col("rank").alias("ra"))
    rb = average_ranks(both, "b").select(F.col("value").alias("b"), F.col("rank").alias("rb"))
    return both.join(ra, "a").join(rb, "b").agg(F.corr("ra", "rb").alias("corr"))


def approx_quantile(df: DataFrame, columns: Sequence[str], probabilities: Sequence[float], relative_error: float = 0.0) -> DataFrame:
    """A row: for each column an array of its quantiles, exact at error 0 (up to Spark's largest accuracy)."""
    accuracy = 2147483647 if relative_error <= 0 else max(1, int(1 / relative_error))
    return df.agg(*(F.percentile_approx(c, list(probabilities), accuracy).alias(c) for c in columns))


def freq_items(df: DataFrame, columns: Sequence[str], support: float = 0.01) -> DataFrame:
    return df.freqItems(list(columns), support)
