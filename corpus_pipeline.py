"""From documents to packed training sequences: five stages, each applying one operator to all that is left.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read as the next one's
docs. All but the last return the columns of documents. Nulls in any column, empty and very long texts, repeated rows and
empty tables pass through as their operators define. Stages decide by row, not by id: rows of one id with different
texts are judged one by one, rows with a null doc_id like any other, and of rows with equal id and text one stays in the
stage that drops duplicates. Rows without a word have no duplicates. Extra columns of any name pass through the stages
that drop rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm import jaccard, packing, quality, substring, tokens, toxicity
from lumenframe.llm.common import fresh_path, materialize, row_key, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents whose toxicity score is 0.5 or more."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.keep_below(docs, model, 0.5)


def _with_keys(docs: DataFrame) -> DataFrame:
    """row (all columns) and row_key."""
    return docs.select(F.struct("*").alias("row"), row_key("doc_id", "text").alias("row_key"))


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that fail the base rules or are more likely bad than good."""
    bad = materialize(quality.judge(docs).where("not kept").select("row_key").distinct(), "low-quality")
    return _with_keys(docs).join(bad, "row_key", "left_anti").select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that of the smallest id, of those the one of the least row key."""
    found = jaccard.near_duplicates(docs).where("n_shingles > 0").groupBy("row_key").agg(F.first("kept").alias("kept"), F.count("*").alias("n"))
    found = materialize(found.where("not kept or n > 1"), "near-duplicates")
    keyed = _with_keys(docs)
    single = keyed.join(found, "row_key", "left_anti")
    equal = keyed.join(found.where("kept").select("row_key"), "row_key", "left_semi").dropDuplicates(["row_key"])
    return single.union(equal).select("row.*")


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated passages of 35 words or more; other texts stay as they are."""
    kept = substring.remove_repeats(docs, carry=("lang", "source", "n_chars"), keep_layout=True)
    changed = F.size("spans") > 0
    return kept.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.when(changed, F.char_length("kept_text").cast("bigint")).otherwise(F.col("n_chars")).alias("n_chars"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of each document with its place in a sequence of 2048 tokens."""
    return packing.pack_documents(docs, tokens.tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("quality rules", drop_low_quality),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("substring dedup", cut_repeats),
    ("best-fit packing", pack_sequences),
]

#: SQL can express neither the trained stages nor the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = fresh_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
