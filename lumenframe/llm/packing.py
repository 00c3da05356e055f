"""Operator 6: best-fit packing planned on a histogram of lengths."""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import tokens
from .common import materialize, ship, table

PLAN = "length bigint, rank_from bigint, rank_to bigint, sequence_from bigint, offset bigint"


def plan_best_fit(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over counts: rows (length, rank_from, rank_to, sequence_from, offset).

    The pieces of a length with ranks in [rank_from, rank_to) go to sequences sequence_from,
    sequence_from + 1, ... at that offset. Open sequences with equal room are kept as ranges, so the work and
    the rows depend on the capacity and the number of lengths, and not on how many pieces there are.
    """
    plan, rooms, open_, opened = [], [], {}, 0

    def keep(room: int, first: int, count: int) -> None:
        if room and count:
            if room not in open_:
                bisect.insort(rooms, room)
                open_[room] = []
            open_[room].append((first, count))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            at = bisect.bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, count = open_[room].pop()
                if not open_[room]:
                    del open_[room], rooms[at]
            else:
                room = capacity
                first, count = opened, -(-left // (capacity // length))
                opened += count
            fit = room // length
            full, rest = divmod(min(left, count * fit), fit)
            for layer in range(fit):
                n = full + (layer < rest)
                if n:
                    plan.append((length, rank, rank + n, first, capacity - room + layer * length))
                    rank, left = rank + n, left - n
            keep(room - fit * length, first, full)
            if rest:
                keep(room - rest * length, first + full, 1)
            keep(room, first + full + bool(rest), count - full - bool(rest))
    return plan


def document_pieces(docs: DataFrame, path: str, *, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", specials_as_text: bool = False) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of each document's pieces.

    specials_as_text: see PieceEncoder.

    A document's ids end with end_id; a null text is empty. Only documents longer than capacity are cut, into
    pieces of capacity ids after a first piece that holds the remainder.
    """
    ship(docs.sparkSession)
    end = end_id.to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokens.encoder(path, specials_as_text)
        for batch in batches:
            out = [], [], [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = enc.encode(text.as_py()) + end
                n = len(ids) // 4
                start, stop, piece = 0, (n - 1) % capacity + 1, 0
                while start < n:
                    for column, value in zip(out, (doc_id, piece, start, stop - start, zlib.crc32(ids[4 * start : 4 * stop]))):
                        column.append(value)
                    start, stop, piece = stop, stop + capacity, piece + 1
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return docs.mapInArrow(cut, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


def pack(pieces: DataFrame, *, capacity: int = 2048) -> DataFrame:
    """pieces (with columns doc_id, piece, length) with sequence_id and offset.

    The plan is made from the histogram of lengths, at most capacity rows. A piece takes the planned slot of
    its rank among the pieces of its length; ranks are counted in hashed blocks of about 100,000 pieces and
    the blocks' sizes are summed up, so that no common length meets in one task. The plan has no more rows than
    open room sizes and layers allow (some ten thousands at 2048), and is broadcast for that reason.
    Rows that repeat each take a slot of their own. An empty table stays empty. Other columns pass through, whatever
    their names, but for sequence_id and offset, which are replaced.
    """
    spark = pieces.sparkSession
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = spark.createDataFrame(plan_best_fit(histogram, capacity), PLAN)
    blocks = max(64, sum(histogram.values()) // 100_000)
    kept = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    dealt = pieces.select("length", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(blocks)).alias("block"), F.col("doc_id").alias("by_id"), F.col("piece").alias("by_piece"), F.struct(*kept).alias("row"))
    sizes = dealt.groupBy("length", "block").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("block")) - F.col("n")
    sizes = sizes.select("length", "block", before.alias("before"))
    order = Window.partitionBy("length", "block").orderBy("by_id", "by_piece")
    ranked = dealt.withColumn("place", F.row_number().over(order)).join(sizes, ["length", "block"])
    ranked = ranked.select("length", (F.col("before") + F.col("place") - 1).alias("rank"), "row")
    slot = (F.col("p.length") == F.col("d.length")) & (F.col("rank") >= F.col("rank_from")) & (F.col("rank") < F.col("rank_to"))
    placed = ranked.alias("d").join(F.broadcast(plan.alias("p")), slot)
    return placed.select("d.row.*", (F.col("sequence_from") + F.col("rank") - F.col("rank_from")).alias("sequence_id"), F.col("p.offset").alias("offset"))


def pack_documents(docs: DataFrame, path: str, *, capacity: int = 2048, **options) -> DataFrame:
    """A row per piece of every document, with its place: see document_pieces, which has the options, and pack."""
    return pack(materialize(document_pieces(docs, path, capacity=capacity, **options), "pieces"), capacity=capacity)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens."""
    return pack_documents(table(spark, sf_dir, "documents"), tokens.tokenizer_path())
