"""Operator 10: removal of word windows that occur more than once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .windows import Words, count_again, count_levels, in_blocks, levels_of, unpack


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
    return edges[0::2], edges[1::2]


def remove_repeats(docs: DataFrame, *, window: int = 35, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), keep_layout: bool = False) -> DataFrame:
    """Each document without the words of windows whose word sequence starts anywhere else, itself included.

    Returns doc_id, n_words, spans (array of struct start, end: maximal runs of removed words), kept_text, and the
    columns of carry under their own names, or as carried_<name> where the result has a column of that name. kept_text joins the kept words by one space; with keep_layout each
    kept run keeps its text as it was, and a document that loses nothing is returned unchanged.

    Rabin-Karp hashes (polynomials modulo 2**64 over mixed word hashes) of all windows are counted by Spark in hash
    buckets, twice: first as few bits as tell most windows apart, then, for windows that seem to repeat, two
    independent hashes of 64 bits each, so that windows count as equal where 128 bits are. A block of documents has
    back one byte for each distinct hash it sent, and merges its repeated windows into maximal intervals. Null and
    empty texts, and those of fewer words than a window, lose nothing (a null text
    counts as empty); a text that repeats its own windows, or is there twice, loses them all; rows with equal or
    null ids stay separate rows.
    """
    blocks, scale = in_blocks(docs, id_col, text_col, carry)
    shift = np.uint64(64 - scale.bits)

    def texts(rows: pa.Table) -> list[bytes]:
        return [t.as_buffer().to_pybytes() for t in rows.column("text")]

    def distinct(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        return np.unique(Words(texts(rows), False).windows(window)[0] >> shift, return_counts=True)

    def seeming(h: np.ndarray, levels: np.ndarray) -> np.ndarray:
        """Indexes of windows that seem to repeat."""
        return np.flatnonzero((levels > 0)[np.unique(h >> shift, return_inverse=True)[1]])

    def pairs(h: np.ndarray, rows: pa.Table, some: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct pairs of hashes of those windows, how many have each, and which each has."""
        first, second = h[some], Words(texts(rows), False, seed=1).windows(window)[0][some]
        order = np.lexsort((second, first))
        a, b = first[order], second[order]
        new = np.ones(len(some), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        which = np.empty(len(some), np.int64)
        which[order] = np.cumsum(new) - 1
        return a[new], b[new], np.bincount(which, minlength=int(new.sum())), which

    def seem(rows: pa.Table, levels: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h = Words(texts(rows), False).windows(window)[0]
        return pairs(h, rows, seeming(h, levels))[:3]

    def cut(rows: pa.Table, reply: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return schema.empty_table()
        rows = unpack(rows.column("payload"))
        words = Words(texts(rows), False)
        h, at = words.windows(window)
        gone = np.zeros(len(words.starts) + 1, np.int64)
        if len(h):
            rounds = reply.column("round").to_numpy()
            some = seeming(h, levels_of(reply.filter(pa.array(rounds == 1))))
            first = some[(levels_of(reply.filter(pa.array(rounds == 2))) > 0)[pairs(h, rows, some)[3]]]
            first = at[first]
            np.add.at(gone, first, 1)
            np.add.at(gone, first + window, -1)
        gone = np.cumsum(gone)[:-1] > 0
        spans, kept = [], []
        for k, text in enumerate(rows.column("text")):
            a, b = words.first[k], words.first[k + 1]
            own = gone[a:b]
            s, e = _runs(own)
            spans.append([{"start": int(x), "end": int(y)} for x, y in zip(s, e)])
            if keep_layout and not len(s):
                kept.append(text.as_py())
            elif keep_layout:
                kept.append(b" ".join(words.data[words.starts[a + x] : words.ends[a + y - 1]] for x, y in zip(*_runs(~own))).decode())
            elif not len(s):
                kept.append(b" ".join(text.as_buffer().to_pybytes().split()).decode())
            else:
                kept.append(b" ".join(words.data[words.starts[a + i] : words.ends[a + i]] for i in np.flatnonzero(~own)).decode())
        found = [rows.column("doc_id"), words.n_words, spans, kept, *(rows.column(f"carry_{c}") for c in carry)]
        return pa.Table.from_arrays([v.cast(f.type) if isinstance(v, pa.ChunkedArray) else pa.array(v, f.type) for v, f in zip(found, schema)], schema=schema)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

    span = StructType([StructField("start", LongType()), StructField("end", LongType())])
    out = StructType([StructField("doc_id", LongType()), StructField("n_words", LongType()), StructField("spans", ArrayType(span)), StructField("kept_text", StringType())])
    own = out.names
    for c in carry:
        out = out.add(f"carried_{c}" if c in own else c, docs.schema[c].dataType)
    schema = to_arrow_schema(out)
    reply = count_levels(blocks, scale, distinct)
    again = count_again(blocks, scale, reply, seem)
    reply = reply.withColumn("round", F.lit(1)).union(again.withColumn("round", F.lit(2)))
    return blocks.groupBy("block").cogroup(reply.groupBy("block")).applyInArrow(cut, out)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without their repeated windows of 35 words, as digests."""
    kept = remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    return kept.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))
