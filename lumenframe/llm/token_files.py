"""Operator 9: token-id files with one shared zstandard dictionary and per-document frames."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import tokens
from .common import fresh_path, ship, table, text_bytes, worker_cache

SHARD = "part int, seq int, first_id bigint, last_id bigint, n_docs bigint, n_tokens bigint, id_bytes int, dictionary_hash string, doc_ids array<bigint>, doc_tokens array<bigint>, ends array<bigint>, payload binary"

#: Bytes of text that one writing task gets.
PART_BYTES = 64 << 20

_dictionaries: dict[str, object] = worker_cache("tokens")


def _dictionary(data: bytes):
    """The worker's digested dictionary; None for an empty one."""
    import zstandard

    if not data:
        return None
    key = hashlib.sha256(data).hexdigest()
    if key not in _dictionaries:
        _dictionaries.clear()
        _dictionaries[key] = zstandard.ZstdCompressionDict(data)
    return _dictionaries[key]


def _stored(ids: bytes, width: int) -> bytes:
    import numpy as np

    return ids if width == 4 else np.frombuffer(ids, "<u4").astype("<u2").tobytes()


def train_dictionary(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = 512, sample_chars: int = 65536, dictionary_bytes: int = 65536, specials_as_text: bool = False) -> bytes:
    """A zstandard dictionary fitted on the serialized id arrays of a bounded sample.

    The sample is the sample_docs non-empty documents of at most sample_chars characters whose hashed ids come
    first; it changes only the compression ratio. Too small a sample gives an empty dictionary.
    """
    ship(docs.sparkSession)

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        enc = tokens.encoder(path, specials_as_text)
        width = 2 if enc.tokenizer.get_vocab_size() <= 65536 else 4
        samples = [_stored(enc.encode(t.as_py()), width) for b in batches for t in b.column(0)]
        try:
            data = zstandard.train_dictionary(dictionary_bytes, samples).as_bytes() if len(samples) >= 16 else b""
        except zstandard.ZstdError:
            data = b""
        yield pa.RecordBatch.from_pydict({"dictionary": pa.array([data], pa.binary())})

    sample = docs.where(F.length(text_col).between(1, sample_chars)).orderBy(F.xxhash64(F.col(id_col)), F.col(id_col)).limit(sample_docs).select(text_col)
    row = sample.coalesce(1).mapInArrow(train, "dictionary binary").first()
    return bytes(row[0]) if row else b""


def write_token_files(docs: DataFrame, out_dir: str, path: str, *, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", shard_tokens: int = 2_000_000, level: int = 3, specials_as_text: bool = False, **training) -> None:
    """Writes docs as token ids, in ascending order of id_col, below out_dir.

    out_dir/dictionary: hash and bytes of the shared dictionary. out_dir/shards: a row per shard of consecutive
    documents, with ids, token counts and frame ends of its documents, and the frames one after the other. A
    frame is one document's id array (16-bit where the vocabulary allows, else 32-bit, little-endian) compressed
    by itself with the dictionary. out_dir/starts: the number of ids before each shard.

    A null text counts as empty, and gives just end_id; rows of one id stay neighbours, in the order in which they
    are read; a null id comes first; other columns are ignored. A document longer than shard_tokens has its own
    shard. An empty table gives an empty file set. Rows are dealt to tasks by ranges of id and place read, PART_BYTES
    of text to each on average, so that many rows of one id, or of none, are spread too. specials_as_text: see
    PieceEncoder.
    """
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    data = train_dictionary(docs, path, specials_as_text=specials_as_text, **training)
    key = hashlib.sha256(data).hexdigest()
    spark.createDataFrame([(key, bytearray(data), level)], "dictionary_hash string, dictionary binary, level int").coalesce(1).write.parquet(f"{out_dir}/dictionary")
    end = end_id.to_bytes(4, "little")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        enc = tokens.encoder(path, specials_as_text)
        width = 2 if max(enc.tokenizer.get_vocab_size(), end_id + 1) <= 65536 else 4
        pack = zstandard.ZstdCompressor(level=level, dict_data=_dictionary(data), write_content_size=True, write_dict_id=False)
        part, seq = TaskContext.get().partitionId(), 0
        ids, counts, ends, frames, size, total = [], [], [], [], 0, 0

        def shard() -> pa.RecordBatch:
            row = {"part": part, "seq": seq, "first_id": next((i for i in ids if i is not None), None), "last_id": ids[-1], "n_docs": len(ids), "n_tokens": total, "id_bytes": width, "dictionary_hash": key, "doc_ids": ids, "doc_tokens": counts, "ends": ends, "payload": b"".join(frames)}
            return pa.RecordBatch.from_pylist([row], schema=schema)

        for batch in batches:
            for doc_id, own in zip(batch.column(0).to_pylist(), enc.encode_many(t.as_py() for t in batch.column(1))):
                own += end
                frame, n = pack.compress(_stored(own, width)), len(own) // 4
                if ids and total + n > shard_tokens:
                    yield shard()
                    seq, size, total = seq + 1, 0, 0
                    ids, counts, ends, frames = [], [], [], []
                size, total = size + len(frame), total + n
                ids.append(doc_id)
                counts.append(n)
                ends.append(size)
                frames.append(frame)
        if ids:
            yield shard()

    schema = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("first_id", pa.int64()), ("last_id", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("id_bytes", pa.int32()), ("dictionary_hash", pa.string()), ("doc_ids", pa.list_(pa.int64())), ("doc_tokens", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("payload", pa.binary())])
    placed = docs.withColumn("at", F.monotonically_increasing_id())
    ranges = placed.repartitionByRange(max(32, -(-text_bytes(docs) // PART_BYTES)), "doc_id", "at").sortWithinPartitions("doc_id", "at")
    ranges.select("doc_id", "text").mapInArrow(encode, SHARD).write.parquet(f"{out_dir}/shards")

    # Ids before each shard: sums within a partition, then over the partitions, a row for each PART_BYTES of text.
    shards = spark.read.parquet(f"{out_dir}/shards").select("part", "seq", "n_tokens")
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    parts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    within = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_tokens")
    shards.join(parts, "part").select("part", "seq", (F.col("before") + within).alias("shard_start")).write.parquet(f"{out_dir}/starts")


def _decode(data: bytes, crc_only: bool, wanted: frozenset[int] | None = None):
    """A task that turns shards into a row per document: its ids, or their crc32; of wanted ones only, if given.

    The offset index gives a document's frame; no other frame is decompressed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import zstandard

        unpack = zstandard.ZstdDecompressor(dict_data=_dictionary(data))
        for batch in batches:
            for row in range(batch.num_rows):
                cell = lambda name: batch.column(name)[row]
                kind = "<u2" if cell("id_bytes").as_py() == 2 else "<u4"
                counts, ends, payload = cell("doc_tokens").values.to_numpy(), cell("ends").values.to_numpy(), cell("payload").as_buffer()
                starts, begins = np.cumsum(counts) - counts, np.concatenate([[0], ends[:-1]])
                ids = cell("doc_ids").values
                known = range(len(ids)) if wanted is None else [k for k, i in enumerate(ids.to_pylist()) if i in wanted]
                out = []
                for k in known:
                    own = np.frombuffer(unpack.decompress(payload[begins[k] : ends[k]]), kind).astype("<u4")
                    if len(own) != counts[k]:
                        raise ValueError(f"document {ids[k]}: {len(own)} ids, the index has {counts[k]}")
                    out.append(zlib.crc32(own.tobytes()) if crc_only else own.astype("i8"))
                at = pa.array(known, pa.int64())
                names = ["part", "seq", "doc_id", "local_start", "n_tokens", "ids_crc32" if crc_only else "ids"]
                same = [pa.array(np.full(len(at), cell(c).as_py()), pa.int32()) for c in names[:2]]
                yield pa.RecordBatch.from_arrays([*same, ids.take(at), pa.array(starts).take(at), pa.array(counts).take(at), pa.array(out, pa.int64() if crc_only else pa.list_(pa.int64()))], names=names)

    return run


def _open(spark: SparkSession, out_dir: str) -> tuple[DataFrame, bytes]:
    ship(spark)
    row = spark.read.parquet(f"{out_dir}/dictionary").first()
    data = bytes(row["dictionary"])
    if hashlib.sha256(data).hexdigest() != row["dictionary_hash"]:
        raise ValueError(f"the dictionary of {out_dir} does not match its hash")
    return spark.read.parquet(f"{out_dir}/shards"), data


def read_digests(spark: SparkSession, out_dir: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, decoded from the files."""
    shards, data = _open(spark, out_dir)
    found = shards.mapInArrow(_decode(data, True), "part int, seq int, doc_id bigint, local_start bigint, n_tokens bigint, ids_crc32 bigint")
    starts = spark.read.parquet(f"{out_dir}/starts")
    return found.join(starts, ["part", "seq"]).select("doc_id", (F.col("shard_start") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")


def fetch(spark: SparkSession, out_dir: str, ids: list[int]) -> DataFrame:
    """doc_id and ids of the named documents: shards by their ranges of ids, pushed down to the scan, and frames by the index."""
    shards, data = _open(spark, out_dir)
    near = F.lit(False)
    for low, high in [(i, i) for i in ids] if len(ids) <= 64 else [(min(ids), max(ids))]:
        near = near | ((F.col("first_id") <= high) & (F.col("last_id") >= low))
    found = shards.where(near).mapInArrow(_decode(data, False, frozenset(ids)), "part int, seq int, doc_id bigint, local_start bigint, n_tokens bigint, ids array<bigint>")
    return found.select("doc_id", "ids")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all documents, read back from token files written for the query."""
    out = fresh_path(spark, "token-files")
    write_token_files(table(spark, sf_dir, "documents"), out, tokens.tokenizer_path())
    return read_digests(spark, out)
