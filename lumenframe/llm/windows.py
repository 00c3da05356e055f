"""Hashes of words and word windows, by numpy over whole buffers, and their counts over a corpus by Spark."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import only, ship, text_bytes, worker_cache

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Odd multipliers of the polynomial hashes modulo 2**64, over bytes and over words.
_BYTE_BASES, _WORD_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F), (0xD6E8FEB86659FD93, 0x9FB21C651E98DF25)
#: Bytes hashed at a time; a longer word is taken whole.
_CHUNK = 1 << 19

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = worker_cache("windows")


def _power_table(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a byte base and of its inverse, n at least."""
    if seed not in _powers or len(_powers[seed][0]) < n:
        size, base = max(_CHUNK, 1 << (n - 1).bit_length()), _BYTE_BASES[seed]
        _powers[seed] = tuple(np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, b, np.uint64))]) for b in (base, pow(base, -1, 2**64)))
    return _powers[seed]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads each bit over all."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Words:
    """The words of several texts: their byte ranges in data, their text's number, their 64-bit hashes.

    Hashes of another seed are independent.
    """

    def __init__(self, texts: list[bytes], lower: bool, seed: int = 0):
        only("windows")
        self.seed = seed
        self.data = b" ".join(texts)
        raw = np.frombuffer(self.data, np.uint8)
        if lower:
            raw = _LOWER[raw]
        edge = np.ones(len(raw) + 2, bool)
        edge[1:-1] = _SPACE[raw]
        cuts = np.flatnonzero(edge[1:] != edge[:-1])
        self.starts, self.ends = cuts[0::2], cuts[1::2]
        sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        self.first = np.concatenate([np.searchsorted(self.starts, np.cumsum(sizes) - sizes), [len(self.starts)]])
        self.n_words = np.diff(self.first)
        self.text = np.repeat(np.arange(len(texts)), self.n_words)
        self.hashes = np.empty(len(self.starts), np.uint64)
        at = 0
        while at < len(self.starts):
            base = self.starts[at]
            to = max(at + 1, int(np.searchsorted(self.ends, base + _CHUNK, "right")))
            part = raw[base : self.ends[to - 1]]
            power, inverse = _power_table(len(part) + 1, seed)
            total = np.zeros(len(part) + 1, np.uint64)
            np.cumsum((part.astype(np.uint64) + np.uint64(1)) * power[: len(part)], out=total[1:])
            s, e = self.starts[at:to] - base, self.ends[at:to] - base
            self.hashes[at:to] = mix((total[e] - total[s]) * inverse[s] + (e - s).astype(np.uint64))
            at = to

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Rabin-Karp hashes of the windows of k words of one text, and the indexes of their first words."""
        n = len(self.hashes)
        if n < k:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        h, m, base = self.hashes, 1, _WORD_BASES[self.seed]
        for bit in bin(k)[3:]:  # from m words to 2 m, and one more where k has the bit
            h = h[: n - 2 * m + 1] * np.uint64(pow(base, m, 2**64)) + h[m : n - m + 1]
            m *= 2
            if bit == "1":
                h = h[: n - m] * np.uint64(base) + self.hashes[m:]
                m += 1
        at = np.flatnonzero(self.text[: n - k + 1] == self.text[k - 1 :])
        return mix(h[at]), at


class Scale:
    """How many blocks of documents, buckets of hashes and hash bits an input of so many bytes gets.

    Blocks and buckets hold 8 MB of text or more, as the root of the input grows, so that the rows that pass between
    them have 64 hashes on average; 64 of each at least. A task needs some 15 times its block. bits: 2**8 values for
    each window, so that hashes that only steer a search coincide by chance for one in some hundred.
    """

    def __init__(self, n_bytes: int):
        size = max(8 << 20, int(math.sqrt(64 * 5.5 * n_bytes)))
        self.blocks = max(64, -(-n_bytes // size))
        self.buckets = 1 << max(6, (max(1, n_bytes) // size).bit_length())
        self.bits = min(64, max(32, (max(1, n_bytes) // 5).bit_length() + 8))


def in_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> tuple[DataFrame, Scale]:
    """Rows (block, payload): the documents dealt to blocks by a hash of id and text, as compressed Arrow streams.

    A stream has columns doc_id, text (null: empty) and those of carry.
    """
    ship(docs.sparkSession)
    scale = Scale(text_bytes(docs, text_col))
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.pmod(F.xxhash64(F.col(id_col), text), F.lit(scale.blocks)).cast("int").alias("block"), F.col(id_col).cast("bigint").alias("doc_id"), text.alias("text"), *(F.col(c).alias(f"carry_{c}") for c in carry))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("windows")
        options = pa.ipc.IpcWriteOptions(compression="zstd")
        for batch in batches:
            of = batch.column(0).to_numpy()
            order = np.argsort(of, kind="stable")
            names, cuts = np.unique(of[order], return_index=True)
            payloads = []
            for part in np.split(order, cuts[1:]) if len(order) else []:
                own = batch.take(pa.array(part))
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, own.schema, options=options) as to:
                    to.write_batch(own)
                payloads.append(sink.getvalue().to_pybytes())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(payloads, pa.binary())], names=["block", "payload"])

    return rows.mapInArrow(deal, "block int, payload binary"), scale


def unpack(payloads: pa.ChunkedArray) -> pa.Table:
    """The documents of a block."""
    return pa.concat_tables([pa.ipc.open_stream(p.as_buffer()).read_all() for p in payloads])


def _packed(values: np.ndarray) -> bytes:
    """Ascending 64-bit values: the first whole, then differences in as few bytes as the largest needs."""
    if not len(values):
        return b""
    gaps = np.diff(values)
    width = max(1, (int(gaps.max()).bit_length() + 7) // 8) if len(gaps) else 1
    return bytes([width]) + values[:1].astype("<u8").tobytes() + gaps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    if not data:
        return np.zeros(0, np.uint64)
    width = data[0]
    gaps = np.frombuffer(data, np.uint8, offset=9).reshape(-1, width)
    out = np.zeros((len(gaps) + 1, 8), np.uint8)
    out[0] = np.frombuffer(data, np.uint8, 8, 1)
    out[1:, :width] = gaps
    return np.cumsum(out.view("<u8").ravel(), dtype=np.uint64)


def _levels(total: np.ndarray) -> np.ndarray:
    """0 for a count of one, then 1 for two and 8 more for each doubling, up to 255."""
    out = np.zeros(len(total), np.uint8)
    more = total > 1
    out[more] = np.minimum(255, 1 + np.floor(8 * np.log2(total[more] / 2))).astype(np.uint8)
    return out


def _sent(block: int, values: np.ndarray, times: np.ndarray, buckets: int, top: int, second: np.ndarray | None = None) -> pa.Table:
    """A row for each bucket: a block's ascending values of that bucket, and what goes with them."""
    cuts = np.searchsorted(values >> np.uint64(top), np.arange(buckets + 1, dtype=np.uint64))
    out = []
    for k in np.flatnonzero(np.diff(cuts)).tolist():
        part = slice(cuts[k], cuts[k + 1])
        more = np.flatnonzero(times[part] > 1)
        out.append((block, k, _packed(values[part]), zlib.compress(np.concatenate([more, times[part][more]]).astype("<u4").tobytes(), 1), b"" if second is None else second[part].astype("<u8").tobytes()))
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*out)) or [[]] * 5, _SENT)], schema=_SENT)


_SENT = pa.schema([("block", pa.int32()), ("bucket", pa.int32()), ("hashes", pa.binary()), ("more", pa.binary()), ("second", pa.binary())])
SENT, REPLY = "block int, bucket int, hashes binary, more binary, second binary", "block int, bucket int, levels binary"


def _total(rows: pa.Table) -> pa.Table:
    """The levels of what the blocks sent to a bucket: for each row a byte for each of its values."""
    only("windows")
    own, times, second = [], [], []
    for data, more, also in zip(rows.column("hashes"), rows.column("more"), rows.column("second")):
        own.append(_unpacked(data.as_py()))
        n = np.ones(len(own[-1]), np.int64)
        at, extra = np.frombuffer(zlib.decompress(more.as_py()), "<u4").reshape(2, -1)
        n[at] = extra
        times.append(n)
        second.append(np.frombuffer(also.as_py(), "<u8"))
    ends = np.cumsum([len(x) for x in own])
    values, second = np.concatenate(own), np.concatenate(second)
    order = np.lexsort((second, values)) if len(second) else np.argsort(values, kind="stable")
    new = np.concatenate([[True], np.diff(values[order]) != 0])
    if len(second):
        new[1:] |= np.diff(second[order]) != 0
    sums = np.add.reduceat(np.concatenate(times)[order], np.flatnonzero(new))
    levels = np.empty(len(values), np.uint8)
    levels[order] = _levels(sums)[np.cumsum(new) - 1]
    back = [zlib.compress(x.tobytes(), 1) for x in np.split(levels, ends[:-1])]
    return pa.Table.from_arrays([rows.column("block").combine_chunks(), rows.column("bucket").combine_chunks(), pa.array(back, pa.binary())], names=["block", "bucket", "levels"])


def count_levels(blocks: DataFrame, scale: Scale, hashes_of) -> DataFrame:
    """Rows (block, bucket, levels): how often the corpus has each distinct hash of a block, in ascending order.

    hashes_of turns a block's documents into ascending distinct hashes of scale.bits bits, and the number of times the
    block has each. Each block sends each bucket one row with its hashes and has back one with a byte for each (see
    _levels), so that no count of a common hash meets more than a row per block.
    """
    top, buckets = scale.bits - scale.buckets.bit_length() + 1, scale.buckets

    def emit(rows: pa.Table) -> pa.Table:
        return _sent(rows.column("block")[0].as_py(), *hashes_of(unpack(rows.column("payload"))), buckets, top)

    return blocks.groupBy("block").applyInArrow(emit, SENT).groupBy("bucket").applyInArrow(_total, REPLY)


def count_again(blocks: DataFrame, scale: Scale, reply: DataFrame, pairs_of) -> DataFrame:
    """count_levels for what its reply left: pairs of 64-bit hashes, equal where both are.

    pairs_of turns documents and their block's levels into distinct pairs, ascending by both, and their numbers.
    """
    top, buckets = 65 - scale.buckets.bit_length(), scale.buckets

    def emit(rows: pa.Table, levels: pa.Table) -> pa.Table:
        if not rows.num_rows or not levels.num_rows:
            return _SENT.empty_table()
        first, second, times = pairs_of(unpack(rows.column("payload")), levels_of(levels))
        return _sent(rows.column("block")[0].as_py(), first, times, buckets, top, second)

    sent = blocks.groupBy("block").cogroup(reply.groupBy("block")).applyInArrow(emit, SENT)
    return sent.groupBy("bucket").applyInArrow(_total, REPLY)


def levels_of(reply: pa.Table) -> np.ndarray:
    """A block's levels in the order of its distinct hashes."""
    parts = sorted(zip(reply.column("bucket").to_pylist(), reply.column("levels")), key=lambda x: x[0])
    return np.frombuffer(b"".join(zlib.decompress(v.as_py()) for _, v in parts), np.uint8)
