"""Operator 4: SentencePiece encoding and decoding by a max-plus scan over chunks of texts."""

from __future__ import annotations

import array
import bisect
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, only, ship, table, worker_cache
from .tokens import tokenizer_path

#: Normalised characters of a chunk; longer texts are cut.
CHUNK = 1 << 16
#: Word encodings kept by a Python worker.
CACHE_WORDS = 300_000
#: Matrices, or nodes of a level, that one task combines into a node of the next.
FAN = 64

_SPACE = "▁"
_CUT = re.compile(f"(?<=[^{_SPACE}])(?={_SPACE})")
_vocabularies: dict[str, "Vocabulary"] = worker_cache("pieces")


class Vocabulary:
    """Pieces and scores of a SentencePiece model, and the best path through a text by the sum of scores.

    Every normal piece may be used; a character without a piece costs ten more than the worst piece and becomes its
    UTF-8 bytes. Where no piece has a space mark after another character, as in models trained with whitespace
    splitting, every path has a cut before each run of space marks, so words are solved once and remembered.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        m = self.model
        ids = [i for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))]
        self.ids = {m.id_to_piece(i): i for i in ids}
        self.scores = {m.id_to_piece(i): float(m.get_score(i)) for i in ids}
        self.width = max(map(len, self.ids), default=1)
        self.unknown = min(self.scores.values(), default=0.0) - 10
        self.bytes = [m.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.text = {i: p for p, i in self.ids.items()}
        self.splits = not any(_CUT.search(p) for p in self.ids)
        self._grow_tree()
        shown = {i: p.replace(_SPACE, " ").encode() for i, p in self.text.items()} | {i: bytes([b]) for b, i in enumerate(self.bytes)}
        self.shown = [shown.get(i, b"") for i in range(m.get_piece_size())]
        self.cache: dict[str, bytes] = {}
        self.merged: dict[str, bytes] = {}

    def words(self, text: str) -> list[str]:
        return _CUT.split(text) if self.splits else [text]

    def forward(self, text: str, stop: int, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best scores, and starts of last pieces, at each place of text for several starts at once (columns).

        start: scores at the first places. Pieces begin before stop, and may end after it.
        """
        n, k = len(text), start.shape[1]
        best = np.full((n + 1, k), -np.inf)
        best[: len(start)] = start[: n + 1]
        last = np.full((n + 1, k), -1)
        scores = self.scores
        for i in range(min(stop, n)):
            own = best[i]
            if not (own > -np.inf).any():
                continue
            for j in range(i + 1, min(n, i + self.width) + 1):
                s = scores.get(text[i:j])
                if s is None:
                    if j > i + 1:
                        continue
                    s = self.unknown
                better = own + s > best[j]
                best[j] = np.where(better, own + s, best[j])
                last[j] = np.where(better, i, last[j])
        return best, last

    def _grow_tree(self) -> None:
        """The pieces as a tree in arrays: a step from a node by a character is found by its number in steps."""
        codes = {c: k + 1 for k, c in enumerate(sorted({c for p in self.ids for c in p}))}
        self.codes = np.zeros(0x110000, np.int64)
        for c, k in codes.items():
            self.codes[ord(c)] = k
        self.radix, nodes, ends = len(codes) + 1, {"": 0}, {}
        steps = {}
        for p, i in self.ids.items():
            for k in range(1, len(p) + 1):
                if p[:k] not in nodes:
                    nodes[p[:k]] = len(nodes)
                    steps[nodes[p[: k - 1]] * self.radix + codes[p[k - 1]]] = nodes[p[:k]]
            ends[nodes[p]] = i
        self.steps = np.array(sorted(steps), np.int64)
        self.below = np.array([steps[k] for k in self.steps.tolist()], np.int64)
        self.piece, self.gain = np.full(len(nodes), -1), np.full(len(nodes), -np.inf)
        for node, i in ends.items():
            self.piece[node], self.gain[node] = i, self.scores[self.text[i]]
        self.single = np.zeros(self.radix, bool)
        self.single[[codes[p] for p in self.ids if len(p) == 1]] = True

    def path(self, text: str) -> list[int]:
        """Cuts of the best path through one long word."""
        n, scores, width, unknown = len(text), self.scores, self.width, self.unknown
        best, last = [0.0] + [-np.inf] * n, [0] * (n + 1)
        for i in range(n):
            own = best[i]
            for j in range(i + 1, min(n, i + width) + 1):
                score = scores.get(text[i:j])
                if score is not None and own + score > best[j]:
                    best[j], last[j] = own + score, i
            if own + unknown > best[i + 1] and text[i] not in scores:
                best[i + 1], last[i + 1] = own + unknown, i
        cuts = [n]
        while cuts[-1]:
            cuts.append(last[cuts[-1]])
        return cuts[::-1]

    def solve(self, words: list[str]) -> list[bytes]:
        """Ids of the best paths through words: of all words of one length at once, of long ones one by one."""
        out: list[bytes] = [b""] * len(words)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(sizes, kind="stable")
        for some in np.split(order, np.flatnonzero(np.diff(sizes[order])) + 1) if len(order) else []:
            if not words[some[0]]:
                continue
            if len(words[some[0]]) > 48:
                for w in some.tolist():
                    out[w] = self.spell(words[w], self.path(words[w]))
                continue
            for k in range(0, len(some), 1 << 14):
                own = some[k : k + (1 << 14)].tolist()
                for w, ids in zip(own, self._solve([words[w] for w in own], len(words[own[0]]))):
                    out[w] = ids
        return out

    def _solve(self, words: list[str], n: int) -> list[bytes]:
        w = len(words)
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").reshape(w, n).T
        codes = self.codes[points]
        best, last, piece = np.full((n + 1, w), -np.inf), np.zeros((n + 1, w), np.int64), np.full((n + 1, w), -1)
        best[0] = 0.0
        for i in range(n):
            alive, node = np.arange(w), np.zeros(w, np.int64)
            for j in range(i, min(n, i + self.width)):
                step = node * self.radix + codes[j, alive]
                at = np.minimum(np.searchsorted(self.steps, step), len(self.steps) - 1)
                fine = self.steps[at] == step
                alive, node = alive[fine], self.below[at[fine]]
                if not len(alive):
                    break
                total = best[i, alive] + self.gain[node]
                better = total > best[j + 1, alive]
                to = alive[better]
                best[j + 1, to], last[j + 1, to], piece[j + 1, to] = total[better], i, self.piece[node[better]]
            to = np.flatnonzero((best[i] + self.unknown > best[i + 1]) & ~self.single[codes[i]])
            best[i + 1, to], last[i + 1, to], piece[i + 1, to] = best[i, to] + self.unknown, i, -1
        ids, count, at, row = np.empty((w, n), np.uint32), np.zeros(w, np.int64), np.full(w, n), np.arange(w)
        odd = np.zeros(w, bool)
        while len(row):
            count[row] += 1
            own = piece[at[row], row]
            odd[row] |= own < 0
            ids[row, n - count[row]] = own
            at[row] = last[at[row], row]
            row = row[at[row] > 0]
        out = [x[n - c :].tobytes() for x, c in zip(ids, count.tolist())]
        for k in np.flatnonzero(odd).tolist():
            cuts = [n]
            while cuts[-1]:
                cuts.append(int(last[cuts[-1], k]))
            out[k] = self.spell(words[k], cuts[::-1])
        return out

    def spell(self, text: str, cuts: list[int]) -> bytes:
        out = array.array("I")
        for a, b in zip(cuts, cuts[1:]):
            i = self.ids.get(text[a:b])
            if i is None:
                out.extend(self.bytes[x] for x in text[a:b].encode())
            else:
                out.append(i)
        return out.tobytes()

    def encode(self, text: str) -> bytes:
        """Ids, as little-endian unsigned 32-bit values, of the best path through a normalised text."""
        words = self.words(text) if text else []
        known = dict(zip(new := list(dict.fromkeys(words)), self.solve(new)))
        return b"".join(map(known.__getitem__, words))

    def both(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """encode and merges of normalised texts, by remembered words where each has one space mark before it."""
        ids, merged, split, new = self.cache, self.merged, [], {}
        for text in texts:
            words = text.split(_SPACE)
            if not self.splits or words[0] or "" in words[1:]:
                split.append(None)
            else:
                split.append(words[1:])
                new |= dict.fromkeys(w for w in words[1:] if w not in ids)
        fresh = list(new)
        own = dict(zip(fresh, self.solve([_SPACE + w for w in fresh])))
        other = {w: array.array("I", x).tobytes() for w, x in zip(fresh, self.model.encode(fresh, num_threads=1))} if fresh else {}
        if len(ids) + len(fresh) <= CACHE_WORDS:
            ids.update(own)
            merged.update(other)
            own = other = None
        out = []
        for text, words in zip(texts, split):
            if words is None:
                out.append((self.encode(text), self.merges(text)) if text else (b"", b""))
            elif own is None:
                out.append((b"".join(map(ids.__getitem__, words)), b"".join(map(merged.__getitem__, words))))
            else:
                out.append(tuple(b"".join([f[w] if w in f else k[w] for w in words]) for k, f in ((ids, own), (merged, other))))
        return out

    def merges(self, text: str) -> bytes:
        """Ids that the library's own algorithm for this model gives, word by word."""
        if not self.splits or not text.startswith(_SPACE):
            return array.array("I", self.model.encode(text[1:])).tobytes()
        # the library puts a space mark before what it encodes, but not before nothing
        found = (self.model.encode(w[1:].replace(_SPACE, " ")) if w != _SPACE else [self.ids[w]] for w in self.words(text))
        return b"".join(array.array("I", x).tobytes() for x in found)

    def decode(self, ids: bytes, first: bool = True) -> str:
        """The text of ids; first: they begin a text, with the space that normalising puts before it."""
        text = b"".join(map(self.shown.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode()
        return text[1:] if first else text


def vocabulary(path: str) -> Vocabulary:
    """The worker's vocabulary of that file."""
    only("pieces")
    if path not in _vocabularies:
        _vocabularies[path] = Vocabulary(path)
    return _vocabularies[path]


def _inner(v: Vocabulary, text: str, size: int) -> tuple[int, int] | None:
    """The first cut between words that no overhang reaches, and the last one of the chunk."""
    cuts = [m.start() for m in _CUT.finditer(text, 0, size + 1) if v.width <= m.start() <= size] if v.splits else []
    return (cuts[0], cuts[-1]) if cuts else None


def transfer(v: Vocabulary, text: str, size: int) -> np.ndarray:
    """Max-plus matrix of a chunk: best score from each overhang of the chunk before to each overhang into the next.

    text: the chunk of so many characters and v.width - 1 that follow it. An overhang is the number of characters at
    the start of a chunk that belong to a piece which began before it. Where words are cut whatever the overhangs, what
    lies between the first and the last cut adds the same to every entry, and is left out.
    """
    w = v.width
    inner = _inner(v, text, size)
    if inner:
        before, _ = v.forward(text[: inner[0]], inner[0], np.where(np.eye(w, dtype=bool), 0.0, -np.inf))
        after, _ = v.forward(text[inner[1] :], size - inner[1], np.zeros((1, 1)))
        ends = np.full(w, -np.inf)
        found = after[size - inner[1] : size - inner[1] + w, 0]
        ends[: len(found)] = found
        return before[inner[0]][:, None] + ends[None, :]
    start = np.full((w, w), -np.inf)
    np.fill_diagonal(start, 0.0)
    best, _ = v.forward(text, size, start)
    out = np.full((w, w), -np.inf)
    ends = best[size : size + w]
    out[:, : len(ends)] = ends.T
    for a in range(size + 1, w):  # a chunk shorter than a piece: the overhang goes on
        out[a, a - size] = max(out[a, a - size], 0.0)
    return out


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The matrix of two neighbouring chunks. Associative."""
    return (a[:, :, None] + b[None, :, :]).max(1)


def states(matrices: list[np.ndarray], entry: int, exit_: int) -> list[tuple[int, int]]:
    """Entry and exit overhang of each of some neighbouring chunks on the best path between two given overhangs."""
    w = len(matrices[0])
    reach, froms = np.full(w, -np.inf), []
    reach[entry] = 0.0
    for m in matrices:
        both = reach[:, None] + m
        froms.append(both.argmax(0))
        reach = both.max(0)
    found = [exit_]
    for f in reversed(froms):
        found.append(int(f[found[-1]]))
    found.reverse()
    return list(zip(found, found[1:]))


def backtrace(v: Vocabulary, text: str, size: int, entry: int, exit_: int) -> bytes:
    """Ids of the pieces that begin in the chunk, given both overhangs."""
    inner = _inner(v, text, size)
    if inner:
        a, b = inner
        return _traced(v, text[:a], a, entry, 0) + v.encode(text[a:b]) + _traced(v, text[b:], size - b, 0, exit_)
    return _traced(v, text, size, entry, exit_)


def _traced(v: Vocabulary, text: str, size: int, entry: int, exit_: int) -> bytes:
    start = np.full((entry + 1, 1), -np.inf)
    start[entry] = 0.0
    best, last = v.forward(text, size, start)
    cuts = [size + exit_]
    while cuts[-1] > entry:
        cuts.append(int(last[cuts[-1], 0]))
    return v.spell(text, cuts[::-1])


def border_states(leaves: DataFrame) -> DataFrame:
    """key, k, entry and exit: the overhangs at both ends of each chunk on the best path of its document.

    leaves: key, k (0, 1, ... in a document) and matrix. A scan over a tree: FAN neighbouring matrices are combined
    into one, which is right in any grouping as combining is associative, level by level until a document has one; from
    there the states at the borders are handed down. No task has more than FAN matrices of a document.
    """

    def up(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("k")
        total = None
        for m in _matrices(rows):
            total = m if total is None else combine(total, m)
        return pa.table({"key": rows.column("key")[:1], "k": pa.array([rows.column("k")[0].as_py() // FAN], pa.int64()), "matrix": pa.array([total.tobytes()], pa.binary())})

    def down(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("k")
        entry, exit_ = zip(*states(_matrices(rows), rows.column("entry")[0].as_py(), rows.column("exit")[0].as_py()))
        return pa.table({"key": rows.column("key"), "k": rows.column("k"), "entry": pa.array(entry, pa.int32()), "exit": pa.array(exit_, pa.int32())})

    levels = [leaves]
    while levels[-1].where("k > 0").limit(1).count():
        parent = F.floor(F.col("k") / FAN).alias("parent")
        levels.append(materialize(levels[-1].groupBy("key", parent).applyInArrow(up, "key string, k bigint, matrix binary"), "matrices"))
    found = levels.pop().select("key", "k", F.lit(0).alias("entry"), F.lit(0).alias("exit"))
    for level in reversed(levels):
        above = found.select("key", F.col("k").alias("parent"), "entry", "exit")
        both = level.withColumn("parent", F.floor(F.col("k") / FAN)).join(above, ["key", "parent"])
        found = both.groupBy("key", "parent").applyInArrow(down, "key string, k bigint, entry int, exit int")
    return found


def _matrices(rows: pa.Table) -> list[np.ndarray]:
    found = [np.frombuffer(m.as_py()) for m in rows.column("matrix")]
    side = math.isqrt(len(found[0]))
    return [m.reshape(side, side) for m in found]


def encode_chunks(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """doc_id, key, k, ids, merged_ids and decoded of each chunk of every text; put together in order of k they are the text's.

    See encode_documents. key is a document's own, also where ids repeat. Tasks of their own turn chunks into transfer
    matrices, which are combined over a tree (border_states), and each chunk is backtraced, decoded and, in
    whole words, encoded by the library's algorithm by itself. Words that begin in a chunk are merged with it.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.expr("uuid()").alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = materialize(rows, "long-texts")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for b in batches:
            for doc_id, key, text in zip(b.column(0), b.column(1).to_pylist(), b.column(2).to_pylist()):
                t = v.model.normalize(text) if text else ""
                starts = list(range(0, max(1, len(t)), chunk))
                words = [0, *(m.start() for m in _CUT.finditer(t))] if v.splits else [0]
                heads = [words[k] if (k := bisect.bisect_left(words, s)) < len(words) else len(t) for s in starts] + [len(t)]
                for k, s in enumerate(starts):
                    e = min(s + chunk, len(t))
                    row = [pa.array([x]) for x in (key, k, e - s, t[s : max(e + v.width - 1, heads[k + 1])], heads[k] - s, heads[k + 1] - s)]
                    yield pa.RecordBatch.from_arrays([pa.array([doc_id.as_py()], pa.int64()), *row], names=["doc_id", "key", "k", "size", "text", "head", "next_head"])

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for b in batches:
            found = [transfer(v, t[: n + v.width - 1], n).tobytes() for n, t in zip(b.column("size").to_pylist(), b.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("k"), pa.array(found, pa.binary())], names=["key", "k", "matrix"])

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for b in batches:
            ids, merged, decoded = [], [], []
            for x in b.to_pylist():
                ids.append(backtrace(v, x["text"][: x["size"] + v.width - 1], x["size"], x["entry"], x["exit"]))
                own = x["text"][x["head"] : x["next_head"]]
                merged.append(v.merges(own) if own else b"")
                decoded.append(v.decode(ids[-1], x["k"] == 0))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("key"), b.column("k"), pa.array(ids, pa.binary()), pa.array(merged, pa.binary()), pa.array(decoded, pa.string())], names=["doc_id", "key", "k", "ids", "merged_ids", "decoded"])

    chunks = rows.mapInArrow(cut, "doc_id bigint, key string, k bigint, size bigint, text string, head bigint, next_head bigint")
    chunks = materialize(chunks.repartition("key", "k"), "chunks")
    leaves = materialize(chunks.mapInArrow(matrices, "key string, k bigint, matrix binary"), "matrices")
    found = border_states(leaves)
    return chunks.join(found, ["key", "k"]).select("doc_id", "key", "k", "size", "text", "head", "next_head", "entry", "exit").mapInArrow(trace, "doc_id bigint, key string, k bigint, ids binary, merged_ids binary, decoded string")


def encode_documents(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """doc_id, ids and merged_ids (binary, little-endian unsigned 32-bit) and decoded for every whole text.

    ids: the best path by the sum of piece scores (see Vocabulary). merged_ids: what the library's own algorithm gives
    for the model, which for BPE models is merging and no maximisation. A text of more than chunk characters is worked
    on chunk by chunk (encode_chunks); only putting a document's parts together needs it in one row. Null and empty texts
    have no ids; rows of one id, also equal ones, are encoded one by one.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = "doc_id bigint, ids binary, merged_ids binary, decoded string"
    names = ["doc_id", "ids", "merged_ids", "decoded"]
    # a normalised text has one character more at most
    short, long = rows.where(F.char_length("text") < chunk), rows.where(F.char_length("text") >= chunk)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for whole_batch in batches:
            for at in range(0, whole_batch.num_rows, 512):
                b = whole_batch.slice(at, 512)
                ids, merged = zip(*v.both([v.model.normalize(t) if t else "" for t in b.column(1).to_pylist()]))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary()), pa.array(merged, pa.binary()), pa.array([v.decode(x) for x in ids], pa.string())], names=names)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = b.column("parts").to_pylist()
            put = lambda name, empty: [empty.join(x[name] for x in own) for own in parts]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(put("ids", b""), pa.binary()), pa.array(put("merged_ids", b""), pa.binary()), pa.array(put("decoded", ""), pa.string())], names=names)

    done = short.mapInArrow(whole, schema)
    if long.isEmpty():
        return done
    parts = encode_chunks(long, path, chunk=chunk).groupBy("key", "doc_id").agg(F.sort_array(F.collect_list(F.struct("k", "ids", "merged_ids", "decoded"))).alias("parts"))
    return done.union(parts.select("doc_id", "parts").mapInArrow(join, schema))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the encodings of all documents, and whether they decode to the text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = encode_documents(docs, tokenizer_path("piece_bpe_32k.model"))
    n = lambda c: (F.octet_length(c) / 4).cast("bigint")
    return found.select("doc_id", n("ids").alias("n_ids"), F.crc32("ids").alias("ids_crc32"), n("merged_ids").alias("n_merged"), F.crc32("merged_ids").alias("merged_crc32"), F.char_length("decoded").cast("bigint").alias("n_chars_decoded"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))
