import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from lumenframe.llm import packing, token_files, tokens
from lumenframe.llm.common import fresh_path
from lumenframe.llm.packing import op6_packing
from lumenframe.llm.token_files import op9_token_files

from .fixtures import documents, odd_texts

SF = "/root/testdata/sf0.001"


def library():
    t = Tokenizer.from_file(tokens.tokenizer_path())
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_piece_encoder_equals_the_library(spark):
    encode, enc = library(), tokens.PieceEncoder(tokens.tokenizer_path())
    texts = [t for _, t in odd_texts()] + [r[0] for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    texts += ["it's  they'll \n we've\n", " lead", "tail ", "\n", " ", "a \tb", "a\n b", "1 2\n3", " x \u0085y"]
    for t in texts:
        assert np.frombuffer(enc.encode(t), "<u4").tolist() == encode(t)


def test_strings_of_added_tokens():
    plain, text = library(), tokens.PieceEncoder(tokens.tokenizer_path(), specials_as_text=True)
    enc, t = tokens.PieceEncoder(tokens.tokenizer_path()), Tokenizer.from_file(tokens.tokenizer_path())
    t.encode_special_tokens = True
    for s in ("a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|>y\n z<|endoftext|>", "<|endoftext| >"):
        assert np.frombuffer(enc.encode(s), "<u4").tolist() == plain(s)
        assert np.frombuffer(text.encode(s), "<u4").tolist() == t.encode(s, add_special_tokens=False).ids
    assert plain("a <|endoftext|> b") == [64, 220, 50256, 275]


def test_cache_limit_changes_no_ids(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_PIECES", 3)
    enc, encode = tokens.PieceEncoder(tokens.tokenizer_path()), library()
    for t in ("a b c", "d e f g", "a d g h"):
        assert np.frombuffer(enc.encode(t), "<u4").tolist() == encode(t)


class Counted:
    """A tokenizer or model that counts what it is asked to encode."""

    def __init__(self, inner, calls):
        self.inner, self.calls = inner, calls

    def __getattr__(self, name):
        def call(*args, **kwargs):
            self.calls.append(args[0])
            return getattr(self.inner, name)(*args, **kwargs)

        return call if name in ("encode_batch_fast", "tokenize") else getattr(self.inner, name)


def test_pieces_beyond_the_cache_are_encoded_once_while_recent(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_PIECES", 3)
    enc, encode, calls = tokens.PieceEncoder(tokens.tokenizer_path()), library(), []
    for name in {"tokenizer", "words", "model"} & set(vars(enc)):
        setattr(enc, name, Counted(getattr(enc, name), calls))
    texts = ["one two three four, five. six### 7", "four, five. six### 7 one", " five. four, four, 7"]
    assert np.frombuffer(enc.encode(texts[0]), "<u4").tolist() == encode(texts[0])
    assert calls
    calls.clear()
    assert [np.frombuffer(enc.encode(t), "<u4").tolist() for t in texts[:1] + texts[2:]] == [encode(t) for t in texts[:1] + texts[2:]]
    assert not calls


@pytest.mark.parametrize("kept, recent", [(1, 1), (5, 2), (400_000, 40_000)])
def test_words_with_marks_and_accents_at_any_limit(monkeypatch, kept, recent):
    monkeypatch.setattr(tokens, "CACHE_PIECES", kept)
    monkeypatch.setattr(tokens, "RECENT_PIECES", recent, raising=False)
    enc, encode = tokens.PieceEncoder(tokens.tokenizer_path()), library()
    words = ["a", "Über", "straße", "ñandú", "œuvre", "Łódź", "ɐb", "ﬁn", "don't", "x,", "x.", "x,.", ",", ".", ",,", "ß.", "7.", "été,", "ÀB", "日本", "e\u0301", "ʼn", "\u200bz", "q\u00adr", "😀,"]
    for text in [" ".join(words), "\n".join(words), " " + " ".join(reversed(words)), *words, *(" " + w for w in words)] * 2:
        assert np.frombuffer(enc.encode(text), "<u4").tolist() == encode(text)


@pytest.mark.parametrize("chars", [1, 40, 8 << 20])
def test_many_texts_at_once_equal_the_library(monkeypatch, chars):
    monkeypatch.setattr(tokens, "BATCH_CHARS", chars)
    enc, encode = tokens.PieceEncoder(tokens.tokenizer_path()), library()
    texts = [None, "", "a b,  c", *(t for _, t in odd_texts()), "a<|endoftext|>", "\n", " ", "tail ", None, "one\ntwo three### été$$$, x&&&", ""]
    for some in (texts, [], [None, ""], ["a b"], ["a  b", "c  d"]):
        assert [np.frombuffer(i, "<u4").tolist() for i in enc.encode_many(some)] == [encode(t) for t in some]


def test_marks_after_words():
    enc, encode = tokens.PieceEncoder(tokens.tokenizer_path()), library()
    marks = [chr(c) for c in range(33, 127) if not chr(c).isalnum()]
    texts = [f"{w}{m}{x}" for w in ("Word", " été", "s", "") for m in marks for x in ("", ",", "###", "'s", "x", "....", "!!!!!!")]
    assert [np.frombuffer(enc.encode(t), "<u4").tolist() for t in texts] == [encode(t) for t in texts]
    assert [np.frombuffer(i, "<u4").tolist() for i in enc.encode_many(texts)] == [encode(t) for t in texts]


def expected_files(rows, end):
    encode, start, out = library(), 0, []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = encode(t) + [end]
        out.append((i, start, len(ids), crc(ids)))
        start += len(ids)
    return out


def test_token_files_round_trip(spark):
    out = fresh_path(spark, "t")
    token_files.write_token_files(documents(spark, odd_texts()), out, tokens.tokenizer_path(), shard_tokens=500)
    got = sorted((tuple(r) for r in token_files.read_digests(spark, out).collect()), key=lambda r: r[1])
    assert got == expected_files(odd_texts(), 2)
    some = {r.doc_id: r.ids for r in token_files.fetch(spark, out, [4, 8]).collect()}
    assert some == {4: library()(dict(odd_texts())[4]) + [2], 8: library()(dict(odd_texts())[8]) + [2]}


def test_fetch_decodes_only_what_is_asked(spark):
    """All other frames are broken: fetch does not touch them."""
    out, broken = fresh_path(spark, "t"), fresh_path(spark, "t")
    rows = [(i, f"text number {i} " * (1 + i % 5)) for i in range(40)]
    token_files.write_token_files(documents(spark, rows), out, tokens.tokenizer_path())

    def spoil(batches):
        for b in batches:
            payloads = []
            for r in b.to_pylist():
                data, begin = bytearray(r["payload"]), 0
                for i, end in zip(r["doc_ids"], r["ends"]):
                    if i not in (7, 30):
                        data[begin:end] = b"\0" * (end - begin)
                    begin = end
                payloads.append(bytes(data))
            at = b.schema.get_field_index("payload")
            yield b.set_column(at, "payload", pa.array(payloads, pa.binary()))

    spark.read.parquet(f"{out}/shards").mapInArrow(spoil, token_files.SHARD).write.parquet(f"{broken}/shards")
    spark.read.parquet(f"{out}/dictionary").write.parquet(f"{broken}/dictionary")
    got = {r.doc_id: r.ids for r in token_files.fetch(spark, broken, [7, 30, 99]).collect()}
    assert got == {i: library()(dict(rows)[i]) + [2] for i in (7, 30)}
    assert {r.doc_id for r in token_files.fetch(spark, out, list(range(10, 90))).collect()} == set(range(10, 40))


def test_many_short_documents_in_linear_time(spark):
    times = []
    for n in (20_000, 80_000):
        out, began = fresh_path(spark, "t"), time.perf_counter()
        token_files.write_token_files(spark.range(n).selectExpr("id % 3 AS doc_id", "'' AS text"), out, tokens.tokenizer_path())
        times.append(time.perf_counter() - began)
        assert token_files.read_digests(spark, out).agg({"start": "max"}).first()[0] == n - 1
    assert times[1] < 4 * times[0] + 2


def test_token_files_of_nothing(spark):
    out = fresh_path(spark, "t")
    token_files.write_token_files(documents(spark, []), out, tokens.tokenizer_path())
    assert token_files.read_digests(spark, out).count() == 0


def test_op9_on_the_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, op9_token_files(spark, SF).collect()), key=lambda r: r[1]) == expected_files(rows, 2)


def check_packing(rows, got, capacity):
    encode = library()
    want = []
    for i, t in rows:
        ids = encode(t) + [0]
        first = (len(ids) - 1) % capacity + 1
        cuts = [0, *range(first, len(ids) + 1, capacity)]
        want += [(i, k, a, b - a, crc(ids[a:b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    key = lambda r: (r[0] is not None, r[0] or 0, *r[1:])
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=key) == sorted(want, key=key)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in by.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by), sum(r.length for r in got)


def test_op6_on_the_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    sequences, total = check_packing(rows, op6_packing(spark, SF).collect(), 2048)
    assert sequences <= 1.02 * total / 2048 + 1


@pytest.mark.parametrize("capacity", [16, 2048])
def test_packing_odd_rows(spark, capacity):
    rows = odd_texts()
    got = packing.pack_documents(documents(spark, rows), tokens.tokenizer_path(), capacity=capacity).collect()
    check_packing(rows, got, capacity)
    assert packing.pack_documents(documents(spark, []), tokens.tokenizer_path()).count() == 0


def test_pack_keeps_columns_of_any_name(spark):
    rows = [(i, 0, 5 + i % 3, i, -i, i * 2, i * 3, -1) for i in range(50)]
    pieces = spark.createDataFrame(rows, "doc_id bigint, piece int, length bigint, block bigint, rank bigint, before bigint, place bigint, offset bigint")
    got = packing.pack(pieces, capacity=16)
    assert got.columns == [*pieces.columns[:-1], "sequence_id", "offset"]
    assert sorted(tuple(r)[:7] for r in got.collect()) == [r[:7] for r in rows]


def test_plan_equals_one_by_one_best_fit():
    rng = np.random.default_rng(0)
    for _ in range(60):
        capacity = int(rng.integers(3, 40))
        lengths = rng.integers(1, capacity + 1, rng.integers(1, 200))
        hist = dict(zip(*(x.tolist() for x in np.unique(lengths, return_counts=True))))
        rooms = []
        for n in sorted(lengths, reverse=True):
            fits = [i for i, r in enumerate(rooms) if r >= n]
            if fits:
                rooms[min(fits, key=lambda i: rooms[i])] -= n
            else:
                rooms.append(capacity - n)
        used = {}
        for length, a, b, first, offset in packing.plan_best_fit(hist, capacity):
            for k in range(b - a):
                used.setdefault(first + k, []).append((offset, length))
        assert len(used) == len(rooms)
        assert sorted(capacity - sum(n for _, n in v) for v in used.values()) == sorted(rooms)
