import hashlib
import random
import zlib

import numpy as np
import pytest

from lumenframe.llm import pieces
from lumenframe.llm.pieces import Vocabulary, backtrace, combine, encode_documents, op4_sentencepiece, transfer
from lumenframe.llm.tokens import tokenizer_path

from .fixtures import documents, odd_texts

PATH, SF = tokenizer_path("piece_bpe_32k.model"), "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def v():
    return Vocabulary(PATH)


def brute(v, text):
    """Best path over the whole text, without words, chunks or a cache, back to front in plain Python."""
    best, step = [None] * len(text) + [(0.0, b"")], [None] * len(text)
    for i in reversed(range(len(text))):
        options = [(v.scores[text[i:j]] + best[j][0], j) for j in range(i + 1, min(len(text), i + v.width) + 1) if text[i:j] in v.scores]
        if text[i] not in v.scores:
            options.append((v.unknown + best[i + 1][0], i + 1))
        score, step[i] = max(options, key=lambda x: (x[0], -x[1]))
        best[i] = (score, b"")
    cuts = [0]
    while cuts[-1] < len(text):
        cuts.append(step[cuts[-1]])
    return v.spell(text, cuts)


def total(v, ids):
    """The sum of scores of a path; each byte counts as a share of an unknown character, so compare equal texts only."""
    return sum(v.scores.get(v.text.get(i, ""), 0.0) for i in np.frombuffer(ids, "<u4").tolist())


def same_path(v, got, want):
    """Equal, or another path of the same score through the same text."""
    return got == want or (total(v, got) == total(v, want) and v.decode(got) == v.decode(want))


def test_words_change_nothing(v):
    for _, t in odd_texts():
        if t and len(t) < 3000:
            n = v.model.normalize(t)
            assert same_path(v, v.encode(n), brute(v, n))


def test_batches_equal_word_by_word(v):
    rng = random.Random(8)
    words = ["".join(rng.choice("aeinrst▁日🙂é0,.") for _ in range(rng.randrange(0, 20))) for _ in range(3000)]
    assert v.solve(words) == [v.spell(w, v.path(w)) if w else b"" for w in words]
    assert all(same_path(v, x, brute(v, w)) for w, x in zip(words, v.solve(words)))


def test_scan_over_chunks_is_the_best_path(v):
    rng = random.Random(2)
    for _ in range(25):
        text = v.model.normalize("".join(rng.choice(["the", "ing", " ", "  ", "é", "日", "🙂", "x", "tion"]) for _ in range(rng.randrange(1, 60))))
        size = rng.choice([3, 7, 20, 64])
        chunks = [(text[s : s + size + v.width - 1], min(size, len(text) - s)) for s in range(0, len(text), size)]
        found = [transfer(v, *c) for c in chunks]
        got = b"".join(backtrace(v, *c, *s) for c, s in zip(chunks, pieces.states(found, 0, 0)))
        assert same_path(v, got, brute(v, text))
        if len(found) > 2:
            assert np.allclose(combine(combine(found[0], found[1]), found[2]), combine(found[0], combine(found[1], found[2])))


def test_documents_with_short_chunks(spark, v):
    rows = odd_texts()
    for chunk in (40, pieces.CHUNK):
        got = encode_documents(documents(spark, rows), PATH, chunk=chunk).collect()
        assert sorted(r.decoded for r in got) == sorted((t or "") for _, t in rows)
        assert sorted(bytes(r.merged_ids) for r in got) == sorted(np.array(v.model.encode(t or ""), "<u4").tobytes() for _, t in rows)
        by = {r.decoded: bytes(r.ids) for r in got}
        assert all(same_path(v, by[t or ""], brute(v, v.model.normalize(t) if t else "")) for _, t in rows)
    assert encode_documents(documents(spark, []), PATH).count() == 0


def test_chunks_over_a_tree_of_levels(spark, v, monkeypatch):
    """Each chunk has its own row; a fan of 3 gives several levels, with documents of different depth and equal ids."""
    monkeypatch.setattr(pieces, "FAN", 3)
    rng = random.Random(6)
    texts = ["".join(rng.choice(["the", "ing", " ", "é", "日本", "🙂", "x", "tion", " well"]) for _ in range(n)) for n in (400, 90, 8, 30)] + ["", "日本語" * 60]
    rows = [(7, t) for t in texts]
    got = pieces.encode_chunks(documents(spark, rows), PATH, chunk=16).collect()
    by = {}
    for r in sorted(got, key=lambda r: r.k):
        by.setdefault(r.key, []).append(r)
    assert len(by) == len(texts) and max(map(len, by.values())) > 27
    found = {"".join(r.decoded for r in own): own for own in by.values()}
    for t in texts:
        own, norm = found[t], v.model.normalize(t) if t else ""
        assert [r.k for r in own] == list(range(len(own)))
        assert same_path(v, b"".join(bytes(r.ids) for r in own), brute(v, norm))
        assert b"".join(bytes(r.merged_ids) for r in own) == np.array(v.model.encode(t), "<u4").tobytes()


def test_op4_on_the_table(spark, v):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    for r in op4_sentencepiece(spark, SF).collect():
        t = texts[r.doc_id]
        assert r.decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()
        assert r.merged_crc32 == zlib.crc32(np.array(v.model.encode(t), "<u4").tobytes())
        if len(t) < 2000:
            n = v.model.normalize(t)
            assert r.ids_crc32 == zlib.crc32(v.spell(n, v.path(n)))
