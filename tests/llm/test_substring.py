import hashlib
import re
from collections import Counter

import numpy as np

from lumenframe.llm.substring import op10_substring_dedup, remove_repeats
from lumenframe.llm.windows import Words, _packed, _unpacked

from .fixtures import documents, odd_texts

SF = "/root/testdata/sf0.001"


def brute(rows, k):
    split = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    seen = Counter(tuple(w[j : j + k]) for _, w in split for j in range(len(w) - k + 1))
    out = []
    for i, w in split:
        gone = set()
        for j in range(len(w) - k + 1):
            if seen[tuple(w[j : j + k])] > 1:
                gone |= set(range(j, j + k))
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def test_op10_on_the_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    want = brute(rows, 35)
    assert sum(r[2] for r in want) > 0
    assert sorted(map(tuple, op10_substring_dedup(spark, SF).collect()), key=str) == want


def test_odd_rows_and_small_windows(spark):
    rows = odd_texts() + [(20, "a b a b a b c"), (21, "q a b c"), (22, "z\x1cz z z z z")]
    for k in (1, 2, 3, 5):
        got = remove_repeats(documents(spark, rows), window=k).collect()
        have = sorted(((r.doc_id, r.n_words, sum(s.end - s.start for s in r.spans), hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in got), key=str)
        assert have == brute(rows, k)
    assert remove_repeats(documents(spark, [])).count() == 0


def test_layout_and_carried_columns(spark):
    rows = [(1, "keep  this\nline"), (2, "x\ty  same same2 same3 z\n w"), (3, "same same2 same3")]
    got = {r.doc_id: r for r in remove_repeats(documents(spark, rows), window=3, carry=("source", "token"), keep_layout=True).collect()}
    assert [got[i].kept_text for i in (1, 2, 3)] == ["keep  this\nline", "x\ty z\n w", ""]
    assert got[1].source == "src0" and got[1].token == "x"


def test_word_hashes_do_not_depend_on_place():
    long = b"v" * 700_000
    a, b = Words([b"alpha beta", long + b" beta"], True), Words([b"Beta ALPHA " + long], True)
    assert a.hashes[1] == b.hashes[0] == a.hashes[3] and a.hashes[0] == b.hashes[1] and a.hashes[2] == b.hashes[2]
    assert len({int(h) for h in a.hashes}) == 3


def test_packed_values_come_back():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 1000):
        v = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2))
        assert (_unpacked(_packed(v)) == v).all()


def test_few_hash_bits_only_cost_work(spark, monkeypatch):
    from lumenframe.llm import windows

    made = windows.Scale.__init__

    def few(self, n_bytes):
        made(self, n_bytes)
        self.bits = 8

    monkeypatch.setattr(windows.Scale, "__init__", few)
    rows = odd_texts() + [(20, "a b a b a b c"), (21, "q a b c")]
    got = remove_repeats(documents(spark, rows), window=3).collect()
    assert sorted(((r.doc_id, r.n_words, sum(s.end - s.start for s in r.spans), hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in got), key=str) == brute(rows, 3)


def test_carried_columns_of_any_name(spark):
    rows = spark.createDataFrame([(1, "a b c", "x", 5, 6)], "doc_id bigint, text string, spans string, block int, doc_text int")
    got = remove_repeats(rows, carry=("spans", "block", "doc_text"))
    assert got.columns == ["doc_id", "n_words", "spans", "kept_text", "carried_spans", "block", "doc_text"]
    assert got.select("doc_id", "kept_text", "carried_spans", "block", "doc_text").collect() == [(1, "a b c", "x", 5, 6)]
