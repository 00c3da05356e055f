import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.llm import jaccard
from lumenframe.llm.jaccard import near_duplicates, op3_ngram_jaccard

from .fixtures import documents, odd_texts

SF = "/root/testdata/sf0.001"


def brute(rows, k=5):
    sets = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
        sets.append((i, {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()))
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and min(len(x), len(y)) * 10 >= 8 * max(len(x), len(y)):
                n = len(x & y)
                if 100 * n >= 80 * (len(x) + len(y) - n):
                    root[max(find(a), find(b))] = min(find(a), find(b))
    groups = {}
    for x, (i, s) in enumerate(sets):
        groups.setdefault(find(x), []).append(i)
    low = {g: min((i for i in ids if i is not None), default=None) for g, ids in groups.items()}
    return sorted(((i, len(s), low[find(x)]) for x, (i, s) in enumerate(sets)), key=str)


def triples(found):
    return found.select("doc_id", "n_shingles", "component_id").collect()


def edited(rng, words, share):
    return " ".join(rng.choice("pqrst") + str(rng.random()) if rng.random() < share else w for w in words)


def test_op3_on_the_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    want = brute(rows)
    assert any(i != c for i, _, c in want)
    assert sorted(map(tuple, triples(op3_ngram_jaccard(spark, SF))), key=str) == want


@pytest.mark.parametrize("short", [2, 48])
def test_groups_of_edited_copies(spark, monkeypatch, short):
    monkeypatch.setattr(jaccard, "SHORT_LIST", short)
    rng, rows = random.Random(short), []
    passage = [f"shared{i}" for i in range(60)]
    for g in range(6):
        words = [f"w{rng.randrange(400)}" for _ in range(rng.choice([6, 30, 120, 200]))]
        rows += [(len(rows) + j, edited(rng, words, rng.choice([0, 0.005, 0.02, 0.04]))) for j in range(12)]
    rows += [(1000 + j, " ".join(passage + [f"own{j}_{i}" for i in range(rng.randrange(5, 40))])) for j in range(15)]
    rows += [(2000 + j, " ".join(passage[: 60 - j])) for j in range(30)]
    rows += [(i if i is None else i + 5000, t) for i, t in odd_texts()] + [(7000, "A b C"), (7001, "a B c"), (7002, "a b")]
    rng.shuffle(rows)
    assert sorted(map(tuple, triples(near_duplicates(documents(spark, rows)))), key=str) == brute(rows)


def test_links_by_short_and_long_lists_together(spark):
    """Words that 30 to 70 of the documents hold: a prefix has lists on both sides of SHORT_LIST, neither enough alone."""
    rng, rows = random.Random(9), []
    mid, weights = [f"mid{i}" for i in range(90)], [30 + 40 * i / 89 for i in range(90)]
    for _ in range(150):
        own = sorted(dict.fromkeys(rng.choices(mid, weights, k=60)), key=lambda w: rng.random())[:20]
        common = [f"common{i}" for i in rng.sample(range(100), 35)]
        rows += [(len(rows) + j, " ".join(own[5 * j : 15 + 5 * j] + common)) for j in range(2)]
    rng.shuffle(rows)
    want = brute(rows, 1)
    assert sum(i != c for i, _, c in want) == 150
    assert sorted(map(tuple, triples(near_duplicates(documents(spark, rows), k=1))), key=str) == want


def test_pairs_at_the_threshold_in_a_template(spark):
    """89 of 111 shingles: each pair shares a rare word and a passage that all 120 documents hold."""
    rows = []
    for p in range(60):
        for side in "ab":
            rows.append((len(rows), " ".join([*(f"t{i}" for i in range(92)), f"x{p}", *(f"{side}{p}w{i}" for i in range(11))])))
    want = brute(rows)
    assert sum(i != c for i, _, c in want) == 60
    assert sorted(map(tuple, triples(near_duplicates(documents(spark, rows)))), key=str) == want


def random_corpus(rng):
    """Templates, edits of them, and words of all frequencies."""
    rows, common = [], [f"c{i}" for i in range(30)]
    for g in range(rng.randrange(1, 4)):
        n = rng.choice([3, 8, 20, 45])
        base = [rng.choice(common) if rng.random() < 0.5 else f"g{g}_{i}" for i in range(n)]
        for _ in range(rng.randrange(2, 25)):
            words = [w if rng.random() > rng.choice([0, 0.03, 0.1, 0.2]) else rng.choice([f"r{rng.randrange(50)}", f"u{rng.random()}"]) for w in base]
            rows.append(words[: rng.randrange(max(1, n - 6), n + 1)])
    rng.shuffle(rows)
    return [(i, " ".join(w)) for i, w in enumerate(rows)]


@pytest.mark.parametrize("short,ell", [(2, 1), (2, 3), (5, 8), (48, 4)])
def test_random_corpora(spark, monkeypatch, short, ell):
    """Fifty corpora in one table: their words carry the corpus's name, so that they are separate."""
    monkeypatch.setattr(jaccard, "SHORT_LIST", short)
    monkeypatch.setattr(jaccard, "MOST_MATCHES", ell)
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    rng, rows, want = random.Random(100 * short + ell), [], []
    for c in range(50):
        own = [(1000 * c + i, " ".join(f"{w}@{c}" for w in t.split())) for i, t in random_corpus(rng)]
        rows += own
        want += brute(own, 2)
    assert sum(i != c for i, _, c in want) > 100
    assert sorted(map(tuple, triples(near_duplicates(documents(spark, rows), k=2))), key=str) == sorted(want, key=str)


def test_open_lists_are_compared_in_bounded_groups(spark, monkeypatch):
    """3,000 unlinked sets in one long list: no group has more than some 2 * BLOCK rows, and no pair is verified."""
    monkeypatch.setattr(jaccard, "BLOCK", 256)
    rng = np.random.default_rng(5)
    rest = [(7, i, 125, 20, True, i, i == 0, rng.bytes(128), 2999, 3000) for i in range(3000)]
    rest = spark.createDataFrame(rest, "token bigint, fp bigint, n_shingles bigint, place int, indexed boolean, component bigint, in_main boolean, sketch binary, others bigint, size bigint")
    assert jaccard._open_pairs(rest, 80).count() == 0
    near = rest.withColumn("sketch", F.lit(bytes(128)))
    assert jaccard._open_pairs(near, 80).distinct().count() == 3000 * 2999 // 2


def test_template_in_many_unlinked_documents(spark):
    """A passage of 100 words in 4,000 documents with 40 words of their own: its lists have no index entry."""
    words = " ".join(f"t{i}" for i in range(104))
    docs = spark.range(4000).selectExpr("id AS doc_id", f"concat('{words} ', array_join(transform(sequence(1, 40), i -> concat('u', id, '_', i)), ' ')) AS text")
    sets = jaccard.shingle_sets(docs)
    assert sets.where("fp is not null").count() == 0
    docs = docs.withColumn("text", F.concat("text", F.lit(" "), F.concat(F.lit("pair"), F.floor(F.col("doc_id") / 2).cast("string"))))
    found = near_duplicates(docs)
    assert found.where("component_id <> doc_id").count() == 0


def test_kept_rows(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(2, text), (1, text + " more"), (1, "other words here"), (3, "other words here"), (None, text), (None, "alone"), (None, "alone"), (5, None), (5, "")]
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in near_duplicates(documents(spark, rows)).collect()), key=str)
    assert got == sorted([(2, 1, False), (1, 1, True), (1, 1, True), (3, 1, False), (None, 1, False), (None, None, True), (None, None, True), (5, 5, True), (5, 5, True)], key=str)


def test_no_rows(spark):
    assert near_duplicates(documents(spark, [])).count() == 0
    assert near_duplicates(documents(spark, [(1, None), (2, "")])).count() == 2
