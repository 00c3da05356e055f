import random
import time

import numpy as np

from lumenframe.llm import toxicity
from lumenframe.llm.toxicity import Model, op2_toxicity, score, segments, train

from .fixtures import documents, odd_texts

SF = "/root/testdata/sf0.01"


def brute_segments(values):
    """The definition: the best segment, then the best ones on either side of it."""
    best, where = 0.0, None
    for i in range(len(values)):
        for j in range(i + 1, len(values) + 1):
            s = sum(values[i:j])
            if s > best + 1e-12:
                best, where = s, (i, j)
    if not where:
        return []
    i, j = where
    left, right = brute_segments(values[:i]), brute_segments(values[j:])
    return left + [(i, j)] + [(a + j, b + j) for a, b in right]


def test_segments_equal_their_definition():
    rng = random.Random(3)
    for _ in range(300):
        values = [rng.choice([-0.31, -0.31, 0.7, 1.13, 2.9]) + rng.random() * 1e-3 * 0 for _ in range(rng.randrange(0, 14))]
        at = np.flatnonzero(np.array(values) > 0)
        got = segments(at, np.array(values)[at], 0.31) if len(at) else []
        want = brute_segments(values)
        assert sum(s for *_, s in got) == __import__("pytest").approx(sum(sum(values[i:j]) for i, j in want))
        assert len(got) == len(want)


def test_op2_held_out_accuracy(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = op2_toxicity(spark, SF)
    assert got.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    rows = got.join(labels, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.toxic for r in rows) >= 0.93 * len(rows)


def test_odd_rows_and_no_labels(spark):
    docs = documents(spark, odd_texts())
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    model = train(docs, none)
    got = score(docs, model).collect()
    assert len(got) == len(odd_texts()) and all(0 <= r.score <= 1 and r.passages == [] for r in got)
    one = spark.createDataFrame([(4, 1, None), (5, 1, 0), (None, 1, 1)], "doc_id bigint, quality int, toxic int")
    assert score(docs, train(docs, one)).where("score > 0.5").count() == 0
    assert score(documents(spark, []), model).count() == 0


def test_passages_are_found_in_whole_texts(spark):
    model = Model({"idiot": 6.0, "scum": 6.0}, location=-9.0, decay=0.5, slope=1.0, bias=-3.0)
    filler = "word " * 50_000
    row = score(documents(spark, [(1, filler + "you idiot scum " + filler + "Scum, IDIOT scum"), (2, filler)]), model).orderBy("doc_id").collect()
    assert [(p.start, p.end) for p in row[0].passages] == [(50_001, 50_003), (100_003, 100_006)]
    assert row[0].score > 0.5 > row[1].score


def test_segments_in_linear_time():
    """A million scoring words, with sums that fall, rise and stay."""
    rng = np.random.default_rng(1)
    for gap in (2, 5):
        at = np.arange(1_000_000) * gap
        for values in (np.full(len(at), 0.2), np.full(len(at), 1.0), rng.random(len(at)), np.sort(rng.random(len(at)))):
            began = time.perf_counter()
            assert toxicity.segments(at, values, 0.3)
            assert time.perf_counter() - began < 3


def test_sample_is_bounded_where_ids_repeat(spark):
    docs = spark.range(500).selectExpr("id % 5 AS doc_id", "concat('text ', id) AS text")
    labels = spark.range(5).selectExpr("id AS doc_id", "cast(id % 2 AS int) AS toxic", "1 AS quality")
    rows = toxicity._sample(docs, labels, 3).collect()
    assert 0 < len(rows) <= 3 and len({r.doc_id for r in rows}) == len(rows)
