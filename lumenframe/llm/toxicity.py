"""Operator 2: toxic passages as maximum-scoring segments of token log-odds."""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import only, ship, table

_WORD = re.compile(r"\w+")
#: Lengths of the word beginnings that stand in for rare forms of a word.
STEMS = (4, 5, 6)
SCORED = "doc_id bigint, score double, evidence double, passages array<struct<start:bigint,end:bigint,score:double,p:double>>"


class _Known(dict):
    """Scores of the words met so far by a worker; others are worked out, and remembered up to a limit."""

    def __init__(self, score):
        super().__init__()
        self.score = score

    def __missing__(self, word: str) -> float:
        found = self.score(word)
        if len(self) < 300_000:
            self[word] = found
        return found


@dataclass
class Model:
    """scores: log-odds of telling words ("idiot") and beginnings ("idio+"); every other word scores -step.

    location, decay: the extreme-value law of the best segment of clean texts (see segments); slope, bias: from
    evidence to log-odds of a toxic document.
    """

    scores: dict[str, float] = field(default_factory=dict)
    step: float = 0.3
    location: float = 1.0
    decay: float = 1.0
    slope: float = 0.0
    bias: float = -2.0
    known: _Known | None = field(default=None, repr=False, compare=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"known": None}

    def word(self, w: str) -> float:
        forms = [self.scores.get(w), *(self.scores.get(w[:k] + "+") for k in STEMS if len(w) >= k)]
        return max((f for f in forms if f is not None), default=-self.step)

    def values(self, words: list[str]) -> np.ndarray:
        if self.known is None:
            self.known = _Known(self.word)
        return np.fromiter(map(self.known.__getitem__, words), float, len(words))


def telling_words(text: str, model: Model) -> tuple[np.ndarray, np.ndarray, int]:
    """Places and scores of words that score above zero, and the number of words."""
    values = model.values(_WORD.findall(text.lower()))
    at = np.flatnonzero(values > 0)
    return at, values[at], len(values)


def segments(at: np.ndarray, values: np.ndarray, step: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score), in linear time over the words that score above zero.

    The words between them score -step each. Candidates are kept with the sums before and after them, and one is
    joined with an earlier one whenever that gives more than either. Each candidate knows the last one before it with
    a lower sum; a search goes along these links, so that what one search has passed over no later one looks at.
    """
    kept: list[tuple[float, float, int, int, int]] = []
    total, last = 0.0, 0
    for place, value in zip(at.tolist(), values.tolist()):
        total -= step * (place - last)
        last = place + 1
        low, start, high, end = total, place, total + value, place + 1
        total = high
        k = len(kept) - 1
        while True:
            while k >= 0 and kept[k][0] >= low:
                k = kept[k][4]
            if k < 0 or kept[k][1] >= high:
                kept.append((low, high, start, end, k))
                break
            low, _, start, _, before = kept[k]
            del kept[k:]
            k = before
    return [(start, end, high - low) for low, high, start, end, _ in kept]


def evidence(text: str, model: Model) -> tuple[float, list[tuple[int, int, float, float]]]:
    """Sum of -log p over the segments, and the segments with their p: the chance that a clean text of that length has one as good."""
    at, values, n = telling_words(text, model)
    found, total = [], 0.0
    for start, end, value in segments(at, values, model.step) if len(at) else []:
        expected = n * math.exp(max(-700.0, min(50.0, model.location - model.decay * value)))
        p = -math.expm1(-expected) if expected < 30 else 1.0
        total -= math.log(max(p, 1e-300))
        if p <= 0.05:
            found.append((start, end, value, p))
    return total, found


def _features(text: str) -> list[str]:
    words = set(_WORD.findall(text.lower()))
    return sorted(words | {w[:k] + "+" for w in words for k in STEMS if len(w) >= k})


def _signature(text: str) -> int:
    """The least hash of three neighbouring words; near copies mostly have the same."""
    words = _WORD.findall(text.lower())
    return min((zlib.crc32(" ".join(words[i : i + 3]).encode()) for i in range(max(1, len(words) - 2))), default=0)


def _sample(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """doc_id, text and toxic (0 or 1) of the rows labelled ids that come first by hash; at most so many are broadcast.

    A repeated id gives one text, that of the least hash, so that there are no more rows than that either.
    """
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    known = known.where(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) != 0)
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    found = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(known), "doc_id")
    found = found.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("by"), "text")).alias("least"), F.max("toxic").alias("toxic"))
    return found.select("doc_id", F.col("least.text").alias("text"), "toxic").repartition(32, "doc_id")


def train(docs: DataFrame, labels: DataFrame, *, rows: int = 8192, least_docs: int = 3, most_features: int = 50_000) -> Model:
    """A model from at most rows labelled documents (crc32 of the id modulo 5 not 0).

    Log-odds of a feature between toxic and other documents have a Dirichlet prior with the feature's overall
    rate. Kept are features of least_docs toxic documents whose likelihood ratio statistic is above what chance
    gives the best of as many features, most_features at most. Texts
    of one signature and label count once, so that copies do not make their words telling. Without labels of both kinds
    nothing is telling, and every score is the share of toxic labels.
    """
    spark = docs.sparkSession
    ship(spark)
    sample = _sample(docs, labels, rows).persist()
    try:
        return _fit(sample, least_docs, most_features)
    finally:
        sample.unpersist()


def _fit(sample: DataFrame, least_docs: int, most_features: int) -> Model:
    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("toxicity")
        for whole in batches:
            for at in range(0, whole.num_rows, 128):  # the features of a text take much more room than the text
                b = whole.slice(at, 128)
                texts = b.column("text").to_pylist()
                yield pa.RecordBatch.from_arrays([b.column("toxic").cast(pa.int32()), pa.array(map(_signature, texts), pa.int64()), pa.array(map(_features, texts), pa.list_(pa.string()))], names=["toxic", "signature", "features"])

    distinct = sample.mapInArrow(describe, "toxic int, signature bigint, features array<string>").groupBy("toxic", "signature").agg(F.max("features").alias("features"))
    distinct = distinct.persist()
    n = {r["toxic"]: r["n"] for r in distinct.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n1, n0 = n.get(1, 0), n.get(0, 0)
    if not n1 or not n0:
        distinct.unpersist()
        share = (n1 + 0.5) / (n1 + n0 + 1) if n1 + n0 else 0.1
        return Model(bias=math.log(share / (1 - share)) if n0 or not n1 else 0.0)
    counts = distinct.select("toxic", F.explode("features").alias("f")).groupBy("f").agg(F.sum("toxic").alias("y1"), F.sum(1 - F.col("toxic")).alias("y0"))
    counts = counts.where(F.col("y1") + F.col("y0") >= least_docs)
    p, strength = (F.col("y1") + F.col("y0")) / F.lit(float(n1 + n0)), 20.0
    a1, a0 = F.col("y1") + strength * p, F.col("y0") + strength * p
    odds = F.log(a1 / (n1 + strength - a1)) - F.log(a0 / (n0 + strength - a0))
    part = lambda y, n: F.when(y > 0, y * F.log(y / (n * p))).otherwise(0.0) + F.when(y < n, (n - y) * F.log((n - y) / (n * (1 - p) + 1e-9))).otherwise(0.0)
    ratio = 2 * (part(F.col("y1"), n1) + part(F.col("y0"), n0))
    found = counts.select("f", "y1", odds.alias("odds"), ratio.alias("ratio")).persist()
    chance = 2 * math.log(max(2, found.count())) + 2
    telling = found.where((F.col("y1") >= least_docs) & (F.col("odds") >= 1.0) & (F.col("ratio") >= chance))
    model = Model({r["f"]: r["odds"] for r in telling.orderBy(F.desc("ratio"), "f").limit(most_features).collect()})
    found.unpersist()
    distinct.unpersist()

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text in b.column("text").to_pylist():
                at, values, n_words = telling_words(text, model)
                found = segments(at, values, model.step) if len(at) else []
                out.append((n_words, max((s for _, _, s in found), default=0.0)))
            lengths, best = zip(*out) if out else ((), ())
            yield pa.RecordBatch.from_arrays([b.column("toxic").cast(pa.int32()), pa.array(lengths, pa.int64()), pa.array(best, pa.float64())], names=["toxic", "n", "best"])

    clean = [(r["n"], r["best"]) for r in sample.mapInArrow(measure, "toxic int, n bigint, best double").where("toxic = 0").collect()]
    # Gumbel law of the best clean segment: P(best >= s) = 1 - exp(-n exp(location - decay s)). decay from the mean
    # excess, location from the number of texts with any; one text is added, so that rates stay above zero.
    some = [b for _, b in clean if b > 0]
    words = sum(n for n, _ in clean) + 1
    model.decay = 1.0 / max(0.5, sum(some) / len(some)) if some else 1.0
    model.location = math.log((len(some) + 1) / words)
    model.known = None

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("toxic").cast(pa.int32()), pa.array([evidence(t, model)[0] for t in b.column("text").to_pylist()], pa.float64())], names=["toxic", "evidence"])

    pairs = sample.mapInArrow(weigh, "toxic int, evidence double").collect()
    x, y = np.array([[r["evidence"], 1.0] for r in pairs]), np.array([float(r["toxic"]) for r in pairs])
    w = np.array([0.0, math.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))])
    for _ in range(50):  # Newton steps of a logistic fit with a small ridge
        q = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        ridge = np.array([1e-2, 1e-3])
        step = np.linalg.solve((x * (q * (1 - q) + 1e-9)[:, None]).T @ x + np.diag(ridge), x.T @ (y - q) - ridge * w)
        w = w + np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-8:
            break
    model.slope, model.bias = max(0.0, float(w[0])), float(w[1])
    return model


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (0 to 1), evidence and passages (word ranges with p of 0.05 at most) of every whole text.

    A null, empty or wordless text has no passage, and the score of a text without evidence. One pass, row by row,
    linear in the text: repeated rows and ids, ties and other columns make no difference.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("toxicity")
        for b in batches:
            total, scores, spans = [], [], []
            for text in b.column(1):
                e, found = evidence(text.as_py() or "", model)
                total.append(e)
                scores.append(1 / (1 + math.exp(-max(-500.0, min(500.0, model.slope * e + model.bias)))))
                spans.append([{"start": s, "end": t, "score": v, "p": p} for s, t, v, p in found])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("p", pa.float64())]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64()), pa.array(total, pa.float64()), pa.array(spans, kind)], names=["doc_id", "score", "evidence", "passages"])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SCORED)


def keep_below(docs: DataFrame, model: Model, least: float, *, text_col: str = "text") -> DataFrame:
    """docs, all columns, without the rows whose score is least or more; scored where they are read, without a join."""
    ship(docs.sparkSession)
    schema, at = docs.schema, docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("toxicity")
        for b in batches:
            odds = [model.slope * evidence(t.as_py() or "", model)[0] + model.bias for t in b.column(at)]
            yield b.filter(pa.array([1 / (1 + math.exp(-max(-500.0, min(500.0, x)))) < least for x in odds], pa.bool_()))

    return docs.mapInArrow(run, schema)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document, by a model of the labelled rows that are not held out."""
    docs = table(spark, sf_dir, "documents")
    found = score(docs, train(docs, table(spark, sf_dir, "labels")))
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0, F.lit(False))
    return found.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("passages").alias("n_passages"))
