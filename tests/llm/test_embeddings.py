import numpy as np
import pytest

from lumenframe.llm import embeddings
from lumenframe.llm.embeddings import _hadamard, near_vectors, op7_embedding_dedup

SF = "/root/testdata/sf0.001"


def brute(rows, at_least=0.95):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    link = np.zeros((len(good), len(good)), bool)
    for d in {len(v) for _, v in good}:
        at = [k for k, (_, v) in enumerate(good) if len(v) == d]
        x = np.stack([good[k][1] / np.linalg.norm(good[k][1]) for k in at])
        link[np.ix_(at, at)] = x @ x.T >= at_least
    np.fill_diagonal(link, False)
    root = list(range(len(good)))
    for _ in range(len(good)):
        new = [min([root[k], *(root[j] for j in np.flatnonzero(link[k]))]) for k in range(len(good))]
        if new == root:
            break
        root = new
    low = {}
    for k, (i, _) in enumerate(good):
        low[root[k]] = min(low.get(root[k], i), i)
    out = [(i, int(link[k].sum()), low[root[k]], i == low[root[k]]) for k, (i, _) in enumerate(good)]
    bad = [(i, 0, i, True) for i, v in rows if not (i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v))]
    return sorted(out + bad, key=str)


def planted(rng, groups, size, dim=64, noise=0.15):
    rows = []
    for _ in range(groups):
        c = rng.normal(size=dim)
        c /= np.linalg.norm(c)
        rows += [(c + noise * rng.normal(size=dim) / np.sqrt(dim)).tolist() for _ in range(size)]
    return rows


@pytest.mark.parametrize("block", [7, 512])
def test_groups_and_odd_vectors(spark, monkeypatch, block):
    monkeypatch.setattr(embeddings, "BLOCK", block)
    rng = np.random.default_rng(block)
    rows = list(enumerate(planted(rng, 30, 1) + planted(rng, 4, 9) + planted(rng, 1, 60)))
    same = rng.normal(size=64).tolist()
    rows += [(500 + k, same) for k in range(5)] + [(510, (3 * np.array(same)).tolist()), (511, (-np.array(same)).tolist())]
    rows += [(600, None), (601, []), (602, [0.0] * 64), (603, [float("nan")] + [1.0] * 63), (604, [None] + [1.0] * 63), (605, [float("inf")] * 64), (None, same), (606, [1.0, 2.0]), (607, [2.0, 4.0]), (608, [1e-300] * 64), (609, [1e300] * 64)]
    frame = spark.createDataFrame([(i, v, 0, 1) for i, v in rows], "vec_id bigint, embedding array<double>, key int, part int")
    got = near_vectors(frame).collect()
    assert sorted(map(tuple, got), key=str) == brute([(i, [x / 1e300 for x in v] if i == 609 else [x * 1e300 for x in v] if i == 608 else v) for i, v in rows])


def pairs_at_the_threshold(rng, n, dim):
    rows = []
    for _ in range(n):
        a, b = rng.normal(size=(2, dim))
        a /= np.linalg.norm(a)
        b -= (a @ b) * a
        rows += [a, 0.951 * a + np.sqrt(1 - 0.951**2) * b / np.linalg.norm(b)]
    return np.array(rows)


@pytest.mark.parametrize("dim,hashes", [(64, 1), (64, 2), (64, 3), (64, 4), (64, 5), (128, 3), (128, 4), (128, 5), (384, 2), (384, 4)])
def test_keys_meet_near_the_threshold(dim, hashes):
    keys = embeddings.bucket_keys(pairs_at_the_threshold(np.random.default_rng(dim), 400, dim), embeddings.TABLES[hashes], hashes, hashes)
    keys = keys.reshape(len(keys), -1)
    assert np.mean([len(np.intersect1d(a, b)) > 0 for a, b in zip(keys[::2], keys[1::2])]) >= 0.95


@pytest.mark.parametrize("hashes", [None, 3, 5])
def test_recall_near_the_threshold(spark, hashes):
    rows = pairs_at_the_threshold(np.random.default_rng(4), 300, 64)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], "vec_id bigint, embedding array<double>")
    assert near_vectors(frame, hashes=hashes).where("n_links = 1").count() >= 0.95 * len(rows)


def test_hashes_grow_with_the_input():
    assert [embeddings.key_hashes(n, 64) for n in (0, 1, 8192, 8200, 10**6, 10**8, 10**10, 10**14)] == [1, 1, 1, 2, 2, 3, 4, 5]
    assert [embeddings.key_hashes(10**10, d) for d in (1, 2, 64, 128, 768)] == [5, 5, 4, 4, 3]


def test_op7_on_the_table(spark):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert sorted(map(tuple, op7_embedding_dedup(spark, SF).collect()), key=str) == brute(rows)
    assert near_vectors(spark.createDataFrame([], "vec_id bigint, embedding array<float>")).count() == 0


def test_hadamard_keeps_lengths():
    x = np.random.default_rng(0).normal(size=(5, 16))
    assert np.allclose(np.linalg.norm(_hadamard(x), axis=1), np.linalg.norm(x, axis=1))
    assert np.allclose(_hadamard(_hadamard(x)), x)
