"""Operator 7: near duplicates among embeddings by cross-polytope hashing."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, ship, table
from .components import connected_components
from .windows import mix

#: Vectors of one bucket compared at a time.
BLOCK = 2048
#: Tables by the number of hashes in a key, each with a probe for each hash: at a cosine of 0.951 they find 0.97 or more
#: of all pairs of 64, 128 or 384 components.
TABLES = {1: 4, 2: 6, 3: 8, 4: 12, 5: 20}


def _hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows, whose length is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(n, d)
        h *= 2
    return x / math.sqrt(d)


def bucket_keys(unit: np.ndarray, tables: int, hashes: int, probes: int, seed: int = 7) -> np.ndarray:
    """Keys (rows x tables x (1 + probes)) of unit vectors.

    A hash is the coordinate of largest absolute value, with its sign, after three rounds of random signs and a
    Hadamard transform; a table's key joins so many hashes. Each probe puts the second largest coordinate in the place of
    the largest for one hash, those with the smallest gap first.
    """
    n, dim = unit.shape
    d = 1 << max(0, dim - 1).bit_length()
    wide = np.zeros((n, d))
    wide[:, :dim] = unit
    out = np.empty((n, tables, 1 + probes), np.int64)
    row = np.arange(n)
    for t in range(tables):
        first, second, gaps = [], [], []
        for k in range(hashes):
            rng, x = np.random.default_rng([seed, dim, t, k]), wide
            for _ in range(3):
                x = _hadamard(x * rng.choice([-1.0, 1.0], d))
            size = np.abs(x)
            a = size.argmax(1)
            first.append(2 * a + (x[row, a] > 0))
            top = size[row, a].copy()
            size[row, a] = -1
            b = size.argmax(1)
            second.append(2 * b + (x[row, b] > 0))
            gaps.append(top - size[row, b])
        order = np.argsort(np.stack(gaps, 1), axis=1, kind="stable")
        for p in range(1 + probes):
            key = np.full(n, (dim * 64 + t) * 2 + 1, np.uint64)
            for k in range(hashes):
                code = first[k] if p == 0 else np.where(order[:, p - 1] == k, second[k], first[k])
                key = mix(key * np.uint64(0x9E3779B97F4A7C15) + code.astype(np.uint64))
            out[:, t, p] = key.view(np.int64)
    return out


def _compare(rows: pa.Table, at_least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Of one bucket's block pair: its linked nodes, their links first seen here (weighted), and the least node reached."""
    x = np.array(rows.column("unit").combine_chunks().flatten()).reshape(rows.num_rows, -1)
    keys = np.array(rows.column("keys").combine_chunks().flatten()).reshape(rows.num_rows, -1)
    weight, node = rows.column("weight").to_numpy(), rows.column("node").to_numpy()
    i, j, part, key = rows.column("i")[0].as_py(), rows.column("j")[0].as_py(), rows.column("part").to_numpy(), rows.column("key")[0].as_py()
    a, b = np.flatnonzero(part == i), np.flatnonzero(part == j)
    near = x[a] @ x[b].T >= at_least
    if i == j:
        near &= np.arange(len(a))[:, None] < np.arange(len(b))[None, :]
    p, q = np.nonzero(near)
    if not len(p):
        return None
    p, q = a[p], b[q]
    links, root = np.zeros(rows.num_rows, np.int64), np.arange(rows.num_rows)
    for s in range(0, len(p), 100_000):
        u, v = p[s : s + 100_000], q[s : s + 100_000]
        least = np.full(len(u), np.iinfo(np.int64).max)
        for c in range(keys.shape[1]):  # the least key that both have: each pair counts there only
            same = (keys[u, c][:, None] == keys[v]).any(1)
            least = np.where(same, np.minimum(least, keys[u, c]), least)
        here = least == key
        np.add.at(links, u[here], weight[v[here]])
        np.add.at(links, v[here], weight[u[here]])
    while True:  # least label over links, until nothing changes
        low = np.minimum(root[p], root[q])
        new = root.copy()
        np.minimum.at(new, p, low)
        np.minimum.at(new, q, low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    own = np.unique(np.concatenate([p, q]))
    return node[own], links[own], node[root[own]]


def key_hashes(n: int, dim: int) -> int:
    """Hashes in a key: of n vectors a bucket then has 64 by chance, at the most hashes of TABLES more."""
    values = 2 << max(1, (dim - 1).bit_length())
    return min(max(TABLES), max(1, math.ceil(math.log(max(1.0, n / 64), values) - 1e-9)))


def near_vectors(vectors: DataFrame, *, at_least: float = 0.95, hashes: int | None = None, tables: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id and kept for every row.

    Vectors link when their cosine in double precision is at_least or more and they meet in a bucket; below it none
    link. Equal vectors (by 128 bits of hash) are compared once, with their number as weight. Hashes per key grow with
    the logarithm of the number of vectors (key_hashes), and tables and probes with the hashes (TABLES), so that a pair
    at the threshold is found as surely in a large input. A bucket of more than BLOCK vectors is cut into parts, and each two parts are
    compared by a group of their own; only sums of links and, for each vector, the least one reached leave a group, so
    no list of pairs is made. A pair that meets in several buckets counts in that with the least key.

    Null, empty and zero vectors, those with null or non-finite components, and rows with a null id link with
    nothing. Vectors of different lengths never link. Rows of one id are vectors of their own. component_id is the
    smallest id reachable by links; kept: vec_id = component_id.
    """
    spark = vectors.sparkSession
    ship(spark)
    rows = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf))) & F.exists("v", lambda x: x != 0)
    rows = rows.withColumn("fine", F.coalesce(fine & F.col("vec_id").isNotNull(), F.lit(False)))
    same = F.transform("v", lambda x: x + F.lit(0.0))
    rows = rows.withColumn("h", F.when(F.col("fine"), F.xxhash64(same))).withColumn("h2", F.when(F.col("fine"), F.xxhash64(F.lit(1), same)))
    own = rows.where("fine").groupBy("h", "h2").agg(F.first("v").alias("v"), F.min("vec_id").alias("first_id"), F.count("*").alias("weight"))
    # a number of its own for each, also where 64 bits coincide
    nth = F.row_number().over(Window.partitionBy("h").orderBy("h2"))
    own = materialize(own.withColumn("node", F.when(nth == 1, F.col("h")).otherwise(F.xxhash64("h", "h2"))), "vectors")
    n = own.count()

    def hash_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column("v").to_pylist()
            sizes = np.array([len(x) for x in v])
            units, keys = [None] * len(v), [None] * len(v)
            for d in np.unique(sizes):
                at = np.flatnonzero(sizes == d)
                x = np.array([v[k] for k in at], float)
                x /= np.abs(x).max(1, keepdims=True)
                x /= np.sqrt((x * x).sum(1, keepdims=True))
                m = hashes or key_hashes(n, int(d))
                for k, u, c in zip(at, x, bucket_keys(x, tables or TABLES[m], m, m).reshape(len(at), -1)):
                    units[k], keys[k] = u, c
            yield pa.RecordBatch.from_arrays([b.column("node"), b.column("weight"), pa.array(units, pa.list_(pa.float64())), pa.array(keys, pa.list_(pa.int64()))], names=["node", "weight", "unit", "keys"])

    hashed = materialize(own.select("node", "weight", "v").mapInArrow(hash_, "node bigint, weight bigint, unit array<double>, keys array<bigint>"), "hashed")
    entries = hashed.select("node", F.explode(F.array_distinct("keys")).alias("key"))
    sizes = materialize(entries.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "buckets")
    parts = F.ceil(F.col("size") / BLOCK).cast("int")
    entries = entries.join(sizes, "key").withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("node", "key"), F.col("parts")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    pairs = entries.select("key", "node", "part", other).select("key", "node", "part", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"))
    dealt = pairs.join(hashed, "node").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for b in _then_none(batches):
            whole = rest if b is None else pa.Table.from_batches([b]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([b])])
            if whole is None or not whole.num_rows:
                continue
            of = np.stack([whole.column(c).to_numpy() for c in ("key", "i", "j")], 1)
            cuts = np.flatnonzero((of[1:] != of[:-1]).any(1)) + 1
            starts = [0, *cuts.tolist()]
            ends = [*cuts.tolist(), whole.num_rows]
            if b is not None:
                rest = whole.slice(starts.pop())
                ends.pop()
            found = [f for s, e in zip(starts, ends) if e - s > 1 and (f := _compare(whole.slice(s, e - s), at_least))]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in zip(*found)], names=["node", "links", "root"])

    found = materialize(dealt.select("key", "i", "j", "node", "part", "weight", "unit", "keys").mapInArrow(compare, "node bigint, links bigint, root bigint"), "links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    groups = connected_components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    known = own.select("node", "h", "h2", "first_id", "weight").join(links, "node", "left").join(groups, "node", "left")
    known = materialize(known.select("h", "h2", "first_id", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("group")), "known")
    first = materialize(known.groupBy("group").agg(F.min("first_id").alias("component_id")), "first")
    known = materialize(known.join(first, "group").select("h", "h2", "n_links", "component_id"), "nodes")
    linked = rows.where("fine").select("vec_id", "h", "h2").join(known, ["h", "h2"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("not fine").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _then_none(batches: Iterator) -> Iterator:
    yield from batches
    yield None


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates among all embeddings: a cosine of 0.95 or more."""
    return near_vectors(table(spark, sf_dir, "embeddings"))
