import random

from lumenframe.llm.components import connected_components


def test_components_equal_union_find(spark):
    rng = random.Random(8)
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, 500 + i) for i in range(1, 80)] + [(-5, 7), (7, 7), (7, -5), (9, 9)]
    edges += [(rng.randrange(1000, 1200), rng.randrange(1000, 1200)) for _ in range(120)]
    rng.shuffle(edges)
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        low, high = sorted((find(a), find(b)))
        root[high] = low
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: find(x) for x in root if any(x in e and e[0] != e[1] for e in edges)}
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_workers_keep_the_caches_of_one_operator():
    from lumenframe.llm.common import only, worker_cache

    a, b, c = worker_cache("a"), worker_cache("a"), worker_cache("b")
    for cache in (a, b, c):
        cache[1] = 2
    only("a")
    assert a == b == {1: 2} and not c
    only("b")
    assert not a and not b
