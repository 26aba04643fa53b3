import random

from provrank.llm._components import components


def brute(edges):
    parent = {x: x for e in edges for x in e if None not in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    return {x: find(x) for x in parent}


def test_shapes(spark):
    r = random.Random(1)
    chain = [(i, i + 1) for i in range(60)]
    star = [(100, 100 + i) for i in range(1, 300)]
    ring = [(500 + i, 500 + (i + 1) % 17) for i in range(17)]
    mixed = [(r.randint(600, 700), r.randint(600, 700)) for _ in range(70)]
    edges = [*chain, *star, *ring, *mixed, (None, 3), (5, None), (1, 2), (2, 1)]
    want = {x: c for x, c in brute(edges).items() if any(x in e and e[0] != e[1] and None not in e for e in edges)}
    got = {x.node: x.component for x in components(spark.createDataFrame(edges, "p long, q long")).collect()}
    assert got == want


def test_nothing(spark):
    assert components(spark.createDataFrame([], "p long, q long")).count() == 0
    assert components(spark.createDataFrame([(1, 1)], "p long, q long")).count() == 0
