import random

import pytest

from kgloom.llm.components import connected


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_union_find(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(400 + i, 401 + i) for i in range(60)] + [(500, 501 + i) for i in range(80)] + [(7, 7), (None, 3), (501, 500)]
    root = {n: n for e in edges for n in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for u, v in edges:
        if u is not None and v is not None and find(u) != find(v):
            a, b = sorted((find(u), find(v)))
            root[b] = a
    want = {(n, find(n)) for n in root if n is not None and find(n) != n}
    got = connected(spark.createDataFrame(edges, "u long, v long")).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_no_edges(spark):
    assert connected(spark.createDataFrame([], "u string, v string")).collect() == []
