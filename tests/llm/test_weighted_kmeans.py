import hashlib
import math
import random
from collections import Counter

from kgloom.llm.weighted_kmeans import cluster_vectors


def brute(rows, dim, clusters=8, rounds=10):
    """Plain Lloyd over all rows, with Python's integers."""
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centroids = [list(v) for _, v in order[:clusters]]

    def assign():
        far = [[sum((a - b) ** 2 for a, b in zip(v, c)) for c in centroids] for _, v in kept]
        return [(d.index(min(d)), min(d)) for d in far]

    for _ in range(rounds):
        to = assign()
        for k in range(len(centroids)):
            mine = [v for (_, v), (c, _) in zip(kept, to) if c == k]
            if mine:
                centroids[k] = [sum(x) // len(mine) for x in zip(*mine)]
    to = assign()
    by = Counter()
    for k, d in to:
        by[k] += d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return Counter((i, k, d, by[k], sum(by.values()), sha[k]) for (i, _), (k, d) in zip(kept, to))


def got(df):
    return Counter(tuple(r) for r in df.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect())


def rows_of(seed, n, dim):
    rnd = random.Random(seed)
    some = [[rnd.choice([-1.0, -0.0007, 0.0, 0.5, 1.25]) for _ in range(dim)] for _ in range(12)]
    rows = [(i, rnd.choice(some) if rnd.random() < 0.7 else [rnd.gauss(0, 1) for _ in range(dim)]) for i in range(n)]
    return rows + [(n + i, some[0]) for i in range(n // 2)]  # a third of all rows are one vector


def test_against_plain_rounds(spark):
    bad = [(900, None), (901, []), (902, [1.0]), (903, [None, 1.0, 1.0]), (904, [float("nan")] * 3), (905, [1.0, 2.0, float("inf")]), (906, [1.0] * 4)]
    for seed, n in ((1, 120), (2, 40), (3, 9)):
        rows = rows_of(seed, n, 3) + bad + [(None, [1.0, 2.0, 3.0]), (None, [0.0, 0.0, 0.0]), (5, [1.0, 1.0, 1.0])]
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
        assert got(cluster_vectors(df, dim=3)) == brute(rows, 3)


def test_few_vectors_empty_tables_and_large_components(spark):
    schema = "vec_id long, embedding array<double>"
    few = [(1, [1.0, 1.0]), (2, [1.0, 1.0]), (3, [-5.0, 0.1])]
    assert got(cluster_vectors(spark.createDataFrame(few, schema), dim=2)) == brute(few, 2)
    large = [(1, [1e9, 0.0]), (2, [-3.0, 0.0]), (3, [9e5, 2.0])]  # some squares sum beyond a long, the distances to the nearest do not
    assert got(cluster_vectors(spark.createDataFrame(large, schema), dim=2, rounds=2)) == brute(large, 2, rounds=2)
    for rows in ([], [(1, None), (2, [1.0])]):
        assert cluster_vectors(spark.createDataFrame(rows, schema), dim=2).collect() == []


def test_columns_and_text_ids(spark):
    df = spark.createDataFrame([("a", [1.0], "7", "x"), ("b", [2.0], "8", "y")], "key string, embedding array<float>, cluster string, _v string")
    out = cluster_vectors(df, id_col="key", dim=1)
    assert out.columns == ["key", "_v", "cluster", "distance", "cluster_inertia", "inertia", "multiplicity", "centroid_sha256"]
    assert sorted(tuple(r)[1:] for r in out.select("cluster", "key", "_v", "multiplicity", "distance").collect()) == [("a", "x", 1, 0), ("b", "y", 1, 0)]
