import numpy as np
import pytest

from kgloom.llm import topk_search as T

SCHEMA = "vec_id long, embedding array<float>, n int, ids string"


def brute(rows, queries, k):
    usable = [(i, [int(np.floor(64 * float(np.float32(x)))) for x in v]) for i, v, *_ in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    asked = {}
    for i, v, *_ in queries:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            asked[i] = min(asked.get(i, v), v)
    out = []
    for q, v in asked.items():
        qv = [int(np.floor(64 * float(np.float32(x)))) for x in v]
        scored = sorted((-sum(a * b for a, b in zip(qv, c)), i) for i, c in usable if i != q and len(c) == len(qv))
        out += [(q, r, i, -s) for r, (s, i) in enumerate(scored[:k], 1)]
    return sorted(out)


def found(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("tile,shard,fan", [(2048, 8192, 16), (3, 7, 2)])
def test_against_brute_force(spark, tile, shard, fan):
    rng = np.random.default_rng(9)
    rows = [(i, [float(x) for x in np.round(rng.standard_normal(5), 1)], 1, "a") for i in range(150)]
    rows += [(7, rows[7][1], 1, "a"), (150, None, 1, "a"), (None, rows[0][1], 1, "a"), (160, [1.0, None, 0.0, 0.0, 0.0], 1, "a"), (170, [float("nan")] * 5, 1, "a"), (180, [float("inf")] * 5, 1, "a"), (190, [1.0, 2.0], 1, "a"), (200, [], 1, "a"), (20, [0.0] * 5, 1, "a")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    queries = df.where("vec_id % 10 = 0")
    got = found(T.exact_topk(df, queries, 20, query_tile=tile, shard_rows=shard, fan_in=fan))
    assert got == brute(rows, [r for r in rows if r[0] is not None and r[0] % 10 == 0], 20)


def test_ties_few_rows_and_empty_tables(spark):
    rows = [(i, [1.0, 1.0], 0, "") for i in range(5)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert found(T.exact_topk(df, df.where("vec_id = 2"))) == [(2, 1, 0, 8192), (2, 2, 1, 8192), (2, 3, 3, 8192), (2, 4, 4, 8192)]
    assert T.exact_topk(df, df.limit(0)).collect() == [] and T.exact_topk(df.limit(0), df).collect() == []


def test_large_components_stay_exact():
    a = np.array([[2**40 + 1, 3]], np.int64)
    assert T.products(a, np.array([[2**20 + 1, 1]], np.int64))[0, 0] == (2**40 + 1) * (2**20 + 1) + 3
    with pytest.raises(OverflowError):
        T.products(a, a)
