import random
import zlib

import pytest
from pyspark.sql import functions as F

from kgloom.llm.kd_sharding import kd_tree, shard_by_bytes


def test_shards_are_even_gapless_and_whole(spark):
    rows = [(i, f"text {i % 700} " + "x" * (i * 37 % 500), "hot" if i % 3 else f"s{i % 5}", "en") for i in range(3000)]
    rows += [(i, "the same text", "s", None) for i in range(3000, 3060)] + [(None, None, None, None), (5, "", None, "en"), (5, "", None, "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").repartition(4)
    out = shard_by_bytes(df, 8, rows_per_bucket=50).select("doc_id", "text", "size", "text_crc32", "law", "shard", "slot", "grown_shard").collect()
    assert len(out) == len(rows)
    of, slots, load = {}, {}, [0] * 8
    for r in out:
        body = (r.text or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(body) + 1, zlib.crc32(body), "bytes", None)
        assert of.setdefault(body, r.shard) == r.shard
        slots.setdefault(r.shard, []).append(r.slot)
        load[r.shard] += r.size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(load) < 1.02 * sum(load) / 8 + 1000 and min(load) > 0.98 * sum(load) / 8 - 1000


def test_a_heavy_group_stays_whole(spark):
    rows = [(i, "heavy " * 50) for i in range(300)] + [(i, f"light {i} " * 30) for i in range(300, 700)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = shard_by_bytes(df, 4).groupBy("shard").agg(F.sum("size").alias("b"), F.count_distinct(F.when(F.col("doc_id") < 300, 1)).alias("h")).collect()
    assert sum(r.h for r in out) == 1 and len(out) == 4


def test_few_rows_and_other_shard_counts(spark):
    df = spark.createDataFrame([(1, "a", 9, 9)], "doc_id long, text string, slot int, _a int")
    r = shard_by_bytes(df, 5).collect()
    assert len(r) == 1 and r[0].slot == 0 and 0 <= r[0].shard < 5 and r[0]["_a"] == 9
    assert shard_by_bytes(df.limit(0), 8).collect() == []
    many = spark.range(900).selectExpr("id as doc_id", "concat('t', id) as text")
    assert sorted(c for _, c in shard_by_bytes(many, 3).groupBy("shard").count().collect())[0] > 280


def plain_tree(rows, dims, shards, whole):
    """{leaf: rows} of a k-d tree built by sorting: rows are (id, weight, coordinates)."""
    if shards == 1 or not rows:
        return {0: rows}
    ends = [(min(r[2][d] for r in rows), max(r[2][d] for r in rows)) for d in range(dims)]
    dim = max(range(dims), key=lambda d: ((ends[d][1] >> 32) - (ends[d][0] >> 32)) / whole[d])
    weights = {}
    for r in rows:
        weights[r[2][dim]] = weights.get(r[2][dim], 0) + r[1]
    due, left, cut = sum(r[1] for r in rows) * (shards // 2) / shards, 0, ends[dim][0] - 1
    for x in sorted(weights):
        if left + weights[x] > due:
            if left + weights[x] - due < due - left:
                cut = x
            break
        left, cut = left + weights[x], x
    out = dict(plain_tree([r for r in rows if r[2][dim] <= cut], dims, shards // 2, whole))
    right = plain_tree([r for r in rows if r[2][dim] > cut], dims, shards - shards // 2, whole)
    return out | {shards // 2 + k: v for k, v in right.items()}


@pytest.mark.parametrize("shards", [2, 7, 64])
def test_against_a_plain_tree(spark, shards):
    rng = random.Random(shards)
    rows = [(i, rng.choice([1, 5, 40, 3000]) + rng.randrange(50), [rng.choice([3, 17, 900]) << 32 | rng.randrange(1 << 32), rng.randrange(1 << 30) << 32 | rng.randrange(1 << 32)]) for i in range(2000)]
    whole = [max(1, (max(r[2][d] for r in rows) >> 32) - (min(r[2][d] for r in rows) >> 32)) for d in (0, 1)]
    df = spark.createDataFrame([(i, w, *x) for i, w, x in rows], "id long, w long, d0 long, d1 long")
    got = {r.id: r.node for r in kd_tree(df, ["d0", "d1"], "w", shards, "node", room=256).collect()}
    want = {r[0]: k for k, part in plain_tree(rows, 2, shards, whole).items() for r in part}
    assert got == want


def test_leaves_reach_the_target(spark):
    df = spark.range(4000).selectExpr("id as doc_id", "repeat(concat('t', id, ' '), 5 + int(id % 60)) as text")
    total = df.selectExpr("sum(octet_length(text) + 1)").first()[0]
    load = [r.b for r in shard_by_bytes(df, target_bytes=total // 250).groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert len(load) in (250, 251) and max(load) < 1.6 * total / 250
