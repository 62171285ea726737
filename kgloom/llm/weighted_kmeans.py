"""Centroid clustering: identical quantised vectors are grouped with their multiplicities, Lloyd's rounds run over the distinct ones with weighted integer sums, a join hands the assignments back."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgloom.llm.common import discard, fresh, stored

#: Components beyond this after scaling take part by Python's integers, as sums of their squares may pass a long.
NARROW = 1 << 26
#: A vector with this share of all rows or more is handed back by a broadcast: there are at most so many of them.
HOT_SHARE = 4096

SUMS = "cluster int, pos int, n decimal(38,0), total decimal(38,0)"


def quantised(embedding: Column, scale: int) -> Column:
    """floor(scale * x) of each component, x as double."""
    return F.transform(embedding, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))


def usable(embedding: Column, dim: int) -> Column:
    """Exactly dim components, none null, NaN or infinite."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf")))
    return F.coalesce((F.size(embedding) == dim) & F.forall(embedding, finite), F.lit(False))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column of longs; as objects where int64 could not hold a squared distance."""
    rows = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
    return rows if np.abs(rows).max(initial=0) < NARROW else rows.astype(object)


def nearest(rows: np.ndarray, centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest centroid, squared distance) for each row; ties go to the smaller number."""
    wide = rows.dtype == object or any(abs(x) >= NARROW for c in centroids for x in c)
    kind = object if wide else np.int64
    best, number = None, np.zeros(len(rows), np.int32)
    for k, c in enumerate(centroids):
        apart = rows.astype(kind) - np.array(c, kind)
        d = (apart * apart).sum(1)
        if best is None:
            best = d
        else:
            closer = (d < best).astype(bool)
            best, number = np.where(closer, d, best), np.where(closer, np.int32(k), number)
    return number, best


def _summer(centroids: list[list[int]], dim: int):
    """mapInArrow function: weighted sums of the components for each cluster, and its weight, over all of a partition."""
    from decimal import Decimal

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, total = [0] * len(centroids), [[0] * dim for _ in centroids]
        for batch in batches:
            if not batch.num_rows:
                continue
            rows, many = matrix(batch.column(0), dim), batch.column(1).to_numpy()
            number, _ = nearest(rows, centroids)
            exact = rows.dtype != object and int(many.sum()) * NARROW < 1 << 62
            for k in np.unique(number).tolist():
                mine = number == k
                part = many[mine][:, None] * rows[mine] if exact else many[mine].astype(object)[:, None] * rows[mine].astype(object)
                weight[k] += int(many[mine].sum())
                total[k] = [a + int(b) for a, b in zip(total[k], part.sum(0))]
        some = [k for k, n in enumerate(weight) if n]
        number = pa.decimal128(38, 0)
        yield pa.RecordBatch.from_pydict({
            "cluster": pa.array([k for k in some for _ in range(dim)], pa.int32()),
            "pos": pa.array([i for _ in some for i in range(dim)], pa.int32()),
            "n": pa.array([Decimal(weight[k]) for k in some for _ in range(dim)], number),
            "total": pa.array([Decimal(x) for k in some for x in total[k]], number),
        })

    return add


def _assigner(centroids: list[list[int]], dim: int):
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                number, apart = nearest(matrix(batch.column(0), dim), centroids)
                far = pa.array(apart.tolist(), pa.int64()) if apart.dtype == object else pa.array(apart)
                yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(number), far], names=[*batch.schema.names[1:], "cluster", "distance"])

    return assign


def first_centroids(rows: DataFrame, id_col: str, vector: str, clusters: int, seed: int) -> list[list[int]]:
    """The vectors whose ids have the smallest hex SHA-256 of seed:id; rows without an id come last, equal hashes by vector."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")), 256)
    drawn = rows.select(order.alias("h"), F.col(vector).alias("v")).orderBy(F.col("h").asc_nulls_last(), "v").limit(clusters).collect()
    return [list(r.v) for r in drawn]


def cluster_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dim: int = 64, scale: int = 1024, clusters: int = 8, rounds: int = 10, seed: int = 3) -> DataFrame:
    """Adds cluster (int), distance, cluster_inertia, inertia (long), multiplicity (long) and centroid_sha256 to each usable row.

    A vector takes part if it has exactly dim components, none null or non-finite; its components become
    floor(scale * x). Centroids start as the vectors of least SHA-256 of "seed:id", are replaced in each round by the
    floor of the exact mean of their vectors, and stay where they have none. Ties go to the smaller number. With fewer
    vectors than clusters there are so many centroids; an empty table, or one without a usable vector, gives no rows.
    Repeated rows count as often as they occur and come back as often; rows without an id take part, but start a centroid
    last. Components beyond a long after scaling count as the least or greatest long; a distance or inertia beyond a long
    fails the job. vectors keeps its columns, vector_col left out; columns named as outputs are replaced.

    One shuffle, combined map-side, groups equal vectors; the rounds read the stored distinct ones, and clusters x dim
    sums come to the driver. The rows then meet their assignment by a 128-bit hash of the vector; those of vectors that
    hold 1/HOT_SHARE of all rows or more, at most HOT_SHARE of them, meet it by broadcast, so no task gets a hot one.
    """
    outputs = ("cluster", "distance", "cluster_inertia", "inertia", "multiplicity", "centroid_sha256")
    v, a, b, row, hot = fresh(vectors, "_v", "_a", "_b", "_row", "_hot")
    kept = [c for c in vectors.columns if c != vector_col and c not in outputs]
    rows = vectors.where(usable(F.col(vector_col), dim)).withColumn(v, quantised(F.col(vector_col), scale))
    keys = [F.xxhash64(v).alias(a), F.xxhash64(F.lit(7), F.col(v)).alias(b)]
    distinct = stored(rows.groupBy(v).agg(F.count(F.lit(1)).alias("multiplicity")), "distinct-vectors")
    centroids = first_centroids(rows, id_col, v, clusters, seed)
    for _ in range(rounds if centroids else 0):
        sums = distinct.select(v, "multiplicity").mapInArrow(_summer(centroids, dim), SUMS)
        for r in sums.groupBy("cluster", "pos").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect():
            centroids[r["cluster"]][r["pos"]] = int(r["total"]) // int(r["n"])
    slim = distinct.select(v, *keys, "multiplicity")
    schema = f"{a} long, {b} long, multiplicity long, cluster int, distance long"
    assigned = stored(slim.mapInArrow(_assigner(centroids, dim), schema), "assigned-vectors")
    discard(distinct)

    weighted = F.col("distance").cast("decimal(19,0)") * F.col("multiplicity").cast("decimal(19,0)")
    found = assigned.groupBy("cluster").agg(F.sum(weighted).alias("far"), F.sum("multiplicity").alias("n")).collect()
    whole, total = sum(int(r.far) for r in found), sum(r.n for r in found)
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    inertias = {r.cluster: int(r.far) for r in found}
    facts = vectors.sparkSession.createDataFrame([(k, inertias[k], whole, digests[k]) for k in sorted(inertias)], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")

    heavy = F.col("multiplicity") * HOT_SHARE >= max(total, 1)
    keyed = rows.select(F.struct(*kept).alias(row) if kept else F.lit(0).alias(row), *keys)
    common = assigned.where(heavy).withColumn(hot, F.lit(True))
    marked = keyed.join(F.broadcast(common.select(a, b, hot)), [a, b], "left")
    often = marked.where(F.col(hot).isNotNull()).drop(hot).join(F.broadcast(common.drop(hot)), [a, b])
    seldom = marked.where(F.col(hot).isNull()).drop(hot).join(assigned.where(~heavy), [a, b])
    out = often.unionByName(seldom).join(F.broadcast(facts), "cluster")
    return out.select(*([f"{row}.*"] if kept else []), *outputs)
