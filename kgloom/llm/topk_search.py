"""Exact top-k search: tiled matrix products of query tiles and shards, a partial selection per tile, and a tree that merges the lists of each query."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgloom.llm.common import stored

#: float64 adds products exactly while no partial sum can pass this.
EXACT = float(1 << 53)

PACKED = "tile long, dim int, kind string, ids binary, vectors binary"
#: Query tiles are dealt to so many salts of the shards, so no single key holds the plan of the product.
SALTS = 32
LISTS = "qtile long, part long, n int, queries binary, lens binary, ids binary, scores binary"


def scaled(vectors: np.ndarray) -> np.ndarray:
    """floor(64 * x) of float32 or float64 components, as int64."""
    out = np.floor(vectors.astype(np.float64) * 64.0)
    if out.size and np.abs(out).max() >= float(1 << 62):
        raise OverflowError("a component is beyond the range of a long after scaling")
    return out.astype(np.int64)


def packer(rows: int):
    """mapInArrow function: usable vectors of equal length, packed to tiles of at most so many rows."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        serial = TaskContext.get().partitionId() << 32
        waiting: dict[int, list] = {}

        def tile(dim: int, take: list) -> pa.RecordBatch:
            nonlocal serial
            serial += 1
            ids, vecs = np.concatenate([x for x, _ in take]), np.concatenate([v for _, v in take])
            kind = next(t for t in ("int16", "int32", "int64") if np.abs(vecs).max(initial=0) <= np.iinfo(t).max)
            return pa.RecordBatch.from_pydict({"tile": [serial], "dim": pa.array([dim], pa.int32()), "kind": [kind], "ids": [ids.tobytes()], "vectors": [vecs.astype(kind).tobytes()]})

        for batch in batches:
            if not batch.num_rows:
                continue
            ids, lists = batch.column(0), batch.column(1)
            lens = np.asarray(lists.value_lengths().fill_null(0))
            good = np.asarray(ids.is_valid()) & np.asarray(lists.is_valid())
            owner = np.repeat(np.arange(len(lens)), lens)
            flat = lists.flatten()
            values = np.asarray(flat.cast(pa.float64()).fill_null(np.nan), dtype=np.float64)
            bad = np.unique(owner[~np.isfinite(values)])
            good[bad] = False
            keys = np.asarray(ids.fill_null(0)).astype(np.int64)
            starts = np.concatenate([[0], np.cumsum(lens)])
            for dim in np.unique(lens[good]):
                at = np.flatnonzero(good & (lens == dim))
                vecs = scaled(values[(starts[at][:, None] + np.arange(dim)[None, :])])
                for lo in range(0, len(at), rows):
                    room = waiting.setdefault(int(dim), [])
                    room.append((keys[at[lo : lo + rows]], vecs[lo : lo + rows]))
                    if sum(len(x) for x, _ in room) >= rows:
                        whole = np.concatenate([x for x, _ in room]), np.concatenate([v for _, v in room])
                        yield tile(int(dim), [(whole[0][:rows], whole[1][:rows])])
                        waiting[int(dim)] = [(whole[0][rows:], whole[1][rows:])] if len(whole[0]) > rows else []
        for dim, room in waiting.items():
            if room:
                yield tile(dim, room)

    return pack


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products: in float64 where no sum can round, else in int64, refusing sums beyond a long."""
    worst = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if worst < EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if worst >= float(1 << 63):
        raise OverflowError("an inner product may be beyond the range of a long")
    return a @ b.T


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to the smaller id."""
    if len(scores) > 4 * k:
        floor = np.partition(scores, len(scores) - k)[len(scores) - k]
        among = np.flatnonzero(scores >= floor)
        return among[np.lexsort((ids[among], -scores[among]))[:k]]
    return np.lexsort((ids, -scores))[:k]


def _list_row(qtile: int, part: int, found: list[tuple[int, np.ndarray, np.ndarray]]) -> dict:
    return {
        "qtile": qtile, "part": part, "n": len(found),
        "queries": np.array([q for q, _, _ in found], np.int64).tobytes(), "lens": np.array([len(i) for _, i, _ in found], np.int32).tobytes(),
        "ids": b"".join(i.tobytes() for _, i, _ in found), "scores": b"".join(s.tobytes() for _, _, s in found),
    }


SCHEMA = pa.schema([("qtile", pa.int64()), ("part", pa.int64()), ("n", pa.int32()), ("queries", pa.binary()), ("lens", pa.binary()), ("ids", pa.binary()), ("scores", pa.binary())])


def tile_search(k: int):
    """mapInArrow function over pairs of a query tile and a shard: a list of k for each query of the tile."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                dim = r["dim"]
                qid, cid = np.frombuffer(r["q_ids"], np.int64), np.frombuffer(r["ids"], np.int64)
                q, c = np.frombuffer(r["q_vectors"], r["q_kind"]).reshape(len(qid), dim).astype(np.int64), np.frombuffer(r["vectors"], r["kind"]).reshape(len(cid), dim).astype(np.int64)
                found = []
                for lo in range(0, len(qid), 256):
                    scores = products(q[lo : lo + 256], c)
                    for i, row in enumerate(scores):
                        query, others = qid[lo + i], cid != qid[lo + i]
                        ids = cid if others.all() else cid[others]
                        row = row if len(ids) == len(cid) else row[others]
                        top = best(ids, row, k)
                        found.append((query, ids[top], row[top]))
                yield pa.RecordBatch.from_pylist([_list_row(r["qtile"], r["part"], found)], SCHEMA)

    return search


def merger(k: int):
    """applyInPandas function: the lists that several parts hold for the queries of a tile become one list a query."""

    def merge(frame):
        lists: dict[int, list] = {}
        for r in frame.itertuples():
            lens = np.frombuffer(r.lens, np.int32)
            ends = np.cumsum(lens)
            ids, scores = np.frombuffer(r.ids, np.int64), np.frombuffer(r.scores, np.int64)
            for q, e, n in zip(np.frombuffer(r.queries, np.int64), ends, lens):
                lists.setdefault(int(q), []).append((ids[e - n : e], scores[e - n : e]))
        found = []
        for q, parts in lists.items():
            ids, scores = np.concatenate([i for i, _ in parts]), np.concatenate([s for _, s in parts])
            top = best(ids, scores, k)
            found.append((q, ids[top], scores[top]))
        return pd.DataFrame([_list_row(int(frame.qtile.iloc[0]), int(frame.part.iloc[0]), found)])

    return merge


def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            lens = np.frombuffer(r["lens"], np.int32)
            query = np.repeat(np.frombuffer(r["queries"], np.int64), lens)
            rank = np.concatenate([np.arange(1, n + 1) for n in lens]) if len(lens) else np.zeros(0)
            yield pa.RecordBatch.from_pydict({"query_id": query, "rank": pa.array(rank.astype(np.int32)), "vec_id": np.frombuffer(r["ids"], np.int64), "score": np.frombuffer(r["scores"], np.int64)})


def exact_topk(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", query_tile: int = 2048, shard_rows: int = 8192, fan_in: int = 16) -> DataFrame:
    """The k candidates of highest integer inner product for each query: query_id, rank (from 1), vec_id, score.

    Components become floor(64 * x), x as double. Ties go to the smaller id. Candidates are all usable rows but those
    with the query's own id, and of its length. A row is not usable, as query or candidate, if its id or vector is null
    or holds null, NaN or infinity. A repeated candidate row appears as often as it is repeated; query rows that repeat
    an id are one query, by the smallest vector. A query without candidates has no rows. Empty tables give no rows;
    other columns are ignored. Scores are exact; a sum that a long cannot hold raises OverflowError.

    Rows are packed to tiles where they are read, so only tiles travel: each shard meets each query tile once, keyed by
    both, a partial selection keeps k per query, and lists merge in a tree of the given fan-in. Memory of a task is one
    query tile and one shard, or fan_in lists of a query tile.
    """
    slim = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    asked = queries.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).where("id is not null and v is not null and not exists(v, x -> x is null or isnan(x) or abs(x) = double('infinity'))").groupBy("id").agg(F.min("v").alias("v"))
    shards = stored(slim.mapInArrow(packer(shard_rows), PACKED), "topk-shards")
    asked = stored(asked, "topk-asked")
    tiles = stored(asked.repartition(max(1, -(-asked.count() // query_tile))).mapInArrow(packer(query_tile), PACKED), "topk-queries")
    numbered = tiles.select(F.col("tile").alias("qtile"), "dim", F.col("kind").alias("q_kind"), F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"))
    salted = shards.select("tile", "dim", F.pmod(F.xxhash64("tile"), F.lit(SALTS)).cast("long").alias("salt"))
    product = salted.join(numbered.select("qtile", "dim", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt")), ["dim", "salt"]).select("qtile", "tile")
    pairs = product.join(numbered, "qtile").join(shards.drop("dim"), "tile").withColumnRenamed("tile", "part")
    lists = pairs.select("qtile", "part", "dim", "q_kind", "q_ids", "q_vectors", "kind", "ids", "vectors").mapInArrow(tile_search(k), LISTS)
    level = lists.withColumn("part", F.xxhash64("part"))
    width = shards.count()
    while width > 1:
        width = -(-width // fan_in)
        level = level.withColumn("part", F.pmod(F.col("part"), F.lit(width))).groupBy("qtile", "part").applyInPandas(merger(k), LISTS)
    return level.mapInArrow(unpack, "query_id long, rank int, vec_id long, score long")
