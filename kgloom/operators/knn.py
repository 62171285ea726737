"""Nearest vectors by distance or product: blocks of queries meet partitions of candidates as matrices, and partial lists are ranked last."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

METRICS = ("euclidean", "dot", "cosine")

# Distances that a task measures at once, and pairs in a frame of all pairs.
CELLS, PAIRS = 1 << 22, 1 << 17


def _distances(q: np.ndarray, c: np.ndarray, metric: str) -> np.ndarray:
    """Smaller is nearer; the dot product comes with its sign changed."""
    if metric == "dot":
        return -(q @ c.T)
    if metric == "cosine":
        return 1 - (q @ c.T) / (np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(c, axis=1)[None, :])
    return np.sqrt(np.stack([((c - row) ** 2).sum(1) for row in q])) if len(q) else np.zeros((0, len(c)))


def _augmented(c: np.ndarray, metric: str) -> tuple[np.ndarray, float]:
    """(candidates in single precision, with their squares as a last column where distances need them, and the greatest norm)."""
    squares = (c**2).sum(1)
    with np.errstate(over="ignore"):
        return np.concatenate([c, squares[:, None]] if metric == "euclidean" else [c], axis=1).astype(np.float32), float(np.sqrt(squares.max()))


def _within(q: np.ndarray, c: tuple[np.ndarray, float], metric: str, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows of q, rows of candidates) of all pairs that may be among the k nearest of a query after rounding to 6 places, and few others.

    Distances come from one product of matrices in single precision, with a bound of its error. Candidates are dealt to
    strips; the k-th least of the strips' minima bounds a query's k-th distance, and only strips that reach it are read.
    """
    right, greatest = c
    norms = (q**2).sum(1)
    error = 8 * (q.shape[1] + 8) * np.finfo(np.float32).eps * (np.sqrt(norms) + greatest) ** 2 + 1e-30
    blocks = min(64, len(right) // (4 * k))
    if blocks < 2 or not np.isfinite(error).all() or error.max() > 1e37:
        return tuple(x.ravel() for x in np.indices((len(q), len(right))))
    strips = len(right) // blocks
    whole = blocks * strips
    square = metric == "euclidean"
    left = np.concatenate([-2 * q, np.ones((len(q), 1))] if square else [-q], axis=1).astype(np.float32)
    near = left @ right.T
    cut = near[:, :whole].reshape(len(q), blocks, strips)
    least = cut.min(1)
    bound = np.partition(least, k - 1, axis=1)[:, k - 1].astype(np.float64)
    if square:
        bound = (np.sqrt(np.maximum(bound + norms, 0) + error) + 2e-6) ** 2 - norms + error
    else:
        bound = bound + 2e-6 + error
    at, strip = np.nonzero(least <= bound[:, None])
    pair, block = np.nonzero(cut[at, :, strip] <= bound[at][:, None])
    rest, more = np.nonzero(near[:, whole:] <= bound[:, None])
    return np.concatenate([at[pair], rest]), np.concatenate([block * strips + strip[pair], whole + more])


def _paired(q: np.ndarray, c: np.ndarray, metric: str) -> np.ndarray:
    """Distances of the rows of q to those of c beside them."""
    if metric == "dot":
        return -np.einsum("ij,ij->i", q, c)
    return np.sqrt(((c - q) ** 2).sum(1))


def _best(asked: tuple, ids: np.ndarray, cand: np.ndarray, k: int, metric: str, own: bool) -> Iterator[pd.DataFrame]:
    """query, candidate, dist of the k nearest among some candidates. Distances are measured one by one where a product of matrices doesn't rule the pair out."""
    names, matrix = np.asarray(asked[0], object), asked[1]
    place = np.empty(len(ids), np.int64)
    place[np.argsort(ids, kind="stable")] = np.arange(len(ids))
    step, augmented = max(1, CELLS // len(ids)), _augmented(cand, metric)
    for lo in range(0, len(names), step):
        part = matrix[lo : lo + step]
        if metric == "cosine":
            at, found = (x.ravel() for x in np.indices((len(part), len(ids))))
            dist = np.round(_distances(part, cand, metric), 6).ravel()
        else:
            at, found = _within(part, augmented, metric, k + (not own))
            dist = np.concatenate([np.round(_paired(part[at[i : i + CELLS // 64]], cand[found[i : i + CELLS // 64]], metric), 6) for i in range(0, max(1, len(at)), CELLS // 64)])
        if not own:
            kept = ids[found] != names[lo + at]
            at, found, dist = at[kept], found[kept], dist[kept]
        order = np.lexsort((place[found], dist, at))
        at, found, dist = at[order], found[order], dist[order]
        first = np.arange(len(at)) - np.searchsorted(at, at) < k
        yield pd.DataFrame({"query": names[lo + at[first]], "candidate": ids[found[first]], "dist": dist[first]})


def _every(asked: tuple, ids: np.ndarray, cand: np.ndarray, metric: str, own: bool) -> Iterator[pd.DataFrame]:
    """query, candidate, dist of all pairs, at most PAIRS (or a query's) in a frame."""
    names, matrix = np.asarray(asked[0], object), asked[1]
    for at in range(0, len(ids), PAIRS):
        among, vectors = ids[at : at + PAIRS], cand[at : at + PAIRS]
        step = max(1, PAIRS // len(among))
        for lo in range(0, len(names), step):
            queries, candidates = np.repeat(names[lo : lo + step], len(among)), np.tile(among, len(names[lo : lo + step]))
            dist = np.round(_distances(matrix[lo : lo + step], vectors, metric), 6).ravel()
            kept = slice(None) if own else queries != candidates
            yield pd.DataFrame({"query": queries[kept], "candidate": candidates[kept], "dist": dist[kept]})


def _lists(asked: tuple, ids: np.ndarray, cand: np.ndarray, k: int | None, metric: str, own: bool) -> Iterator[pd.DataFrame]:
    """query, candidate, dist of the k nearest among some candidates (all without k)."""
    return _every(asked, ids, cand, metric, own) if k is None else _best(asked, ids, cand, k, metric, own)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def _against(shared, k: int | None, metric: str, own: bool):
    """mapInPandas function: candidates as they are read against all queries, which are broadcast."""

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame) and len(shared.value[0]):
                yield from _lists(shared.value, frame["id"].to_numpy(), _matrix(frame["vec"]), k, metric, own)

    return search


def _tiled(k: int | None, metric: str, own: bool):
    """A tile of queries against a shard of candidates."""

    def search(asked: pd.DataFrame, cand: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(cand):
            return pd.DataFrame({"query": np.empty(0, object), "candidate": np.empty(0, object), "dist": np.empty(0)})
        return pd.concat(list(_lists((asked["id"].to_numpy(), _matrix(asked["vec"])), cand["other"].to_numpy(), _matrix(cand["against"]), k, metric, own)))

    return search


def encoder(make, batch: int = 128, max_chars: int | None = None):
    """A function from a text column to its vectors. make() gives a function from a list of texts to rows of numbers; it runs once a task, so a model is loaded once, and gets batches of texts, cut to max_chars where that is given. Null texts have null vectors."""

    @F.pandas_udf("array<double>")
    def encode(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for s in series:
            texts, out = [t[:max_chars] for t in s if t is not None], []
            for lo in range(0, len(texts), batch):
                out += [[float(x) for x in row] for row in model(texts[lo : lo + batch])]
            rows = iter(out)
            yield pd.Series([None if t is None else next(rows) for t in s], dtype=object)

    return encode


def _product(queries: DataFrame, candidates: DataFrame, k: int | None, metric: str, block_rows: int, own: bool) -> DataFrame:
    """query, candidate, dist: each query's k best candidates of each part of the candidates (all without k)."""
    if metric not in METRICS:
        raise ValueError(f"no metric {metric!r}")
    kind, asked = dict(candidates.dtypes)["id"], dict(queries.dtypes)["id"]
    schema = f"query {asked}, candidate {kind}, dist double"
    asking, among = (df.select("id", "vec").where("vec is not null") for df in (queries, candidates))
    first = asking.limit(block_rows + 1).collect()
    if len(first) <= block_rows:
        matrix = np.array([r.vec for r in first], np.float64)
        shared = candidates.sparkSession.sparkContext.broadcast(([r.id for r in first], matrix))
        return among.mapInPandas(_against(shared, k, metric, own), schema)
    # lists of k are short, so tiles are large and rows copied seldom; all pairs of a tile and a shard go out at once, so these are small
    rows = (4 * block_rows, 8 * block_rows) if k else (max(1, block_rows // 16),) * 2
    tiles, shards = (max(1, -(-df.count() // n)) for df, n in zip((asking, among), rows))
    deal = lambda df, key, n, copies, other: df.withColumn(key, F.pmod(F.xxhash64(df.columns[0]), F.lit(n)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    # names of their own: both sides may come from one table
    left, right = deal(asking, "_tile", tiles, shards, "_shard"), deal(among.select(F.col("id").alias("other"), F.col("vec").alias("against")), "_of_shard", shards, tiles, "_of_tile")
    return left.groupBy("_tile", "_shard").cogroup(right.groupBy("_of_tile", "_of_shard")).applyInPandas(_tiled(k, metric, own), schema)


def _signed(df: DataFrame, metric: str) -> DataFrame:
    return df.withColumn("dist", -F.col("dist")) if metric == "dot" else df


def nearest(queries: DataFrame, candidates: DataFrame, k: int, metric: str = "euclidean", block_rows: int = 8192, own: bool = True) -> DataFrame:
    """query, rank, candidate, dist: the k nearest candidates of each query, ties by id; distances to 6 places.

    queries, candidates: id, vec; null vectors take no part. Candidates of the query's own id count only with own. Up to
    block_rows queries are broadcast, and meet the candidates where these are read. More are dealt to tiles of about 4
    block_rows, candidates to shards of about 8, and each tile meets each shard in a task. Either way k candidates for
    each query and part are ranked last.
    """
    found = _product(queries, candidates, k, metric, block_rows, own)
    rank = F.row_number().over(W.partitionBy("query").orderBy("dist", "candidate"))
    return _signed(found.withColumn("rank", rank).where(F.col("rank") <= k), metric).select("query", "rank", "candidate", "dist")


def cosine_distance(a, b):
    """1 - cosine of two array columns, in expressions."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return 1 - dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def pairwise_cosine(vectors: DataFrame, others: DataFrame | None = None, block_rows: int = 8192) -> DataFrame:
    """left, right, dist for all pairs of a given list of vectors (id, vec), or of it and others: the list is a query set, whose distances to all of the others are asked for; they are not ranked."""
    pairs = _product(vectors, vectors if others is None else others, None, "cosine", block_rows, True)
    return pairs.select(F.col("query").alias("left"), F.col("candidate").alias("right"), "dist")
