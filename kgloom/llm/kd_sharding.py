"""Sharding by a k-d tree: nodes split at distributed weighted medians along their widest metadata dimension."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from kgloom.llm.common import discard, fresh, stored

#: A coordinate is 30 bits of a dimension and below them 32 bits of the group's hash, which order the group among equals.
DIM_BITS, TIE_BITS = 30, 32


def _at(dims: list[str], index: str) -> Column:
    return F.element_at(F.array(*dims), F.col(index))


def _bins(groups: DataFrame, node: str, dims: list[str], cases: list[tuple[int, int, int, int]], bins: int, weight: str) -> dict[int, list[tuple[int, int, int]]]:
    """(weight, least and greatest coordinate) of each node's bins in order; cases: (node, dimension, low, bin width). At most nodes x bins rows reach the driver."""
    k, dim, low, width, at, x = fresh(groups, "_k", "_dim", "_low", "_width", "_at", "_x")
    table = groups.sparkSession.createDataFrame(cases, f"{k} int, {dim} int, {low} long, {width} long")
    valued = groups.join(F.broadcast(table), F.col(node) == F.col(k)).withColumn(x, _at(dims, dim))
    binned = valued.withColumn(at, F.expr(f"({x} - {low}) div {width}")).where((F.col(x) >= F.col(low)) & (F.col(at) < bins))
    out: dict[int, list] = {case[0]: [] for case in cases}
    for r in binned.groupBy(k, at).agg(F.sum(weight), F.min(x), F.max(x)).orderBy(k, at).collect():
        out[r[0]].append(tuple(r)[2:])
    return out


def kd_tree(groups: DataFrame, dims: list[str], weight: str, shards: int, node: str, room: int = 1 << 16) -> DataFrame:
    """groups, stored, with the leaf of each row, 0 to shards - 1, as column node.

    groups: a row with a weight for each group that must stay whole. dims: long coordinates. A level of the tree splits
    every node that is due more than one leaf along its widest dimension; a level's splits are a table of at most shards
    rows that meets the groups by broadcast, and the nodes are stored, so the plan doesn't grow. Each round of a level
    reads the groups once and brings back at most max(room, 64 * nodes) sums, whatever the input. A split aims at the
    weight its leaves are due and falls between two groups; a round narrows the place to the groups of one bin, so
    rounds are few: the logarithm of their number to the base bins, about.
    """
    if shards < 1:
        raise ValueError("shards must be 1 or more")
    at = stored(groups.withColumn(node, F.lit(0)), "kd-nodes")
    ends = [f(d).alias(f"{d}_{n}") for d in dims for f, n in ((F.min, "lo"), (F.max, "hi"))]
    width = lambda r, d: (r[f"{d}_hi"] >> TIE_BITS) - (r[f"{d}_lo"] >> TIE_BITS)
    todo, whole = {0: shards}, None
    while any(n > 1 for n in todo.values()):
        ranges = at.groupBy(node).agg(F.sum(weight).alias("_w"), *ends).collect()
        if not ranges:
            break
        whole = whole or {d: max(1, width(ranges[0], d)) for d in dims}
        open_ = [r for r in ranges if todo[r[node]] > 1]
        bins = max(64, room // max(1, len(open_)))
        goals, cases = {}, []
        for r in open_:
            k, n = r[node], todo[r[node]]
            i = max(range(len(dims)), key=lambda i: width(r, dims[i]) / whole[dims[i]])
            low, span = r[f"{dims[i]}_lo"], r[f"{dims[i]}_hi"] - r[f"{dims[i]}_lo"]
            goals[k] = {"due": r["_w"] * (n // 2) / n, "left": 0, "cut": low - 1, "dim": i + 1}
            cases.append((k, i + 1, low, span // bins + 1))
        while cases:
            sums, narrower = _bins(at, node, dims, cases, bins, weight), []
            for k, dim, _, _ in cases:
                g = goals[k]
                for w, lo, hi in sums[k]:
                    if g["left"] + w > g["due"]:
                        if lo == hi:  # one coordinate: it goes to the side that this leaves nearer to what is due
                            g["cut"] = lo if g["left"] + w - g["due"] < g["due"] - g["left"] else lo - 1
                        else:
                            narrower.append((k, dim, lo, (hi - lo) // bins + 1))
                        break
                    g["left"], g["cut"] = g["left"] + w, hi
            cases = narrower
        if not goals:
            break
        after = {k: n for k, n in todo.items() if k not in goals and n == 1}
        splits = []
        for k, g in goals.items():
            half = todo[k] // 2
            after |= {k: half, k + half: todo[k] - half}
            splits.append((k, g["dim"], g["cut"], k + half))
        key, dim, cut, right = fresh(at, "_k", "_dim", "_cut", "_right")
        table = at.sparkSession.createDataFrame(splits, f"{key} int, {dim} int, {cut} long, {right} int")
        split = at.join(F.broadcast(table), F.col(node) == F.col(key), "left")
        before, at = at, stored(split.withColumn(node, F.when(_at(dims, dim) > F.col(cut), F.col(right)).otherwise(F.col(node))).select(*at.columns), "kd-nodes")
        discard(before)
        todo = after
    return at


def shard_by_bytes(docs: DataFrame, shards: int | None = 8, target_bytes: int | None = None, id_col: str = "doc_id", text_col: str = "text", metadata: tuple[str, ...] = ("source", "lang"), rows_per_bucket: int = 100_000) -> DataFrame:
    """Deals documents to shards of near equal bytes; rows with equal texts share a shard.

    Nodes are split until leaves reach target_bytes: that makes as many shards as the bytes hold it, rounded up. Where
    the number of shards is given instead, the target is what each of them is due.

    A row weighs the UTF-8 bytes of its text plus 1. Dimensions of the tree are the columns named in metadata (by the
    hash of the group's smallest value), the size in bytes (logarithm) and the text's hash. A group heavier than a
    shard's due fills a shard alone, and the other shards share the rest.

    The result has every row and column of docs with size, text_crc32, slot (long), law (string), shard and grown_shard
    (int; null, this law has no growth rule), which replace columns of these names. slot numbers a shard's rows from 0
    without gaps, by hash bucket, id and text; a bucket holds about rows_per_bucket rows, so no task numbers a whole
    shard. Null texts weigh 1 and count as empty texts; null ids and metadata are values like others; repeated rows get
    a slot each; an empty table gives an empty result; metadata columns that docs lacks are left out.
    """
    text, a, b, row, node, bucket, start = fresh(docs, "_text", "_a", "_b", "_row", "_node", "_bucket", "_start")
    body = F.coalesce(F.col(text_col), F.lit(""))
    slim_cols = [c for c in docs.columns if c != text_col]
    named = [m for m in metadata if m in docs.columns]
    measured = {a: F.xxhash64(body), b: F.xxhash64(F.lit(7), body), "size": F.octet_length(body).cast("long") + 1, "text_crc32": F.crc32(body.cast("binary"))}
    codes = {f"_m{i}": F.shiftrightunsigned(F.xxhash64(F.col(m)), 64 - DIM_BITS) for i, m in enumerate(named)}
    tie = F.shiftrightunsigned(F.col(a), 64 - TIE_BITS)
    join_up = lambda dim: F.shiftleft(dim.cast("long"), TIE_BITS).bitwiseOR(tie)
    slim = docs.select(F.col(id_col).alias("_id"), *[v.alias(k) for k, v in (measured | codes).items()])
    groups = slim.groupBy(a, b).agg(F.sum("size").alias("_weight"), F.count(F.lit(1)).alias("_rows"), F.first("size").alias("_size"), *[F.min(c).alias(c) for c in codes])
    dims = {f"_d{i}": join_up(F.col(c)) for i, c in enumerate(codes)}
    dims |= {"_dsize": join_up(F.floor(F.log2("_size") * F.lit(float(1 << (DIM_BITS - 6))))), "_dhash": join_up(F.shiftrightunsigned(F.col(a), 64 - DIM_BITS))}
    groups = stored(groups.select(a, b, "_weight", "_rows", *[v.alias(k) for k, v in dims.items()]), "kd-groups")
    total, weight = (x or 0 for x in groups.agg(F.sum("_rows"), F.sum("_weight")).first())
    if target_bytes is not None:
        shards = max(1, -(-weight // target_bytes))
    leaves = kd_tree(groups, list(dims), "_weight", shards, node).select(a, b, node)
    discard(groups)
    placed = docs.withColumns(measured).select(*slim_cols, *([text_col] if text_col in docs.columns else []), *[c for c in measured if c not in docs.columns])
    placed = placed.join(leaves, [a, b])
    buckets = max(16, -(-total // max(1, rows_per_bucket)))
    placed = placed.withColumn(bucket, F.pmod(F.xxhash64(F.col(id_col), F.col(a)), F.lit(buckets)))
    counts = docs.select(F.col(id_col).alias("_id"), measured[a].alias(a), measured[b].alias(b)).join(leaves, [a, b])
    counts = counts.withColumn(bucket, F.pmod(F.xxhash64(F.col("_id"), F.col(a)), F.lit(buckets))).groupBy(node, bucket).agg(F.count(F.lit(1)).alias("_n"))
    starts = counts.withColumn(start, F.sum("_n").over(W.partitionBy(node).orderBy(bucket).rowsBetween(W.unboundedPreceding, 0)) - F.col("_n")).select(node, bucket, start)
    numbered = placed.withColumn(row, F.row_number().over(W.partitionBy(node, bucket).orderBy(id_col, a, b)) - 1).join(starts, [node, bucket])
    new = {"law": F.lit("bytes"), "shard": F.col(node).cast("int"), "slot": (F.col(start) + F.col(row)).cast("long"), "grown_shard": F.lit(None).cast("int")}
    kept = [c for c in docs.columns if c not in new and c not in ("size", "text_crc32")]
    return numbered.select(*kept, "size", "text_crc32", *[v.alias(k) for k, v in new.items()])
