"""N-gram Jaccard join: pivots cut the metric space to regions, the triangle inequality says which documents a region must borrow, regions join exactly.

Jaccard distance, 1 - J, is a metric, but among texts nearly all distances are 1: pivots that are documents don't
divide documents that share nothing. So the first pivots are the sets of a single shingle. A document's nearest such
pivots are its own shingles; in a fixed order of the pivots, documents that drop their first k of n shingles move k / n
away, so a pair within distance e = 1 - t shares one of the first floor(e * n) + 1 of both. These are the windows that
replicate a document to regions, and documents whose windows meet, directly or through others, form one region.
Regions that are still large are cut by pivots that are documents, and there the metric divides well: each document
has the nearest pivot's cell for its home and is lent to cells whose pivot is at most 2e farther. Cells are cut again
until they fit a task. A set remembers by a bit for each level where it was lent; two sets that were both lent somewhere
meet in another cell, so they are not compared there. What doesn't come apart is split by the shingles of the windows,
where sets that share some without being near each other part; a dense group is compared tile against tile.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgloom.llm.common import discard, release, stored, stored_by
from kgloom.llm.components import connected
from kgloom.llm.hashing import lower, mix, word_hashes

_PLACE = np.random.default_rng(20_240_601).integers(1, 1 << 63, 16, dtype=np.uint64) | np.uint64(1)

#: A block holds at most so many sets, and this number marks shingles that several of them hold.
MARK = 0xFFFF


def shingle_sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    """The sorted distinct shingle ids of each text; texts of fewer words have one, of all their words."""
    joined = lower(b" ".join(texts))
    lens = np.fromiter(map(len, texts), np.int64, len(texts))
    at = np.cumsum(lens + 1) - lens - 1
    words, start, _ = word_hashes(joined)
    cuts = np.searchsorted(start, np.append(at, len(joined) + 1))
    if len(words) >= size:
        grams = sum((words[k : len(words) - size + 1 + k] * _PLACE[k] for k in range(size)), np.zeros(len(words) - size + 1, np.uint64))
        grams = mix(grams)
    out = []
    for lo, hi in zip(cuts, cuts[1:]):
        if hi - lo >= size:
            out.append(np.unique(grams[lo : hi - size + 1]))
        elif hi > lo:
            whole = np.uint64(hi - lo) + (words[lo:hi] * _PLACE[8 : 8 + hi - lo] if hi - lo <= 8 else words[lo:hi]).sum()
            out.append(mix(np.array([whole], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def pack(ids: np.ndarray, owner: np.ndarray) -> bytes:
    """Byte planes of sorted ids and of their owners: the high planes hardly take space once compressed."""
    return ids.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes() + owner.astype("<u2").view(np.uint8).reshape(-1, 2).T.tobytes()


def unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(blob) // 10
    planes = np.frombuffer(blob, np.uint8).reshape(10, n)
    return np.ascontiguousarray(planes[:8].T).view("<u8").ravel(), np.ascontiguousarray(planes[8:].T).view("<u2").ravel()


DOC, ASK, HIT, META = range(4)
_ROWS = pa.schema([("key", pa.int64()), ("kind", pa.int32()), ("block", pa.int64()), ("id", pa.int64()), ("sid", pa.binary()), ("n", pa.int32()), ("blob", pa.binary())])
ROWS = "key long, kind int, block long, id long, sid binary, n int, blob binary"


def _blocks(size: int, shards: int, chars: int):
    """mapInArrow function: documents to rows for the shards, a block of texts at a time."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            ids, texts, lo = batch.column(0).to_pylist(), batch.column(1), 0
            while lo < batch.num_rows:
                part, hi, total = [], lo, 0
                while hi < batch.num_rows and (not part or total < chars) and len(part) < MARK - 1:
                    part.append((texts[hi].as_py() or "").encode("utf-8", "surrogatepass"))
                    total += len(part[-1])
                    hi += 1
                block += 1
                yield _block_rows(block, ids[lo:hi], shingle_sets(part, size), shards)
                lo = hi
        release()

    return emit


def _block_rows(block: int, doc_ids: list, sets: list[np.ndarray], shards: int) -> pa.RecordBatch:
    out: dict[str, list] = {k: [] for k in _ROWS.names}

    def row(**values):
        for k in out:
            out[k].append(values.get(k))

    home = int(mix(np.array([block], np.uint64))[0] % np.uint64(shards))  # what isn't asked of a shard travels with any
    number: dict[bytes, int] = {}
    own: list[np.ndarray] = []
    for doc_id, ids in zip(doc_ids, sets):
        sid = xxhash.xxh3_128_digest(ids.tobytes()) if len(ids) else None
        row(key=home, kind=DOC, id=doc_id, sid=sid, n=len(ids))
        if sid is not None and sid not in number:
            number[sid] = len(own)
            own.append(ids)
    if own:
        ids = np.concatenate(own)
        owner = np.repeat(np.arange(len(own), dtype=np.uint16), [len(x) for x in own])
        order = np.argsort(ids, kind="stable")
        ids, owner = ids[order], owner[order]
        first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
        count = np.diff(np.append(first, len(ids)))
        several = np.repeat(count > 1, count)
        if several.any():
            row(key=home, kind=HIT, block=block, blob=pack(ids[several], owner[several]))
        row(key=home, kind=META, block=block, blob=np.array([len(x) for x in own], "<u4").tobytes(), sid=b"".join(number))
        asked, by = ids[first], np.where(count > 1, MARK, owner[first])
        shard = ((asked >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)
        cuts = [0, *(np.flatnonzero(shard[1:] != shard[:-1]) + 1).tolist(), len(shard)]
        for a, b in zip(cuts, cuts[1:]):  # only the shards that the block asks
            row(key=int(shard[a]), kind=ASK, block=block, blob=pack(asked[a:b], by[a:b]))
    return pa.RecordBatch.from_pydict(out, _ROWS)


def _answer(table: pa.Table) -> pa.Table:
    """Rows of a shard: for each block, the shingles that it asked for and that another block has, or another set of a block."""
    kinds = table.column("kind").to_numpy()
    rest, asks = table.filter(pa.array(kinds != ASK)), table.filter(pa.array(kinds == ASK))
    if not len(asks):
        return rest
    blocks = asks.column("block").to_pylist()
    parts = [unpack(b.as_py()) for b in asks.column("blob")]
    ids, owner = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    source = np.repeat(np.arange(len(parts), dtype=np.int32), [len(p[0]) for p in parts])
    del parts, asks
    order = np.argsort(ids, kind="stable")
    ids = ids[order]
    same = ids[1:] == ids[:-1]
    shared = np.concatenate([[False], same]) | np.concatenate([same, [False]])
    order, ids = order[shared], ids[shared]  # most shingles are nowhere else
    hit = owner[order] != MARK
    order, ids = order[hit], ids[hit]
    owner, source = owner[order], source[order]
    order = np.argsort(source, kind="stable")
    ids, owner, source = ids[order], owner[order], source[order]
    out: dict[str, list] = {k: [] for k in _ROWS.names}
    cuts = [0, *(np.flatnonzero(source[1:] != source[:-1]) + 1).tolist(), len(source)] if len(source) else [0]
    for a, b in zip(cuts, cuts[1:]):
        k = source[a]
        for name, value in {"key": 0, "kind": HIT, "block": blocks[k], "id": None, "sid": None, "n": None, "blob": pack(ids[a:b], owner[a:b])}.items():
            out[name].append(value)
    return pa.concat_tables([rest.cast(_ROWS), pa.Table.from_pydict(out, _ROWS)])


def needed(n, percent: int):
    """Shingles that a set of n shares with any set it links to."""
    return -(-n * percent // 100)


def lists(column: pa.ChunkedArray) -> list[np.ndarray]:
    """The rows of a column of lists, without a copy."""
    whole = column.combine_chunks()
    values, ends = whole.values.to_numpy(zero_copy_only=False), whole.offsets.to_numpy()
    return [values[a:b] for a, b in zip(ends, ends[1:])]


def list_array(rows: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, rows)])
    return pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), pa.array(np.concatenate([np.zeros(0, np.int64), *rows]))).cast(pa.list_(pa.int64()))


def _assemble(percent: int):
    """applyInArrow function: a block's sets of which enough shingles are shared, with these shingles."""

    def assemble(table: pa.Table) -> pa.Table:
        rows = table.select(["kind", "blob", "sid"]).to_pylist()
        meta, hits = [r for r in rows if r["kind"] == META], [unpack(r["blob"]) for r in rows if r["kind"] == HIT]
        sizes = np.frombuffer(meta[0]["blob"] if meta and hits else b"", "<u4")
        names = meta[0]["sid"] if meta else b""
        ids, owner = (np.concatenate([h[k] for h in hits]) if hits else np.zeros(0, np.int64) for k in (0, 1))
        order = np.argsort(owner, kind="stable")
        ids, owner = ids[order], owner[order]
        cuts = np.searchsorted(owner, np.arange(len(sizes) + 1))
        good = np.flatnonzero(np.diff(cuts) >= needed(sizes.astype(np.int64), percent))
        found = [np.sort(ids[cuts[k] : cuts[k + 1]]).astype(np.int64) for k in good]
        return pa.table({"sid": pa.array([names[16 * k : 16 * k + 16] for k in good], pa.binary()), "n": pa.array(sizes[good].astype(np.int32), pa.int32()), "ids": list_array(found)})

    return assemble


def overlaps(sets: list[np.ndarray], others: list[np.ndarray] | None = None, width: int = 2048) -> np.ndarray:
    """Sizes of all intersections, exactly: products of 0/1 matrices over the shingles that two sets hold, some columns at a time."""
    both = [*sets, *(others or [])]
    ids = np.concatenate(both) if both else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(both)), [len(x) for x in both])
    _, column, count = np.unique(ids, return_inverse=True, return_counts=True)
    many = count > 1
    place = np.cumsum(many) - 1
    keep = many[column]
    owner, column = owner[keep], place[column[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    n, total = len(sets), int(many.sum())
    out = np.zeros((n, len(others) if others is not None else n), np.float32)
    for lo in range(0, total, width):
        a, b = np.searchsorted(column, [lo, lo + width])
        grid = np.zeros((len(both), min(width, total - lo)), np.float32)
        grid[owner[a:b], column[a:b] - lo] = 1
        out += grid[:n] @ (grid[n:] if others is not None else grid).T
    return out.astype(np.int64)


def linked(inter: np.ndarray, n_left: np.ndarray, n_right: np.ndarray, percent: int) -> np.ndarray:
    """100 * J >= percent, a slice of rows at a time."""
    out = np.empty(inter.shape, bool)
    for lo in range(0, len(inter), 256):
        own = inter[lo : lo + 256]
        out[lo : lo + 256] = (100 + percent) * own >= percent * (n_left[lo : lo + 256, None] + n_right[None, :])
    return out


LINKS = "sid binary, hub binary, links long"


def _join_region(percent: int):
    """applyInArrow function: all pairs of a region (mode 0), or of its sides (mode 1), but those that were lent at one level, and those that meet in the region of an earlier shingle."""

    def join(region: pa.Table) -> pa.Table:
        side = region.column("side").to_numpy()
        sides = [region] if region.column("mode")[0].as_py() == 0 else [region.filter(pa.array(side == k)) for k in (0, 1)]
        left, right = sides[0], sides[-1]
        names = [sid for t in sides for sid in t.column("sid").to_pylist()]
        n, mask, copies = ([t.column(c).to_numpy().astype(np.int64) for t in (left, right)] for c in ("n", "mask", "copies"))
        grid = linked(overlaps(lists(left.column("ids")), lists(right.column("ids")) if len(sides) > 1 else None), n[0], n[1], percent)
        grid &= (mask[0][:, None] & mask[1][None, :]) == 0
        earlier = [lists(t.column("before")) for t in (left, right)]
        if sum(map(len, earlier[0])) and sum(map(len, earlier[1])):
            grid &= overlaps(earlier[0], earlier[1] if len(sides) > 1 else None) == 0
        if len(sides) == 1:
            np.fill_diagonal(grid, False)
            links = grid @ copies[0]
        else:
            links = np.concatenate([grid @ copies[1], grid.T @ copies[0]])
        hub = np.arange(len(names))
        rows, cols = np.nonzero(grid)
        cols = cols + (len(left) if len(sides) > 1 else 0)
        while len(rows):  # the least place among neighbours, until it stays
            new = hub.copy()
            np.minimum.at(new, rows, hub[cols])
            np.minimum.at(new, cols, hub[rows])
            new = new[new]
            if (new == hub).all():
                break
            hub = new
        at = np.flatnonzero(links > 0)
        return pa.table({"sid": pa.array([names[k] for k in at], pa.binary()), "hub": pa.array([names[k] for k in hub[at]], pa.binary()), "links": pa.array(links[at], pa.int64())})

    return join


def _pivot_distances(percent: int, bit: int):
    """Cogrouped function: sets of a slice of a region, the region's pivots; each set's home cell, and the cells it is lent to, which sets its bit of this level."""
    reach = 1 - percent / 100

    def cells(sets: pa.Table, pivots: pa.Table) -> pa.Table:
        pivots = pivots.sort_by("sid")
        n, p = sets.column("n").to_numpy().astype(np.int64), pivots.column("n").to_numpy().astype(np.int64)
        inter = overlaps(lists(sets.column("ids")), lists(pivots.column("ids")))
        far = 1 - inter / (n[:, None] + p[None, :] - inter)
        home = far.argmin(1)
        lent = (far <= far.min(1)[:, None] + 2 * reach + 1e-9) & (np.arange(len(p))[None, :] < home[:, None])
        i, j = np.nonzero(lent)
        at, cell = np.concatenate([np.arange(len(n)), i]), np.concatenate([home, j])
        mask = sets.column("mask").to_numpy()[at] | np.repeat([0, 1 << bit], [len(n), len(i)])
        rows = sets.take(pa.array(at))
        return pa.table({"parent": rows.column("region"), "cell": pa.array(cell, pa.int32()), "sid": rows.column("sid"), "n": rows.column("n"), "copies": rows.column("copies"), "ids": rows.column("ids"), "mask": pa.array(mask, pa.int64())})

    return cells


_SET = ["sid", "n", "copies", "ids", "mask"]
#: The shingles before a region's own, which only regions of one shingle have.
_NONE = "cast(array() as array<long>)"


def _cut(sized: DataFrame, percent: int, bit: int, pivots: int, limit: int) -> DataFrame:
    """One level of cells, of regions with their _rows and _cost; the new region's name is made of the old one's and the cell's number."""
    slices = F.ceil(F.col("_cost") / limit)
    sliced = sized.withColumn("slice", F.pmod(F.xxhash64("sid"), slices).cast("long")).select("region", "slice", *_SET)
    # pivots by hash, about twice as many as asked for, of which the first are taken
    few = sized.where(F.pmod(F.xxhash64(F.lit(11 + bit), "sid"), F.lit(1 << 20)) < F.lit(1 << 20) * (2 * pivots + 8) / F.col("_rows"))
    chosen = few.groupBy("region", "_cost").agg(F.slice(F.sort_array(F.collect_set(F.struct(F.xxhash64(F.lit(5 + bit), "sid").alias("h"), "sid", "n", "ids"))), 1, pivots).alias("p"))
    spread = chosen.select("region", F.explode(F.sequence(F.lit(0).cast("long"), slices.cast("long") - 1)).alias("slice"), "p").select(F.col("region").alias("owner"), F.col("slice").alias("part"), F.explode("p").alias("p")).select("owner", "part", "p.sid", "p.n", "p.ids")
    cells = sliced.groupBy("region", "slice").cogroup(spread.groupBy("owner", "part")).applyInArrow(_pivot_distances(percent, bit), "parent binary, cell int, sid binary, n int, copies long, ids array<long>, mask long")
    return cells.select("parent", F.unhex(F.md5(F.concat("parent", F.col("cell").cast("string").cast("binary")))).alias("region"), *_SET)


def _sized(regions: DataFrame, limit: int, region_ids: int) -> DataFrame:
    """Regions with how many sets they have (_rows) and what they cost a task, in sets (_cost)."""
    counts = regions.groupBy("region").agg(F.count(F.lit(1)).alias("_rows"), F.sum(F.size("ids")).alias("_ids"))
    cost = F.greatest(F.col("_rows"), F.ceil(F.col("_ids") * limit / region_ids)).alias("_cost")
    return regions.join(counts.select("region", "_rows", cost), "region")


def _by_shingle(sized: DataFrame, windows: DataFrame) -> DataFrame:
    """Regions split by window shingle, where that leaves fewer pairs than half of all: (region, sets, before).

    Sets that link share a shingle of both windows, so they meet in its region; in the first one of these that they
    share, told by the shingles before it, they are compared. Shingles that the same sets hold are one.
    """
    held = sized.select("region", "_rows", "sid").join(windows, "sid")
    members = held.groupBy("region", "_rows", "h").agg(F.count(F.lit(1)).alias("_df"), F.sum(F.xxhash64("sid").cast("decimal(38,0)")).alias("_sum"), F.bit_xor(F.xxhash64(F.lit(3), "sid")).alias("_xor")).where("_df > 1")
    one = members.groupBy("region", "_rows", "_df", "_sum", "_xor").agg(F.min("h").alias("h"))
    cheaper = one.groupBy("region", "_rows").agg(F.sum(F.col("_df").cast("double") * F.col("_df")).alias("_pairs")).where("2 * _pairs < _rows * cast(_rows as double)").select("region")
    kept = one.select("region", "h").join(cheaper, "region")
    lists = held.select("region", "sid", "h").join(kept, ["region", "h"]).groupBy("region", "sid").agg(F.sort_array(F.collect_list("h")).alias("_hs"))
    each = lists.select("region", "sid", "_hs", F.posexplode("_hs").alias("_at", "h")).select("region", "sid", "h", F.slice("_hs", F.lit(1), F.col("_at")).alias("before"))
    return each.join(sized.select("region", *_SET), ["region", "sid"]).select(F.col("region").alias("parent"), F.unhex(F.md5(F.concat("region", F.col("h").cast("string").cast("binary")))).alias("region"), *_SET, "before")


def _tiles(sized: DataFrame, limit: int) -> DataFrame:
    """All pairs of a region in pairs of tiles, each of about half a task's cost: a tile by itself, then each with every later one."""
    t = sized.withColumn("_tiles", F.ceil(2 * F.col("_cost") / limit).cast("int"))
    t = t.withColumn("_t", F.pmod(F.xxhash64("sid"), F.col("_tiles")).cast("int"))
    each = t.select("region", "_t", F.explode(F.sequence(F.lit(0), F.col("_tiles") - 1)).alias("_o"), *_SET, "before")
    pair = F.unhex(F.md5(F.concat("region", F.concat_ws(":", F.lit(""), F.least("_t", "_o"), F.greatest("_t", "_o")).cast("binary"))))
    return each.select(pair.alias("region"), *_SET, "before", (F.col("_t") > F.col("_o")).cast("int").alias("side"), (F.col("_t") != F.col("_o")).cast("int").alias("mode"))


#: Beyond so many levels a set's bits are used up; no level leaves a cell with more than three quarters of its region.
LEVELS = 60


def join_regions(regions: DataFrame, percent: int, limit: int = 1200, region_ids: int = 2_000_000, pivots: int = 16, windows: DataFrame | None = None) -> DataFrame:
    """(sid, hub, links) of the sets of each region (region, sid, n, copies, ids). windows: sid, h of the shingles that sets which link share.

    A region of at most limit sets and region_ids shingles is one task. Larger ones are cut by pivots, and their cells
    again, as long as the largest cell has at most three quarters of its region's sets and the cells together at most
    four times as many. Others, whose sets share shingles without being near each other, or are one dense group, are
    split by window shingle where that leaves fewer pairs (_by_shingle); what is still large goes to tiles.
    """
    join = lambda df: df.groupBy("region").applyInArrow(_join_region(percent), LINKS)
    alone = lambda df: df.withColumn("before", F.expr(_NONE))
    within = lambda df: join(df.select("region", *_SET, "before", F.lit(0).alias("side"), F.lit(0).alias("mode")))
    found, todo, cells = [], regions.select("region", *[c for c in _SET if c != "mask"], F.lit(0).cast("long").alias("mask")), None

    def undivided(large: DataFrame) -> None:
        if windows is None:
            found.append(join(_tiles(alone(large), limit)))
            return
        split = stored(_by_shingle(large, windows), "shingle-regions")
        parts = _sized(split.drop("parent"), limit, region_ids)
        found.append(within(parts.where(F.col("_cost") <= limit)))
        found.append(join(_tiles(parts.where(F.col("_cost") > limit), limit)))
        rest = large.join(split.select(F.col("parent").alias("region")).distinct(), "region", "left_anti")
        found.append(join(_tiles(alone(rest), limit)))

    for level in range(LEVELS + 1):
        sized = stored(_sized(todo, limit, region_ids), "regions")
        if cells is not None:
            discard(cells)
        small, large = sized.where(F.col("_cost") <= limit), sized.where(F.col("_cost") > limit)
        found.append(within(alone(small)))
        if large.isEmpty():
            break
        if level == LEVELS:
            undivided(large)
            break
        cells = stored(_cut(large, percent, level, pivots, limit), "cells")
        parts = cells.groupBy("parent", "region").agg(F.count(F.lit(1)).alias("_n")).groupBy("parent").agg(F.max("_n").alias("_top"), F.sum("_n").alias("_all"))
        whole = stored(large.select("region", "_rows").distinct().join(parts, F.col("region") == F.col("parent")).where("4 * _top > 3 * _rows or _all > 4 * _rows").select("region"), "regions")
        if not whole.isEmpty():
            undivided(large.join(whole, "region", "left_semi"))
        todo = cells.join(whole, cells["parent"] == whole["region"], "left_anti").drop("parent")
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def similar_documents(docs: DataFrame, percent: int = 75, size: int = 5, id_col: str = "doc_id", text_col: str = "text", limit: int = 1200, shard_bytes: int = 4 << 20, block_chars: int = 2 << 20) -> DataFrame:
    """id, n_shingles, component_id, n_links for each row of docs: the exact join of texts whose sets of word shingles have 100 * J >= percent.

    Words are runs of characters other than ASCII blanks, with A-Z lower-cased; a set holds the distinct shingles of
    size words, or, with fewer words, all of them as one. Rows with equal sets are linked; null and blank texts have
    an empty set and link with nothing. component_id is the smallest id that links reach, n_links counts the linked
    rows. A null id is a document like others, and names a component only where no id is there (null). Repeated rows
    count as rows. An empty table gives an empty result. Other columns are ignored. Ids that are not numbers are null.

    Steps: (1) sets of a block of texts go to shards by shingle, each shingle once a block however many texts hold it,
    and shards answer which of them others have too; (2) only sets with percent of their shingles shared can link, the
    rest (most texts) go no further; (3) these are joined by region as the module says, in the order of rising document
    frequency; (4) components of the links. Shingles are known by 64 bits, sets by 128: among 10**10 documents of 1,000
    shingles, 3e-4 documents are expected to hold two shingles of one number, and a pair that is compared does so
    with a chance of 5e-14.
    """
    spark = docs.sparkSession
    slim = docs.select(F.expr(f"try_cast(`{id_col}` as long)").alias("id"), F.col(text_col).alias("text"))
    total = slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(8, -(-total // shard_bytes))
    rows = slim.mapInArrow(_blocks(size, shards, block_chars), ROWS)
    answered = stored_by(rows.groupBy("key").applyInArrow(_answer, ROWS), "kind", (DOC, HIT, META), "jaccard-answers", "zstd")
    members = answered[DOC].select("id", "sid", "n")
    copies = members.where("sid is not null").groupBy("sid").agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("rep"))
    told = answered[HIT].withColumn("kind", F.lit(HIT)).unionByName(answered[META].withColumn("kind", F.lit(META)))
    likely = told.groupBy("block").applyInArrow(_assemble(percent), "sid binary, n int, ids array<long>")
    likely = likely.groupBy("sid").agg(F.first("n").alias("n"), F.first("ids").alias("ids"))
    likely = stored(likely.join(copies.select("sid", "copies"), "sid"), "jaccard-sets", "zstd")
    for table in (answered[HIT], answered[META]):
        discard(table)
    each = likely.select("sid", "n", F.explode("ids").alias("h"))
    frequent = each.groupBy("h").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    shared = each.join(frequent, "h").groupBy("sid", "n").agg(F.sort_array(F.collect_list(F.struct("df", "h"))).alias("by_df"))
    window = F.expr(f"n - ((n * {percent} + 99) div 100) + 1 - (n - size(by_df))")
    windows = stored(shared.where(window > 0).select("sid", F.explode(F.slice("by_df", F.lit(1), window.cast("int"))).alias("w")).select("sid", "w.h"), "jaccard-windows")
    hubs = windows.groupBy("h").agg(F.min("sid").alias("hub"))
    stars = connected(windows.join(hubs, "h").select(F.col("sid").alias("u"), F.col("hub").alias("v")))
    placed = stars.select(F.col("u").alias("sid"), F.col("v").alias("region")).union(stars.select(F.col("v").alias("sid"), F.col("v").alias("region")).distinct())
    regions = likely.join(placed, "sid").select("region", "sid", "n", "copies", "ids")
    links = stored(join_regions(regions, percent, limit, windows=windows), "jaccard-links")
    for table in (likely, stars, windows):
        discard(table)
    degree = links.groupBy("sid").agg(F.sum("links").alias("links"))
    roots = connected(links.select(F.col("sid").alias("u"), F.col("hub").alias("v")))
    sets = copies.join(roots.select(F.col("u").alias("sid"), F.col("v").alias("root")), "sid", "left").join(degree, "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    least = sets.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = sets.join(least, "root").select("sid", "component_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    out = members.join(named, "sid", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), F.when(F.col("sid").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))
