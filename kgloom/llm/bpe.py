"""Byte-level BPE: codepoint classes and an associative scan of an automaton find the pieces, cached pair merging encodes them, offsets lead back."""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgloom.llm.common import fresh, release
from kgloom.llm.hashing import mix

#: Symbols of the automaton. A white space symbol says what follows; APOS1 and APOS2 are apostrophes before a contraction's one or two letters. FIRST is added at the first character of a text.
LETTER, NUMBER, OTHER, BLANK, SPACE_END, BLANK_END, APOS1, APOS2, FIRST = 0, 1, 2, 3, 4, 5, 6, 7, 8
#: States: what the open piece is. DONE takes nothing more; PREFIX is a space that joins the next piece; CUT1 and CUT2 owe so many letters of a contraction.
DONE, IN_LETTERS, IN_NUMBERS, IN_OTHERS, IN_BLANKS, PREFIX, CUT1, CUT2 = range(8)
STATES = SYMBOLS = 8

#: White space as the pattern's \s has it, beyond ASCII's.
WIDE_BLANKS = (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
#: What follows an apostrophe in a contraction.
SHORT, LONG = "stmd", ("re", "ve", "ll")


@lru_cache(1)
def automaton() -> tuple[np.ndarray, np.ndarray]:
    """(next state, whether the symbol opens a piece), by state * 16 + symbol."""
    step, opens = np.zeros((STATES, 2 * SYMBOLS), np.uint8), np.ones((STATES, 2 * SYMBOLS), bool)
    fresh_state = {LETTER: IN_LETTERS, NUMBER: IN_NUMBERS, OTHER: IN_OTHERS, BLANK: IN_BLANKS, SPACE_END: PREFIX, BLANK_END: DONE, APOS1: CUT1, APOS2: CUT2}
    stay = {(IN_LETTERS, LETTER): IN_LETTERS, (IN_NUMBERS, NUMBER): IN_NUMBERS, (IN_BLANKS, BLANK): IN_BLANKS, (CUT1, LETTER): DONE, (CUT2, LETTER): CUT1}
    stay |= {(s, x): IN_OTHERS for s in (IN_OTHERS, PREFIX) for x in (OTHER, APOS1, APOS2)} | {(PREFIX, LETTER): IN_LETTERS, (PREFIX, NUMBER): IN_NUMBERS}
    for s in range(STATES):
        for x, state in fresh_state.items():
            step[s, x] = step[s, x + FIRST] = state
            if (s, x) in stay:
                step[s, x], opens[s, x] = stay[s, x], False
    return step.ravel(), opens.ravel()


_classes: list[np.ndarray] = []


def classes() -> np.ndarray:
    """LETTER, NUMBER, BLANK or OTHER for each code point; built a plane at a time, on the driver, whose workers get it by broadcast."""
    if not _classes:
        table = np.full(0x110000, OTHER, np.uint8)
        for low in range(0, 0x110000, 0x10000):
            points = np.arange(low, low + 0x10000, dtype=np.uint32)
            points = points[(points < 0xD800) | (points >= 0xE000)]
            plane = points.astype("<u4").tobytes().decode("utf-32-le")
            for pattern, value in ((r"\p{L}", LETTER), (r"\p{N}", NUMBER)):
                for m in regex.finditer(pattern + "+", plane):
                    table[points[m.start() : m.end()]] = value
        table[[*range(9, 14), 32, *WIDE_BLANKS]] = BLANK
        _classes.append(table)
    return _classes[0]


def symbols(points: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Symbols of texts laid end to end; starts: where each (non-empty) text starts."""
    kind = classes()[points]
    first = np.zeros(len(points), bool)
    first[starts] = True
    last = np.append(first[1:], True)
    out = kind.copy()
    ends_run = (kind == BLANK) & ~last & np.append(kind[1:] != BLANK, False)
    out[ends_run] = np.where(points[ends_run] == 32, SPACE_END, BLANK_END)
    for i in np.flatnonzero(points == 39):
        if not last[i]:
            a = chr(points[i + 1])
            if a in SHORT:
                out[i] = APOS1
            elif not last[i + 1] and a + chr(points[i + 2]) in LONG:
                out[i] = APOS2
    return out + first.astype(np.uint8) * FIRST


def compose(outer: np.ndarray, inner: np.ndarray) -> np.ndarray:
    """outer after inner, for rows of functions from state to state."""
    return np.take_along_axis(outer, inner, axis=1)


def scan(functions: np.ndarray) -> np.ndarray:
    """Inclusive prefix compositions of rows of functions: composition is associative, so log2(rows) doublings do."""
    out, width = functions.copy(), 1
    while width < len(out):
        out[width:] = compose(out[width:], out[:-width].copy())
        width *= 2
    return out


def boundaries(points: np.ndarray, starts: np.ndarray, block: int = 64) -> np.ndarray:
    """Where pieces start, for texts laid end to end.

    Each symbol is a function from state to state. Blocks of symbols are composed side by side, the blocks' functions
    are scanned, and each block, its entry state then known, tells which of its symbols open a piece.
    """
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    step, opens = automaton()
    sym = symbols(points, starts)
    blocks = -(-n // block)
    sym = np.ascontiguousarray(np.concatenate([sym, np.full(blocks * block - n, FIRST, np.uint8)]).reshape(blocks, block).T)
    whole = np.tile(np.arange(STATES, dtype=np.uint8), (blocks, 1))
    for column in sym:
        whole = step[whole * np.uint8(16) + column[:, None]]
    state = np.zeros(blocks, np.uint8)
    state[1:] = scan(whole)[:-1, DONE]
    opened = np.empty((block, blocks), bool)
    for j, column in enumerate(sym):
        key = state * np.uint8(16) + column
        opened[j], state = opens[key], step[key]
    return np.flatnonzero(opened.T.ravel()[:n])


#: Pieces of at most so many bytes are two words of a matrix, the last byte their length; they are merged side by side. Longer ones are merged one by one.
SHORT_PIECE = 15
#: No such pair.
NONE = np.int32(2**31 - 1)


@dataclass
class Tables:
    """A rank file as arrays, which a worker can use as they come."""

    tokens: list[bytes | None]
    byte: np.ndarray  # id of each single byte
    two: np.ndarray  # id of each pair of bytes
    pairs: np.ndarray  # sorted, left id << 32 | right id
    merged: np.ndarray  # the id that each of them makes
    kinds: np.ndarray  # classes of code points

    @classmethod
    def of(cls, ranks: dict[bytes, int]) -> Tables:
        tokens: list[bytes | None] = [None] * (max(ranks.values()) + 1)
        found = []
        for token, i in ranks.items():
            tokens[i] = token
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    found.append((left << 32 | right, i))
        keys, merged = np.array(sorted(found), np.int64).reshape(-1, 2).T
        two = np.full(1 << 16, NONE, np.int32)
        for token, i in ranks.items():
            if len(token) == 2:
                two[token[0] << 8 | token[1]] = i
        return cls(tokens, np.array([ranks[bytes([b])] for b in range(256)], np.int32), two, np.ascontiguousarray(keys), merged.astype(np.int32), classes())

    def pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The id that two neighbours make, NONE where there is none; a place without a token holds -1."""
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where((self.pairs[at] == key) & (right >= 0), self.merged[at], NONE)


def merge_rows(t: Tables, data: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Ids of many short pieces, padded with -1: in each round every piece merges its neighbours of least rank, leftmost first."""
    n, width = data.shape
    column = np.arange(width)
    inside = column < size[:, None]
    ids = np.where(inside, t.byte[data], np.int32(-1))
    rank = np.where(inside[:, 1:], t.two[data[:, :-1].astype(np.int32) << 8 | data[:, 1:]], NONE)
    out, rows = np.full((n, width), -1, np.int32), np.arange(n)
    while len(rows):
        at = rank.argmin(1)
        best = rank[np.arange(len(rows)), at]
        done = best == NONE
        if done.any():
            out[rows[done]] = ids[done]
            go = ~done
            rows, ids, rank, at, best = rows[go], ids[go], rank[go], at[go], best[go]
            if not len(rows):
                break
        each, after = np.arange(len(rows)), column > at[:, None]
        ids = np.where(after, np.column_stack([ids[:, 1:], np.full(len(rows), -1, np.int32)]), ids)
        rank = np.where(after[:, :-1], np.column_stack([rank[:, 1:], np.full(len(rows), NONE)]), rank)
        ids[each, at] = best
        right = np.minimum(at + 1, width - 1)
        last = np.minimum(at, width - 2)
        rank[each, last] = np.where(at + 1 < width, t.pair(best, ids[each, right]), rank[each, last])
        left = np.flatnonzero(at > 0)
        rank[left, at[left] - 1] = t.pair(ids[left, at[left] - 1], best[left])
    return out


def pack_pieces(data: bytes, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Short pieces as two words: their bytes, and their length in the last byte."""
    words = np.ndarray((len(data) + 1,), "<u8", data + bytes(24), strides=(1,))
    bits = lambda n: np.where(n >= 8, ~np.uint64(0), (np.uint64(1) << (n.clip(0, 7) * 8).astype(np.uint64)) - np.uint64(1))
    low = words[start] & bits(size)
    high = np.where(size > 8, words[np.minimum(start + 8, len(data))] & bits(size - 8), np.uint64(0))
    return low, high | size.astype(np.uint64) << np.uint64(56)


def distinct(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of, first place of, index of each row among) the distinct rows; told apart by all their bits."""
    key = mix(low ^ mix(high + np.uint64(1)))
    order = np.argsort(key)
    for order in (order, None):
        if order is None:  # two pieces of one hash
            order = np.lexsort((low, high))
            new = (low[order][1:] != low[order][:-1]) | (high[order][1:] != high[order][:-1])
        else:
            new = key[order][1:] != key[order][:-1]
        new = np.append(np.ones(min(1, len(order)), bool), new)
        first, index = order[new], np.empty(len(order), np.int64)
        index[order] = np.cumsum(new) - 1
        if (low[first][index] == low).all() and (high[first][index] == high).all():
            break
    return key[first], first, index


class Cache:
    """Ids of short pieces that were met, by hash and checked by all bits: about 40 bytes a piece, at most room pieces. A full cache starts again from the tokens themselves."""

    def __init__(self, t: Tables, room: int):
        self.room = room
        own = [(i, b) for i, b in enumerate(t.tokens) if b is not None and len(b) <= SHORT_PIECE]
        size = np.array([len(b) for _, b in own])
        low, high = pack_pieces(b"".join(b for _, b in own), np.cumsum(size) - size, size)
        key = mix(low ^ mix(high + np.uint64(1)))
        order = np.argsort(key)
        self.base = key[order], low[order], high[order], order.astype(np.int64), np.ones(len(order), np.int64)
        self.base_pool = np.array([i for i, _ in own], np.int32)
        self.clear()

    def clear(self) -> None:
        self.key, self.low, self.high, self.start, self.count = self.base
        self.pool, self.used = self.base_pool.copy(), len(self.base_pool)

    def find(self, key: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return at, (self.key[at] == key) & (self.low[at] == low) & (self.high[at] == high)

    def add(self, ids: np.ndarray) -> int:
        """Where ids were put in the pool."""
        at = self.used
        if at + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool[:at], np.empty(max(at, len(ids)), np.int32)])
        self.pool[at : at + len(ids)] = ids
        self.used += len(ids)
        return at

    def insert(self, key: np.ndarray, low: np.ndarray, high: np.ndarray, start: np.ndarray, count: np.ndarray) -> None:
        at = np.searchsorted(self.key, key)
        for name, values in (("key", key), ("low", low), ("high", high), ("start", start), ("count", count)):
            setattr(self, name, np.insert(getattr(self, name), at, values))


class Vocabulary:
    """Merge ranks of byte strings, and a cache of pieces."""

    def __init__(self, ranks: dict[bytes, int] | Tables, room: int = 200_000):
        self.tables = ranks if isinstance(ranks, Tables) else Tables.of(ranks)
        self.tokens = self.tables.tokens
        self.ranks = {b: i for i, b in enumerate(self.tokens) if b is not None}
        self.cache = Cache(self.tables, room)
        self.sizes = np.array([len(b or b"") for b in self.tokens], np.int64)
        digits = [b"%d " % i for i in range(len(self.tokens))]
        self.decimals = np.array(digits).view(np.uint8).reshape(len(digits), -1)
        self.decimal_sizes = np.array([len(d) for d in digits], np.int64)

    @classmethod
    def load(cls, path: str) -> dict[bytes, int]:
        with open(path, "rb") as f:
            return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Ids of a piece: the neighbours of least rank are merged, leftmost first, until no neighbours have a rank."""
        ranks = self.ranks
        if piece in ranks:
            return (ranks[piece],)
        n = len(piece)
        end, after, before = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
        alive = [True] * n
        heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, j, e = heapq.heappop(heap)
            if not alive[i] or after[i] != j or j >= n or end[j] != e:
                continue
            alive[j] = False
            end[i], after[i] = e, after[j]
            if after[i] < n:
                before[after[i]] = i
                if (r := ranks.get(piece[i : end[after[i]]])) is not None:
                    heapq.heappush(heap, (r, i, after[i], end[after[i]]))
            if (h := before[i]) >= 0 and (r := ranks.get(piece[h:e])) is not None:
                heapq.heappush(heap, (r, h, i, e))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = after[i]
        return tuple(out)

    def lookup(self, piece: str) -> tuple[tuple[int, ...], str]:
        """(ids, ids in decimal joined by spaces) of a piece."""
        ids = self.merge(piece.encode())
        return ids, " ".join(map(str, ids))

    def encode_pieces(self, data: bytes, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many for each piece) of the pieces between cuts, of which each distinct one is looked up once."""
        cache, start, size = self.cache, cuts[:-1], np.diff(cuts)
        if len(cache.key) > cache.room:
            cache.clear()
        short = size <= SHORT_PIECE
        low, high = pack_pieces(data, start[short], size[short])
        key, first, index = distinct(low, high)
        low, high = low[first], high[first]
        at, known = cache.find(key, low, high)
        begin, count = cache.start[at], cache.count[at]
        new = np.flatnonzero(~known)
        length = (high[new] >> np.uint64(56)).astype(np.int64)
        for some, width in ((length <= 8, 8), (length > 8, SHORT_PIECE)):
            which = new[some]
            if len(which):
                rows = np.column_stack([low[which], high[which]]).astype("<u8").view(np.uint8).reshape(-1, 16)[:, :width]
                ids = merge_rows(self.tables, rows, length[some])
                count[which] = (ids >= 0).sum(1)
                begin[which] = cache.add(ids[ids >= 0]) + np.cumsum(count[which]) - count[which]
        place = np.empty(len(size), np.int64)
        place[short] = index
        others: dict[bytes, int] = {}
        long_begin, long_count = [], []
        for i in np.flatnonzero(~short):
            piece = data[start[i] : start[i] + size[i]]
            if piece not in others:
                ids = np.array(self.merge(piece), np.int32)
                others[piece] = len(key) + len(others)
                long_begin.append(len(ids))
                long_count.append(ids)
            place[i] = others[piece]
        pool = np.concatenate([cache.pool[: cache.used], *long_count])
        begin = np.append(begin, cache.used + np.cumsum([0, *long_begin], dtype=np.int64)[:-1])
        count = np.append(count, np.array(long_begin, np.int64))
        held = cache.key[np.minimum(np.searchsorted(cache.key, key[new]), len(cache.key) - 1)] == key[new]
        keep = new[~held]  # a piece whose hash another one holds is merged anew each time
        keep = keep[np.argsort(key[keep], kind="stable")]
        keep = keep[np.append(True, key[keep][1:] != key[keep][:-1])[: len(keep)]]
        cache.insert(key[keep], low[keep], high[keep], begin[keep], count[keep])
        counts = count[place]
        ends = np.cumsum(counts)
        return pool[np.repeat(begin[place] - ends + counts, counts) + np.arange(ends[-1] if len(ends) else 0)], counts

    def decimal(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """(ids in decimal, each with a space after it, where each ends)."""
        flat = self.decimals[ids].ravel()
        return flat[flat != 0].tobytes(), np.cumsum(self.decimal_sizes[ids])

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def _cuts(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
    """(the texts end to end, their code points, where pieces start, the first piece of each text and the number of all)."""
    joined = "".join(texts)
    lens = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = np.cumsum(lens) - lens
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    at = boundaries(points, starts[lens > 0])
    return joined, points, at, np.append(np.searchsorted(at, starts), len(at))


def split_texts(texts: list[str]) -> Iterator[list[str]]:
    """The pieces of each text."""
    joined, _, at, first = _cuts(texts)
    cuts = [*at.tolist(), len(joined)]
    pieces = [joined[a:b] for a, b in zip(cuts, cuts[1:])]
    for lo, hi in zip(first.tolist(), first.tolist()[1:]):
        yield pieces[lo:hi]


def encode_texts(vocabulary: Vocabulary, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts, where each text's start, and the number of all)."""
    joined, points, at, first = _cuts(texts)
    data = joined.encode("utf-8", "surrogatepass")
    cuts = np.append(at, len(points))
    if len(data) != len(points):
        widths = 1 + (points > 0x7F).astype(np.uint8) + (points > 0x7FF) + (points > 0xFFFF)
        cuts = np.append(0, np.cumsum(widths, dtype=np.int64))[cuts]
    ids, counts = vocabulary.encode_pieces(data, cuts)
    return ids, np.append(0, np.cumsum(counts))[first]


_vocabularies: dict[str, Vocabulary] = {}

#: Columns that the operator can add, by name.
OUTPUTS = {
    "n_tokens": ("long", pa.int64()), "ids": ("array<int>", pa.list_(pa.int32())), "ends": ("array<int>", pa.list_(pa.int32())),
    "ids_sha256": ("string", pa.string()), "decoded_sha256": ("string", pa.string()),
}


def _encoder(shared, key: str, outputs: tuple[str, ...], chars: int):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabularies.get(key)
        if vocabulary is None:
            tables = shared.value
            if not _classes:
                _classes.append(tables.kinds)
            _vocabularies.clear()
            vocabulary = _vocabularies.setdefault(key, Vocabulary(tables))
        for batch in batches:
            source, lo = batch.column(batch.num_columns - 1), 0
            while lo < batch.num_rows:
                texts, hi, size = [], lo, 0
                while hi < batch.num_rows and (not texts or size < chars):
                    texts.append(source[hi].as_py() or "")
                    size += len(texts[-1])
                    hi += 1
                ids, first = encode_texts(vocabulary, texts)
                spans = list(zip(first.tolist(), first.tolist()[1:]))
                out: dict[str, list] = {k: [] for k in outputs}
                if "n_tokens" in out:
                    out["n_tokens"] = np.diff(first)
                if "ids" in out:
                    out["ids"] = [ids[a:b] for a, b in spans]
                if "ends" in out:
                    out["ends"] = [np.cumsum(vocabulary.sizes[ids[a:b]]) for a, b in spans]
                if "ids_sha256" in out:
                    text, ends = vocabulary.decimal(ids)
                    ends = np.append(0, ends)
                    out["ids_sha256"] = [hashlib.sha256(text[ends[a] : max(ends[a], ends[b] - 1)]).hexdigest() for a, b in spans]
                if "decoded_sha256" in out:
                    out["decoded_sha256"] = [hashlib.sha256(vocabulary.decode(ids[a:b].tolist())).hexdigest() for a, b in spans]
                kept = [c.slice(lo, hi - lo) for c in batch.columns[:-1]]
                yield pa.RecordBatch.from_arrays([*kept, *[pa.array(out[k], OUTPUTS[k][1]) for k in outputs]], names=[*batch.schema.names[:-1], *outputs])
                lo = hi
        release()

    return encode


def encode_documents(docs: DataFrame, vocabulary_path: str, outputs: tuple[str, ...] = ("n_tokens", "ids", "ends"), text_col: str = "text", keep_text: bool = False, chars: int = 1_000_000) -> DataFrame:
    """Adds token columns to each row: n_tokens, ids, ends (byte offset at which each token ends), ids_sha256 (decimal ids joined by one space), decoded_sha256 (bytes that the ids decode to).

    Tokens are those of the rank file under the usual pattern of contractions, letters, numbers, other characters and
    white space, each piece encoded separately, without special tokens. Null and empty texts have no tokens; repeated
    rows are encoded alike; an empty table gives an empty result. docs keeps its columns, but for the text (unless
    keep_text) and for columns named as outputs. The driver reads the rank file (of fixed size) and broadcasts it with
    its table of pairs and the classes of code points; texts are worked on in groups of about chars characters, a longer
    text alone. Nothing is shuffled.
    """
    (text, row) = fresh(docs, "_text", "_row")
    kept = [c for c in docs.columns if c not in outputs and (keep_text or c != text_col)]
    shared = docs.sparkSession.sparkContext.broadcast(Tables.of(Vocabulary.load(vocabulary_path)))
    slim = docs.select(F.struct(*kept).alias(row) if kept else F.lit(0).alias(row), F.col(text_col).alias(text))
    schema = f"{row} {slim.schema[row].dataType.simpleString()}, " + ", ".join(f"{k} {OUTPUTS[k][0]}" for k in outputs)
    out = slim.mapInArrow(_encoder(shared, vocabulary_path, outputs, chars), schema)
    return out.select(*([f"{row}.*"] if kept else []), *outputs)


def decode_documents(encoded: DataFrame, vocabulary_path: str, ids_col: str = "ids", out_col: str = "text") -> DataFrame:
    """Adds out_col (binary): the bytes that the ids decode to.

    Null ids give null, no ids no bytes; an id that the rank file lacks fails the job. Repeated rows are decoded alike, an
    empty table gives an empty result, other columns stay (one named out_col is replaced).
    """
    shared = encoded.sparkSession.sparkContext.broadcast({i: b for b, i in Vocabulary.load(vocabulary_path).items()})

    @F.pandas_udf("binary")
    def decode(ids):
        table = shared.value
        return ids.map(lambda x: None if x is None else b"".join(table[i] for i in x))

    return encoded.withColumn(out_col, decode(ids_col))
