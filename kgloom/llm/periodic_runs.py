"""Periodic runs of words by the linear tandem-repeat method of Gusfield and Stoye, over many texts at a time.

The words of a block of texts are one sequence, each text with its own word numbers, so nothing matches across texts.
Names of all substrings of 2^j words (as far as any repeats) serve as its suffix tree: a locus of depth d is a pair of
names that overlap, the names of the last level order the leaves, a suffix link leads from position s to s + 1.

1. A text's LZ blocks are cut by longest previous factors. By the theorem of Main, the leftmost occurrence of any square
   has its centre in a block and crosses one of its ends; forward and backward extensions from the ends give a set of
   squares that covers all the leftmost ones.
2. From each of them a walk along suffix links goes on while the square rolls to the right by a word; what it visits is
   the vocabulary: every primitive square that occurs, once.
3. The leaves below a vocabulary locus are all its occurrences. Neighbouring starts of one period merge into runs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgloom.llm.common import fresh, release


class Names:
    """levels[j][i] tells substrings of 2^j words apart by their start i; the last level tells all positions apart and orders them as suffixes."""

    def __init__(self, words: np.ndarray):
        self.n = len(words)
        order = np.argsort(words, kind="stable")
        self.active = np.arange(self.n)
        self.levels = [self._named(words[order], order, np.zeros(self.n, np.int32), np.zeros(self.n, np.int32))]

    def _named(self, key: np.ndarray, at: np.ndarray, base: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Names (how many positions are less, within those of one name before) of the positions at, sorted by key; positions named alone are active no more."""
        new = np.append(True, key[1:] != key[:-1])[: len(key)]
        head = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
        group = np.append(True, base[1:] != base[:-1])[: len(base)]
        group_head = np.maximum.accumulate(np.where(group, np.arange(len(base)), 0))
        out = before.copy()
        out[at] = base + head - group_head
        alone = new & np.append(new[1:], True)[: len(new)]
        self.active = at[~alone]
        return np.append(out, np.int32(-1))

    def grow(self, levels: int | None = None) -> None:
        """Doubles the length until so many levels are there, or no two positions share a name."""
        while len(self.active) and (levels is None or len(self.levels) < levels):
            last, step, at = self.levels[-1], 1 << (len(self.levels) - 1), self.active
            key = last[at].astype(np.int64) * (self.n + 2) + last[np.minimum(at + step, self.n)] + 1
            order = np.argsort(key, kind="stable")
            self.levels.append(self._named(key[order], at[order], last[at[order]], last[:-1]))

    def narrowed(self, keep: np.ndarray) -> Names:
        """Of some of the texts only."""
        out, place = object.__new__(Names), np.cumsum(keep) - 1
        out.n, out.active = int(keep.sum()), place[self.active]
        out.levels = []
        for level in self.levels:
            # how many of the positions kept are less, so that names stay starts of groups
            order = np.argsort(level[:-1][keep], kind="stable")
            ranked = level[:-1][keep][order]
            head = np.maximum.accumulate(np.where(np.append(True, ranked[1:] != ranked[:-1])[: len(ranked)], np.arange(len(ranked)), 0))
            names = np.empty(out.n, np.int32)
            names[order] = head
            out.levels.append(np.append(names, np.int32(-1)))
        return out

    def forward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words agree from i and from j on; i differs from j."""
        i, j = i.copy(), j.copy()
        start = i.copy()
        for level in range(len(self.levels) - 1, -1, -1):
            step = (self.levels[level][i] == self.levels[level][j]).astype(np.int64) << level
            i, j = i + step, j + step
        return i - start

    def backward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words agree up to i and up to j, both included; -1 is before the first word."""
        i, j, start = i + 1, j + 1, i + 1
        for level in range(len(self.levels) - 1, -1, -1):
            a, b = i - (1 << level), j - (1 << level)
            names = self.levels[level]
            step = ((a >= 0) & (b >= 0) & (names[np.maximum(a, 0)] == names[np.maximum(b, 0)])).astype(np.int64) << level
            i, j = i - step, j - step
        return start - i

    def locus(self, start: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(level, name of the first part, name of the last part) of substrings, which these three and the depth tell apart."""
        level = np.minimum(np.log2(depth).astype(np.int64), len(self.levels) - 1)
        flat = self._flat()
        return level, flat[level, start], flat[level, start + depth - (np.int64(1) << level)]

    def _flat(self) -> np.ndarray:
        if not hasattr(self, "_all"):
            self._all = np.stack(self.levels)
        return self._all


def ranges(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which range, number) for each of the numbers first, first + 1, ... of each range."""
    which = np.repeat(np.arange(len(count)), count)
    return which, first[which] + np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)


def previous_factors(names: Names, order: np.ndarray) -> np.ndarray:
    """For each position the longest factor that also starts before it: with one of the next lesser positions among its neighbours in suffix order."""
    less_before, less_after, stack = [-1] * names.n, [-1] * names.n, []
    for at in order.tolist():
        while stack and stack[-1] > at:
            less_after[stack.pop()] = at
        if stack:
            less_before[at] = stack[-1]
        stack.append(at)
    out, here = np.zeros(names.n, np.int64), np.arange(names.n)
    for other in (np.array(less_before, np.int64), np.array(less_after, np.int64)):
        some = other >= 0
        out[some] = np.maximum(out[some], names.forward(here[some], other[some]))
    return out


def lz_blocks(factor: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """(start, end, end of the next one or the own, end of the text) of the blocks of all texts."""
    at, lengths, out = None, np.maximum(factor, 1).tolist(), []
    for start, end in zip(starts.tolist(), ends.tolist()):
        at, cuts = start, []
        while at < end:
            cuts.append(at)
            at += lengths[at]
        cuts.append(end)
        out += [(a, b, cuts[min(i + 2, len(cuts) - 1)], end) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    return tuple(np.array(out, np.int64).reshape(-1, 4).T)


@lru_cache(1)
def _sieve(size: int) -> np.ndarray:
    out = np.arange(size, dtype=np.int64)
    for p in range(2, int(size**0.5) + 1):
        if out[p] == p:
            some = out[p * p :: p]
            some[some == np.arange(p * p, size, p)] = p
    return out


def primitive(names: Names, start: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Whether a square's root is no power: it has no period that divides its length."""
    ok = np.ones(len(start), bool)
    least, rest = _sieve(1 << int(period.max(initial=1)).bit_length()), period.copy()
    while (rest > 1).any():
        at = np.flatnonzero(rest > 1)
        factor = least[rest[at]]
        part = period[at] // factor
        ok[at] &= names.forward(start[at], start[at] + part) < period[at] - part
        rest[at] //= factor
    return ok


def covering_squares(names: Names, order: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, period, how far it rolls to the right) of primitive squares among which is one that rolls over the leftmost occurrence of each square."""
    h, h1, h2, end = lz_blocks(previous_factors(names, order), starts, ends)
    inner = h1 < end
    a, k = ranges(np.ones(len(h), np.int64), np.where(inner, h1 - h, 0))  # across a block's end
    b, m = ranges(np.ones(len(h), np.int64), np.minimum(h2 - h, end - h - 1))  # across its start
    x, period = np.concatenate([h1[a] - k, h[b]]), np.concatenate([k, m])
    ahead, behind = names.forward(x, x + period), names.backward(x - 1, x + period - 1)
    some = (ahead > 0) & (ahead + behind >= period)
    first, period, rolls = (x - behind)[some], period[some], (ahead + behind - period)[some]
    _, once = np.unique(first * (names.n + 1) + period, return_index=True)
    first, period, rolls = first[once], period[once], rolls[once]
    ok = primitive(names, first, period)
    return first[ok], period[ok], rolls[ok]


def occurrences(names: Names, order: np.ndarray, start: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, period) of all occurrences of the squares given: the leaves below their loci."""
    rank = names.levels[-1]
    level, head, tail = names.locus(start, 2 * period)
    flat, shift = names._flat(), 2 * period - (np.int64(1) << level)

    def inside(r: np.ndarray) -> np.ndarray:
        at = order[r]
        return (flat[level, at] == head) & (flat[level, np.minimum(at + shift, names.n)] == tail)

    bounds = []
    for sign, limit in ((-1, np.zeros(len(start), np.int64)), (1, np.full(len(start), names.n - 1, np.int64))):
        near, far = rank[start].astype(np.int64), limit.copy()
        while (near != far).any():
            middle = far - (far - near) // 2 if sign > 0 else far + (near - far) // 2
            fits = inside(middle)
            near, far = np.where(fits, middle, near), np.where(fits, far, middle - sign)
        bounds.append(near)
    low, high = bounds
    _, once = np.unique(low * (names.n + 1) + period, return_index=True)
    which, at = ranges(low[once], (high - low + 1)[once])
    return order[at], period[once][which]


def runs_of(words: np.ndarray, starts: np.ndarray, ends: np.ndarray, min_length: int, min_exponent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of the runs of all texts, by start, then period.

    A run of length L >= max(min_length, min_exponent * q) repeats L - q words at distance q, so a text in whose suffix
    tree no inner node is that deep has none; the tree of the others is then grown to its full depth.
    """
    none = (np.zeros(0, np.int64),) * 3
    if not len(words):
        return none
    shared = -(-min_length * (min_exponent - 1) // min_exponent)
    names = Names(words)
    names.grow(max(shared, 1).bit_length())
    text = np.repeat(np.arange(len(starts)), ends - starts)
    deep = np.zeros(len(starts), bool)
    deep[text[names.active]] = True
    if not deep.any():
        return none
    keep = deep[text]
    place, names = np.flatnonzero(keep), names.narrowed(keep)
    names.grow()
    sizes = (ends - starts)[deep]
    starts = np.cumsum(sizes) - sizes
    order = np.empty(names.n, np.int64)
    order[names.levels[-1][:-1]] = np.arange(names.n)
    first, period, rolls = covering_squares(names, order, starts, starts + sizes)
    if not len(first):
        return none
    which, visited = ranges(first, rolls + 1)  # the walks
    start, period = occurrences(names, order, visited, period[which])
    by = np.lexsort((start, period))
    start, period = start[by], period[by]
    new = np.append(True, (period[1:] != period[:-1]) | (start[1:] != start[:-1] + 1))
    last = np.append(new[1:], True)
    begin, period, length = start[new], period[new], start[last] - start[new] + 2 * period[new]
    long_enough = length >= np.maximum(min_length, min_exponent * period)
    begin, period, length = place[begin[long_enough]], period[long_enough], length[long_enough]
    by = np.lexsort((period, begin))
    return begin[by], length[by], period[by]


def runs_of_texts(texts: list[list[bytes]], min_length: int, min_exponent: int) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of the runs of each text, given as its words."""
    numbers, used = [], 0
    for words in texts:
        known: dict[bytes, int] = {}
        numbers += [known.setdefault(w, used + len(known)) for w in words]
        used += len(known)
    sizes = np.array([len(w) for w in texts], np.int64)
    ends = np.cumsum(sizes)
    begin, length, period = runs_of(np.array(numbers, np.int64), ends - sizes, ends, min_length, min_exponent)
    out: list[list] = [[] for _ in texts]
    for t, s, n, q in zip(np.searchsorted(ends, begin, "right").tolist(), begin.tolist(), length.tolist(), period.tolist()):
        out[t].append((s - int(ends[t] - sizes[t]), n, q))
    return out


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words left when each run keeps its first period only, joined by a space."""
    if not runs:
        return b" ".join(words)
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()])


RUN = "array<struct<start:long,length:long,period:long>>"
_RUN = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _finder(min_length: int, min_exponent: int, room: int):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            source, lo = batch.column(batch.num_columns - 1), 0
            while lo < batch.num_rows:
                texts, hi, size = [], lo, 0
                while hi < batch.num_rows and (not texts or size < room):
                    texts.append((source[hi].as_py() or "").encode().split())  # bytes split at ASCII blanks alone
                    size += len(texts[-1])
                    hi += 1
                found = runs_of_texts(texts, min_length, min_exponent)
                columns = [pa.array([[{"start": s, "length": n, "period": q} for s, n, q in r] for r in found], _RUN)]
                columns.append(pa.array([collapse(w, r).decode() for w, r in zip(texts, found)], pa.string()))
                yield pa.RecordBatch.from_arrays([*(c.slice(lo, hi - lo) for c in batch.columns[:-1]), *columns], names=[*batch.schema.names[:-1], "runs", "collapsed"])
                lo = hi
        release()

    return find


def find_runs(docs: DataFrame, min_length: int = 24, min_exponent: int = 3, text_col: str = "text", room: int = 150_000) -> DataFrame:
    """Adds runs (array of start, length, period in words, by start, then period) and collapsed (the text's words joined by a space, each run cut to its first period) to each row.

    A run is a stretch of words with smallest period q, of max(min_length, min_exponent * q) words or more (min_exponent
    at least 2), that no neighbouring word extends with this period. Words are parted by ASCII white space and compared
    byte by byte. Null and empty texts have no runs and an empty collapsed text; repeated rows get equal results; an empty
    table gives an empty result. docs keeps its columns, text_col left out; columns named as outputs are replaced.

    Nothing is shuffled: texts are worked on in groups of about room words, a longer text alone, at some 200 bytes a word
    of the texts that repeat anything as long as a run has to.
    """
    if min_exponent < 2:
        raise ValueError("a run has two periods at least")
    outputs = ("runs", "collapsed")
    text, row = fresh(docs, "_text", "_row")
    kept = [c for c in docs.columns if c not in outputs and c != text_col]
    slim = docs.select(F.struct(*kept).alias(row) if kept else F.lit(0).alias(row), F.col(text_col).alias(text))
    out = slim.mapInArrow(_finder(min_length, min_exponent, room), f"{row} {slim.schema[row].dataType.simpleString()}, runs {RUN}, collapsed string")
    return out.select(*([f"{row}.*"] if kept else []), *outputs)
