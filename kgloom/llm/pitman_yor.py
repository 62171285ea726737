"""Pitman-Yor restaurants: seating of customers that all ate known dishes, and a hierarchy over bytes in contexts of two, one and no bytes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: The byte that ends a word, and that stands before its first; a word never holds it. Bytes 9 to 13 never occur either.
END, SYMBOLS = 0x20, 256 - 5
#: So many customers of a dish are seated one by one.
ONE_BY_ONE = 16


def seat(customers: np.ndarray, discount, strength: np.ndarray, rng: np.random.Generator, own: np.ndarray | float = 0.0) -> np.ndarray:
    """Tables that the customers of each dish take when they are seated anew, one after the other.

    strength: for each dish (concentration + discount * tables of other dishes) * the parent's probability of the dish;
    own: what each of the dish's own tables adds to that, discount * the probability. With i customers at t tables the
    next opens a table with probability s / (i - d * t + s), s = strength + own * t, and sits down at one of the t
    otherwise. Beyond ONE_BY_ONE customers they come in parties of a twentieth of those that sit, with the chance at the
    party's middle: a dish of a billion customers takes some hundred steps, however many its tables.
    """
    c = np.asarray(customers, np.int64)
    d = np.broadcast_to(np.asarray(discount, float), c.shape)
    tables = (c > 0).astype(np.int64)
    s0, each = np.maximum(np.asarray(strength, float), 1e-300), np.broadcast_to(np.asarray(own, float), c.shape)
    i, on = 1, np.flatnonzero(c > 1)
    while len(on):
        s = s0[on] + each[on] * tables[on]
        if i < ONE_BY_ONE:
            party = 1
            tables[on] += rng.random(len(on)) < s / (i - d[on] * tables[on] + s)
        else:
            party = max(1, i // 20)
            come = np.minimum(party, c[on] - i)
            tables[on] += rng.binomial(come, s / (i + (come - 1) / 2 - d[on] * tables[on] + s))
        i += party
        on = on[c[on] > i]
    return tables


def discount_of(counts: np.ndarray, weights: np.ndarray | None = None) -> float:
    """From how many dishes have one and two customers, as absolute discounting has it; within 0.05 and 0.95."""
    w = np.ones(len(counts)) if weights is None else weights
    one, two = float(w[counts == 1].sum()), float(w[counts == 2].sum())
    return min(0.95, max(0.05, one / (one + 2 * two))) if one else 0.05


@dataclass
class Spelling:
    """Predictive probabilities of the next byte: own[code] + share[context] * below[context's last byte, byte].

    codes: sorted, first byte << 16 | second << 8 | next; there are at most 2**24 of them, which bounds the model.
    """

    codes: np.ndarray
    own: np.ndarray
    share: np.ndarray
    below: np.ndarray

    def log10(self, codes: np.ndarray) -> np.ndarray:
        """From a table of the contexts that were met, and of last bytes for those that weren't; made where it is first asked for."""
        if not hasattr(self, "_row"):
            met, at = np.unique(self.codes >> 8, return_inverse=True)
            p = self.share[met][:, None] * self.below[met & 255]
            p[at, self.codes & 255] += self.own
            self._row = (len(met) + (np.arange(1 << 16) & 255)).astype(np.int32)
            self._row[met] = np.arange(len(met))
            rest = np.log10(np.maximum(self.below, 1e-300))
            self._logs = np.concatenate([np.log10(p), rest]).ravel()
        return self._logs[self._row[codes >> 8] << 8 | codes & 255]


def sample_spelling(codes: np.ndarray, counts: np.ndarray, sweeps: int = 4, concentration: float = 1.0, seed: int = 1) -> Spelling:
    """Gibbs sweeps over the seatings of three levels of restaurants, then the predictive probabilities of the last.

    Customers of a restaurant whose context is two bytes are the counts; each of its tables is a customer of the
    restaurant of the last byte alone, which all contexts that end in this byte share; its tables in turn are customers
    of the restaurant without context, whose parent is uniform. A sweep seats every dish of a level anew, given the
    tables of the others as the sweep found them.
    """
    rng = np.random.default_rng(seed)
    order = np.argsort(codes)
    codes, counts = codes[order].astype(np.int64), counts[order].astype(np.int64)
    context, pair = codes >> 8, codes & 0xFFFF
    uniform = 1.0 / SYMBOLS
    t2 = np.ones(len(codes), np.int64)
    c1 = np.bincount(pair, t2, 1 << 16)
    t1 = (c1 > 0).astype(np.int64)
    c0 = t1.reshape(256, 256).sum(0)
    t0 = (c0 > 0).astype(np.int64)
    d2, th = discount_of(counts), concentration
    d1, d0 = discount_of(c1[c1 > 0]), discount_of(c0[c0 > 0])

    def below() -> tuple[np.ndarray, np.ndarray]:
        p0 = (np.maximum(c0 - d0 * t0, 0) + (th + d0 * t0.sum()) * uniform) / (th + c0.sum())
        rows_c, rows_t = c1.reshape(256, 256), t1.reshape(256, 256)
        p1 = (np.maximum(rows_c - d1 * rows_t, 0) + (th + d1 * rows_t.sum(1, keepdims=True)) * p0[None, :]) / (th + rows_c.sum(1, keepdims=True))
        return p0, p1

    for _ in range(sweeps):
        p0, p1 = below()
        whole = np.bincount(context, t2, 1 << 16)[context]
        t2 = seat(counts, d2, (th + d2 * (whole - t2)) * p1[pair >> 8, pair & 255], rng, d2 * p1[pair >> 8, pair & 255])
        c1 = np.bincount(pair, t2, 1 << 16).astype(np.int64)
        whole = t1.reshape(256, 256).sum(1).repeat(256)
        t1 = seat(c1, d1, (th + d1 * (whole - t1)) * np.tile(p0, 256), rng, d1 * np.tile(p0, 256))
        c0 = t1.reshape(256, 256).sum(0)
        t0 = seat(c0, d0, (th + d0 * (t0.sum() - t0)) * uniform, rng, d0 * uniform)
    _, p1 = below()
    total = np.bincount(context, counts, 1 << 16)
    share = (th + d2 * np.bincount(context, t2, 1 << 16)) / (th + total)
    return Spelling(codes, (counts - d2 * t2) / (th + total[context]), share, p1)


def word_codes(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(codes, where each word's start): for each byte of a word, and its end, the two bytes before and the byte itself."""
    joined = np.frombuffer(b"  " + b"   ".join(words) + b" ", np.uint8).astype(np.int32)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 3
    starts = np.cumsum(size) - size
    own = np.ones(len(joined), bool)
    own[starts] = own[starts + 1] = False
    return ((joined[:-2] << 16) | (joined[1:-1] << 8) | joined[2:])[own[2:]], starts - 2 * np.arange(len(words))


def code_counts(codes: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct codes, sums of their weights), by the bytes that occur, which are few."""
    there = np.zeros(256, bool)
    there[codes & 255] = there[(codes >> 8) & 255] = there[codes >> 16] = True
    symbols = np.flatnonzero(there)
    k = len(symbols)
    if k**3 > 1 << 22:
        found, place = np.unique(codes, return_inverse=True)
        return found, np.bincount(place, weights, len(found)).astype(np.int64)
    number = np.zeros(256, np.int32)
    number[symbols] = np.arange(k)
    dense = (number[codes >> 16] * k + number[(codes >> 8) & 255]) * k + number[codes & 255]
    met = np.flatnonzero(np.bincount(dense, minlength=1))
    sums = np.bincount(dense, weights, minlength=1)[met]
    return symbols[met // (k * k)] << 16 | symbols[met // k % k] << 8 | symbols[met % k], sums.astype(np.int64)
