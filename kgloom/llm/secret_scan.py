"""Secret scan: known forms by pattern, and long tokens that a battery of randomness tests can't tell from random ones."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgloom.llm.common import fresh, stored

#: Order of the kinds where spans start together.
KINDS = ("assign", "access", "hex", "random")

_either = lambda word: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)
_names = "|".join((*map(_either, ("password", "passwd", "secret", "token")), _either("api") + "_?" + _either("key")))
ASSIGN = re.compile(rf"""(?:{_names})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LONG_HEX = re.compile(r"[0-9a-f]{16}")
MARK = re.compile(r"[:=]")

#: Alphabets by which a token's encoding is inferred, narrowest first; a token is tested against the first that holds it.
ENCODINGS = {
    "decimal": "0123456789",
    "hex": "0123456789abcdef",
    "HEX": "0123456789ABCDEF",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "BASE36": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "base36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "base62": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
}
_SETS = {k: frozenset(v) for k, v in ENCODINGS.items()}
_RANKS = {k: {c: i for i, c in enumerate(v)} for k, v in ENCODINGS.items()}
TOKEN = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")

#: Battery p values are counted in so many bins for the control of false discoveries.
BINS = 200
#: A corpus' ordinary tokens pass up to so many times as often as those of the model: their words are not quite drawn letter by letter.
MARGIN = 2.0
#: Ordinary tokens drawn for each encoding and length class, from words drawn by the corpus' letter pairs.
ORDINARY, WORDS = 4000, 3000


def infer_encoding(token: str) -> str | None:
    """The narrowest alphabet that holds the token; it must show letters and digits, or letters of both cases, or it is words or a number."""
    body = token.rstrip("=")
    chars = frozenset(body)
    for name, alphabet in _SETS.items():
        if chars <= alphabet:
            both_cases = body != body.lower() and body != body.upper()
            if name != "decimal" and not both_cases and (not chars & _SETS["decimal"] or not chars - _SETS["decimal"]):
                return None
            return name
    return None


_erfc = np.frompyfunc(math.erfc, 1, 1)


def _normal_tail(z: np.ndarray) -> np.ndarray:
    return 0.5 * _erfc(np.asarray(z, float) / math.sqrt(2)).astype(float)


@lru_cache(None)
def parts_of(encoding: str) -> np.ndarray:
    """The part of each symbol of an alphabet: frequent and other letters of each case, 0 to 2 and other digits, marks. Text and numbers fill them unevenly even where they are too short to show it symbol by symbol."""
    names = ["".join(c) for c in ("etaoinsr", "bcdfghjklmpquvwxyz", "ETAOINSR", "BCDFGHJKLMPQUVWXYZ", "012", "3456789", "+/-_")]
    which = [next(i for i, n in enumerate(names) if c in n) for c in ENCODINGS[encoding]]
    return np.unique(which, return_inverse=True)[1]


def chi_squared_p(x: np.ndarray, parts: np.ndarray) -> np.ndarray:
    """For each row: upper tail of the statistic of uniformity over parts of the alphabet (each symbol's number), a gamma law by its exact mean and variance for this length, by the cube root."""
    rows, n = x.shape
    q = np.bincount(parts) / len(parts)
    g = len(q)
    if g < 2:
        return np.ones(rows)
    counts = np.bincount((parts[x] + g * np.arange(rows)[:, None]).ravel(), minlength=rows * g).reshape(rows, g).astype(float)
    stat = (counts**2 / (n * q)).sum(1) - n
    mean, var = g - 1.0, 2.0 * (g - 1) + ((1 / q).sum() - g * g - 2 * g + 2) / n
    shape = mean * mean / var
    return _normal_tail(((np.maximum(stat, 0) / mean) ** (1 / 3) - (1 - 1 / (9 * shape))) * math.sqrt(9 * shape))


def runs_p(x: np.ndarray, k: int) -> np.ndarray:
    """For each row: two-sided runs test above and below the middle of the alphabet, given how many lie on each side."""
    up, n = x * 2 >= k, x.shape[1]
    a = up.sum(1)
    b = n - a
    runs = 1 + (up[:, 1:] != up[:, :-1]).sum(1)
    mean = 2 * a * b / n + 1
    var = np.maximum(1e-9, (mean - 1) * (mean - 2) / (n - 1))
    p = np.minimum(1.0, 2 * _normal_tail(np.maximum(0.0, np.abs(runs - mean) - 0.5) / np.sqrt(var)))
    return np.where((a == 0) | (b == 0), 2.0 ** (1 - n), p)


def serial_p(x: np.ndarray, k: int) -> np.ndarray:
    """For each row: two-sided test of the correlation of neighbours, with its mean and variance under random order."""
    n = x.shape[1]
    y = x - x.mean(1, keepdims=True)
    total = (y * y).sum(1)
    r = (y[:, 1:] * y[:, :-1]).sum(1) / np.maximum(total, 1e-300)
    p = np.minimum(1.0, 2 * _normal_tail(np.abs(r + 1 / n) * math.sqrt(n * n / (n - 2))))
    return np.where(total == 0, 0.0, p)


def least_p(x: np.ndarray, encoding: str) -> np.ndarray:
    """The least of the tests' p values, for each row: uniformity over the alphabet's symbols and over its parts, runs, serial correlation."""
    k = len(ENCODINGS[encoding])
    tests = chi_squared_p(x, np.arange(k)), chi_squared_p(x, parts_of(encoding)), runs_p(x, k), serial_p(x, k)
    return np.minimum.reduce(tests)


#: Random tokens drawn for the law of the least p value; beyond LONGEST symbols it hardly changes any more.
DRAWS, LONGEST = 2000, 400


@lru_cache(None)
def null_law(encoding: str, n: int) -> np.ndarray:
    """Sorted least p values of random tokens of n symbols; always of the same draws."""
    k = len(ENCODINGS[encoding])
    rng = np.random.default_rng([k, n])
    return np.sort(np.concatenate([least_p(rng.integers(0, k, (100, n)), encoding) for _ in range(DRAWS // 100)]))


def battery(token: str, encoding: str) -> float:
    """p of the hypothesis that the token is random over its encoding: where its least p value lies in the law of random tokens' of this length, so uniform for these; among equal ones the token's hash decides."""
    rank = _RANKS[encoding]
    x = np.array([[rank[c] for c in token.rstrip("=")]])
    law = null_law(encoding, min(x.shape[1], LONGEST))
    low, high = np.searchsorted(law, [least_p(x, encoding)[0] * f for f in (1 - 1e-12, 1 + 1e-12)])
    return float((low + (high - low + 1) * (xxhash.xxh3_64_intdigest(token) / 2**64)) / (DRAWS + 1))


def length_class(n: int) -> int:
    """Tests gain power with length, so tokens are judged among those of like length: 20-22, 23-26, 27-30, 31-34, ..."""
    return int(math.log(n / 20) / math.log(1.15))


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the known forms, leftmost and without overlap in each kind, in code points."""
    out = []
    if MARK.search(text):
        out += [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 12]
    if "AKIA" in text:
        out += [(m.start(), "access", m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    if LONG_HEX.search(text):
        out += [(m.start(), "hex", m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= 16]
    return out


FOUND = "array<struct<kind:string,start:int,end:int,encoding:string,size:int,bin:int>>"
_ITEM = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("encoding", pa.string()), ("size", pa.int32()), ("bin", pa.int32())])
#: Letters a-z as 1 to 26, case aside, all other bytes as 0.
_LETTER = np.zeros(256, np.int64)
_LETTER[97:123] = _LETTER[65:91] = np.arange(1, 27)


def letter_pairs(text: str) -> np.ndarray:
    """How often each letter (0: none) comes after each, by 27 * first + second."""
    x = _LETTER[np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)]
    return np.bincount(x[:-1] * 27 + x[1:], minlength=729)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of each row, and at the end of a partition a row with its letter pairs."""
    pairs, kinds, names = np.zeros(729, np.int64), None, None
    for batch in batches:
        found = []
        for text in batch.column(batch.num_columns - 1):
            text = text.as_py() or ""
            pairs += letter_pairs(text)
            spans = [{"kind": k, "start": s, "end": e} for s, k, e in base_spans(text)]
            for m in TOKEN.finditer(text):
                if encoding := infer_encoding(m[0]):
                    p = battery(m[0], encoding)
                    spans.append({"kind": "random", "start": m.start(), "end": m.end(), "encoding": encoding, "size": length_class(len(m[0])), "bin": min(BINS - 1, int(p * BINS))})
            found.append(spans)
        kinds, names = [c.type for c in batch.columns[:-1]], [*batch.schema.names[:-1], "found", "pairs"]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.list_(_ITEM)), pa.nulls(len(found), pa.list_(pa.int64()))], names=names)
    if names:
        yield pa.RecordBatch.from_arrays([*[pa.nulls(1, k) for k in kinds], pa.nulls(1, pa.list_(_ITEM)), pa.array([pairs], pa.list_(pa.int64()))], names=names)


def drawn_words(pairs: np.ndarray, letters: str, rng: np.random.Generator) -> list[str]:
    """Words of some letters, drawn letter by letter from the pairs; of two letters at least."""
    allowed = np.array([ord(c) - 96 for c in letters])
    table = pairs.reshape(27, 27) + 0.05
    step = np.cumsum(table[:, [0, *allowed]], axis=1)
    step /= step[:, -1:]
    state, out = np.zeros(WORDS, np.int64), np.zeros((WORDS, 12), np.int64)
    alive = np.ones(WORDS, bool)
    for j in range(out.shape[1]):
        u = rng.random(WORDS)
        if j < 2:  # a word goes on
            first = step[state, 0]
            u = first + u * (1 - first)
        pick = (u[:, None] > step[state]).sum(1)
        alive &= pick > 0
        state = np.where(alive, allowed[np.maximum(pick - 1, 0)], 0)
        out[:, j] = state
    return ["".join(chr(96 + c) for c in row if c) for row in out.tolist()]


#: How ordinary tokens mix words and numbers: the chance of a number after a word, and after a number.
STYLES = {"mixed": (0.35, 0.2), "alternating": (0.95, 0.05), "words": (0.12, 0.0), "terms": (0.6, 0.05)}


def ordinary_tokens(encoding: str, n: int, pairs: np.ndarray, style: str, count: int = ORDINARY) -> list[str]:
    """Tokens of n characters as identifiers, file names, paths, numbers and time stamps have them, over words drawn from the corpus' letter pairs; always of the same draws."""
    rng = np.random.default_rng([n, *encoding.encode(), *style.encode()])
    alphabet = _SETS[encoding]
    letters = "".join(c for c in "abcdefghijklmnopqrstuvwxyz" if c in alphabet or c.upper() in alphabet)
    if style == "terms":  # technical words have rare letters oftener than prose
        pairs = np.sqrt(pairs) if len(letters) > 6 else pairs
    words = drawn_words(pairs, letters, rng) if letters else []
    marks = [c for c in "+/-_" if c in alphabet]
    counts = [f"{rng.integers(10 ** int(rng.integers(1, 5)))}" for _ in range(120)] + ["00", "000", "0001", "100"]
    years, stamps = [f"{y}" for y in range(1990, 2035)] * 2, []
    if style != "alternating":
        stamps = [f"20{rng.integers(30):02d}{rng.integers(1, 13):02d}{rng.integers(1, 29):02d}" for _ in range(20)] + [f"{rng.integers(24):02d}{rng.integers(60):02d}{rng.integers(60):02d}" for _ in range(20)]
    numbers = [x for x in (*counts, *years, *stamps) if set(x) <= alphabet] or ["2", "3"]
    case = {"HEX": str.upper, "base32": str.upper, "BASE36": str.upper, "base62": str.capitalize, "base64": str.capitalize, "base64url": str.capitalize}.get(encoding, str)
    out: list[str] = []
    for _ in range(20):
        for row in rng.random((count, n, 4)).tolist():
            token, size, number = [], 0, True
            for a, b, c, d in row:
                number = not words or a < STYLES[style][number]
                if number:
                    part = numbers[int(b * len(numbers))]
                else:
                    part = case(words[int(b * len(words))])
                    part = part[0].lower() + part[1:] if case is str.capitalize and c < 0.4 else part
                if marks and size and d < 0.4:
                    part = marks[int(d / 0.4 * len(marks))] + part
                token.append(part)
                size += len(part)
                if size >= n:
                    break
            made = "".join(token)[:n]
            if infer_encoding(made) == encoding:
                out.append(made)
                if len(out) == count:
                    return out
    return out


def ordinary_tail(encoding: str, size: int, pairs: np.ndarray) -> np.ndarray:
    """By bin the chance that an ordinary token of this encoding and length class has a battery p of this bin or more, never 0: the greatest of all styles, MARGIN times where they are made of words, for the class' shortest tokens, which pass most easily."""
    n = next(n for n in range(20, 1 << 30) if length_class(n) >= size)
    rank, out = _RANKS[encoding], np.zeros(BINS)
    law = null_law(encoding, min(n, LONGEST))
    for style in STYLES:
        tokens = ordinary_tokens(encoding, n, pairs, style)
        if tokens:
            least = least_p(np.array([[rank[c] for c in t] for t in tokens]), encoding)
            bins = np.minimum(BINS - 1, (np.searchsorted(law, least, "right") / (DRAWS + 1) * BINS).astype(int))
            out = np.maximum(out, (1 + np.cumsum(np.bincount(bins, minlength=BINS)[::-1])[::-1]) / (len(tokens) + 1))
    margin = MARGIN if len(rank) > 16 else 1.0  # digits and a-f make no words
    return np.where(out > 0, np.minimum(1.0, margin * out), 1.0)


@lru_cache(1)
def _mixture(pairs: bytes, count: int = 3 * ORDINARY) -> dict[str, float]:
    """The share of ordinary tokens that each encoding has among those that are tested, at most one draw too many: words and numbers in one case or both, with and without marks, one in fifty of digits alone."""
    table, rng = np.frombuffer(pairs, float), np.random.default_rng(count)
    words = drawn_words(table, "abcdefghijklmnopqrstuvwxyz", rng)
    found: dict[str, int] = {}
    for row in rng.random((count, 40)).tolist():
        style, mark, case = list(STYLES.values())[int(row[0] * len(STYLES))], ("", "", "_", "-", "/", "+")[int(row[1] * 6)], (str.lower, str.upper, str.capitalize)[int(row[2] * 3)]
        token, digits = "", row[3] < 0.02
        for a, b in zip(row[4::2], row[5::2]):
            number = digits or a < style[0]
            token += (mark if token and not digits else "") + (f"{int(b * 10_000)}" if number else case(words[int(b * len(words))]))
            if len(token) >= 28:
                break
        if encoding := infer_encoding(token):
            found[encoding] = found.get(encoding, 0) + 1
    total = sum(found.values())
    return {e: (1 + found.get(e, 0)) / (total + 1) for e in ENCODINGS}


def ordinary_shares(pairs: np.ndarray) -> dict[str, float]:
    return _mixture(np.asarray(pairs, float).tobytes())


def thresholds(counts: dict[tuple[str, int], np.ndarray], tails: dict[tuple[str, int], np.ndarray], q: float, shares: dict[str, float] | None = None) -> dict[tuple[str, int], int]:
    """The least bin from which tokens count as random, for each encoding and length class that has any.

    counts: tokens by bin; tails: the chance that an ordinary token reaches a bin; shares: of all ordinary tokens those of
    an encoding (1 where it isn't given). Of a stratum's m tokens m * tail are expected beyond a bin if all are ordinary,
    against those that are there: Benjamini and Hochberg's rule at q, which holds for one token as for a million. Strata
    of ordinary tokens would add up, though. So strata are selected, by the same rule over their least such ratio
    (Simes), and cut at q times the share selected (Benjamini and Bogomolov); for this a stratum's ordinary tokens are no
    more than its encoding's share of all tokens, so that an encoding that text hardly ever falls into is not held back by
    the many strata of others.
    """
    whole, false, likely = sum(h.sum() for h in counts.values()), {}, {}
    for key, hist in counts.items():
        above = np.cumsum(hist[::-1])[::-1]
        tail = np.where(above > 0, tails[key] / np.maximum(above, 1), np.inf)
        false[key] = hist.sum() * tail
        likely[key] = min(hist.sum(), whole * (shares or {}).get(key[0], 1.0)) * tail
    ranked = sorted(x.min() for x in likely.values())
    passing = [i for i, x in enumerate(ranked, 1) if x <= q * i / len(ranked)]
    level = q * passing[-1] / len(ranked) if passing else 0.0
    good = {key: np.flatnonzero((false[key] <= q) & (likely[key] <= level)) for key in counts}
    return {key: int(bins[0]) for key, bins in good.items() if len(bins)}


def span_list(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed, joined by commas."""
    order = F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))])
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), order[s["kind"]].alias("order"), s["end"].alias("end"), s["kind"].alias("kind")))
    return F.array_join(F.transform(F.array_sort(keyed), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan_secrets(docs: DataFrame, fdr: float = 0.05, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Adds secrets to each row: array<struct<kind, start, end>>, spans in code points with exclusive ends, sorted by start and kind.

    Kinds assign, access and hex are fixed forms (base_spans). Kind random are tokens of 20 or more characters whose
    inferred encoding they fill like random draws: chi-squared uniformity of the alphabet, a runs test and a serial
    correlation test, of which the least p value is set against its law for random tokens of that length. How often
    ordinary tokens of the encoding and length class get there is told by a model of them over the corpus' own letter
    pairs (ordinary_tokens); tokens are reported where at most a share fdr of them is expected to be ordinary, by
    encoding and length class (thresholds), whatever the size of the corpus. Tokens without both letters and digits, or
    letters of both cases (unless all digits), are not tested.

    Null and empty texts have no spans; repeated rows are scanned alike; an empty table gives an empty result. Other
    columns stay (one named secrets is replaced). Texts are read once; what is stored between the two passes is the ids
    and the spans; the driver sees one histogram of BINS counts for each encoding and length class, and 729 counts of
    letter pairs.
    """
    row, text = fresh(docs, "_row", "_text")
    kept = [c for c in docs.columns if c not in (text_col, "secrets")]
    slim = docs.select(F.struct(*kept).alias(row) if kept else F.lit(None).cast("string").alias(row), F.col(text_col).alias(text))
    whole = stored(slim.mapInArrow(_scan, f"{row} {slim.schema[row].dataType.simpleString()}, found {FOUND}, pairs array<long>"), "secret-spans")
    scanned = whole.where("pairs is null")
    tested = scanned.select(F.explode("found").alias("s")).where("s.kind = 'random'").select("s.*")
    counts: dict[tuple[str, int], np.ndarray] = {}
    for encoding, size, b, n in tested.groupBy("encoding", "size", "bin").count().collect():
        counts.setdefault((encoding, size), np.zeros(BINS))[b] = n
    pairs = np.zeros(729)
    if counts:
        for pair, n in whole.select(F.posexplode("pairs").alias("pair", "n")).groupBy("pair").agg(F.sum("n")).collect():
            pairs[pair] = n
    cut = thresholds(counts, {key: ordinary_tail(*key, pairs) for key in counts}, fdr, ordinary_shares(pairs)) if counts else {}
    passing = lambda s: F.coalesce(s["bin"] >= F.create_map(*[x for (e, n), t in cut.items() for x in (F.lit(f"{e}:{n}"), F.lit(t))])[F.concat_ws(":", s["encoding"], s["size"].cast("string"))], F.lit(False)) if cut else F.lit(False)
    spans = F.filter("found", lambda s: (s["kind"] != "random") | passing(s))
    plain = F.transform(spans, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return scanned.select(f"{row}.*" if kept else F.lit(None).alias(row), plain.alias("secrets"))
