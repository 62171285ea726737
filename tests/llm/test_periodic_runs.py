import hashlib
import random
import zlib

import numpy as np

from kgloom.llm import periodic_runs
from kgloom.llm.queries import QUERIES


def brute(words, min_length, min_exponent):
    """All maximal stretches of equal words at each distance; of one stretch the smallest period counts."""
    n, seen, out = len(words), set(), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j > i:
                length = j - i + q
                if length >= 2 * q and (i, length) not in seen:
                    seen.add((i, length))
                    if length >= max(min_length, min_exponent * q):
                        out.append((i, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return b" ".join(w for i, w in enumerate(words) if i not in gone)


def repeated(words, a, p):
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def texts_of(rnd):
    for _ in range(rnd.choice([1, 4, 7])):
        words = [b"%d" % rnd.randrange(rnd.choice([1, 2, 3, 9])) for _ in range(rnd.choice([0, 1, 2, 6, 15, 50, 110]))]
        if len(words) > 6 and rnd.random() < 0.5:
            a = rnd.randrange(len(words))
            words = repeated(words, a, 1 + rnd.randrange(max(1, (len(words) - a) // 2)))
        yield words + [b"x"] + words + words if rnd.random() < 0.4 else words


def test_random_texts():
    rnd = random.Random(3)
    for _ in range(700):
        texts, least, exponent = list(texts_of(rnd)), rnd.choice([1, 2, 6, 24]), rnd.choice([2, 3, 4])
        found = periodic_runs.runs_of_texts(texts, least, exponent)
        assert found == [brute(w, least, exponent) for w in texts]
        assert [periodic_runs.collapse(w, r) for w, r in zip(texts, found)] == [collapsed(w, r) for w, r in zip(texts, found)]


def test_the_steps():
    words = np.array([ord(c) for c in "aabaabaabaxaabaab"], np.int64)
    names = periodic_runs.Names(words)
    names.grow()
    order = np.empty(names.n, np.int64)
    order[names.levels[-1][:-1]] = np.arange(names.n)
    text = "aabaabaabaxaabaab"
    assert order.tolist() == sorted(range(len(text)), key=lambda i: text[i:])
    factor = periodic_runs.previous_factors(names, order)
    assert factor.tolist() == [max([next((n for n in range(len(text) - i, 0, -1) if text[i : i + n] == text[j : j + n]), 0) for j in range(i)], default=0) for i in range(len(text))]
    first, period, rolls = periodic_runs.covering_squares(names, order, np.array([0]), np.array([len(text)]))
    visited = {(s + r, k) for s, k, n in zip(first.tolist(), period.tolist(), rolls.tolist()) for r in range(n + 1)}
    squares = {text[i : i + 2 * k] for k in range(1, 9) for i in range(len(text) - 2 * k + 1) if text[i : i + k] == text[i + k : i + 2 * k]}
    prime = {s for s in squares if not any(s[: len(s) // 2] == s[:d] * (len(s) // 2 // d) for d in range(1, len(s) // 2) if (len(s) // 2) % d == 0)}
    assert {text[s : s + 2 * k] for s, k in visited} == prime


def test_one_very_long_text():
    found = periodic_runs.runs_of_texts([[b"a"] * 100_000, [b"a", b"b", b"c"] * 30_000 + [b"d"]], 24, 3)
    assert found == [[(0, 100_000, 1)], [(0, 90_000, 3)]]


def test_operator(spark):
    rows = [(1, None, "k"), (2, "", "k"), (3, "\t\n ", "k"), (4, "a b\x1cc " * 9 + "a", None), (4, "a b\x1cc " * 9 + "a", None), (None, "la\xa0la " * 40, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs string")
    out = periodic_runs.find_runs(df, min_length=10)
    assert out.columns == ["doc_id", "runs", "collapsed"]
    want = [(r[0], brute((r[1] or "").encode().split(), 10, 3), collapsed((r[1] or "").encode().split(), brute((r[1] or "").encode().split(), 10, 3)).decode()) for r in rows]
    assert sorted((str(r.doc_id), [tuple(x) for x in r.runs], r.collapsed) for r in out.collect()) == sorted((str(a), b, c) for a, b, c in want)
    assert periodic_runs.find_runs(df.limit(0)).collect() == []


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in QUERIES["op13_periodic_runs"](spark, sf).collect()}
    for d in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        words, h = (d.text or "").encode().split(), zlib.crc32(str(d.doc_id).encode())
        if h % 10 == 0 and words:
            a = h // 10 % len(words)
            words = repeated(words, a, 1 + (len(words) - a) // (3 + h // 10 % 8))
        runs = brute(words, 24, 3) if len(words) < 1500 else periodic_runs.runs_of_texts([words], 24, 3)[0]
        best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
        r = got[d.doc_id]
        assert r.n_runs == len(runs) and (r.start, r.length, r.period) == (best or (None,) * 3)
        assert r.exponent_milli == (1000 * best[1] // best[2] if best else None)
        assert r.runs_sha256 == hashlib.sha256("".join("%d,%d,%d\n" % x for x in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(collapsed(words, runs)).hexdigest()
