import collections
import math
import re

import numpy as np
from pyspark.sql import functions as F

from kgloom.llm import lm_scoring as M
from kgloom.llm import pitman_yor as Y

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def test_seats_follow_the_restaurant():
    """Mean tables of the samplers against one customer after the other."""
    rng = np.random.default_rng(12)
    for c, d, s in ((2, 0.5, 0.3), (40, 0.5, 0.8), (400, 0.3, 5.0)):
        plain = []
        for _ in range(600):
            t = 1
            for i in range(1, c):
                t += rng.random() < s / (i - d * t + s)
            plain.append(t)
        fast = Y.seat(np.full(3000, c), d, np.full(3000, s), rng)
        assert abs(fast.mean() - np.mean(plain)) < 0.12 * np.mean(plain) and fast.min() >= 1 and fast.max() <= c
    assert Y.seat(np.array([0, 1, 10**12]), 0.5, np.array([1.0, 1.0, 2.0]), rng)[:2].tolist() == [0, 1]


def test_many_tables_take_few_steps():
    rng = np.random.default_rng(3)
    plain = []
    for _ in range(60):
        t = 1
        for i in range(1, 3000):
            s = 150.0 + 0.02 * t
            t += rng.random() < s / (i - 0.6 * t + s)
        plain.append(t)
    fast = Y.seat(np.full(500, 3000), 0.6, np.full(500, 150.0), rng, np.full(500, 0.02))
    assert abs(fast.mean() / np.mean(plain) - 1) < 0.02 and 0.5 < fast.std() / np.std(plain) < 2


def test_codes_of_words():
    words = [b"the", b"", b"a"]
    codes, starts = Y.word_codes(words)
    assert starts.tolist() == [0, 4, 5] and [int(c).to_bytes(3, "big") for c in codes] == [b"  t", b" th", b"the", b"he ", b"   ", b"  a", b" a "]
    for some in (codes, np.random.default_rng(1).integers(0, 1 << 24, 5000)):
        found, n = Y.code_counts(some, np.arange(len(some)) % 7)
        want = collections.Counter()
        for c, w in zip(some.tolist(), (np.arange(len(some)) % 7).tolist()):
            want[c] += w
        assert dict(zip(found.tolist(), n.tolist())) == dict(want) and (np.diff(found) > 0).all()


def test_spelling_is_a_distribution():
    words = [b"the", b"then", b"a", b"ant", b"tea", "été".encode()] * 3
    codes, _ = Y.word_codes(words)
    seen, counts = np.unique(codes, return_counts=True)
    s = Y.sample_spelling(seen, counts)
    symbols = np.array([b for b in range(256) if b not in range(9, 14)])
    for context in (b"  ", b" t", b"th", b"zz"):
        p = 10 ** s.log10((context[0] << 16) + (context[1] << 8) + symbols)
        assert abs(p.sum() - 1) < 1e-9 and (p > 0).all()


ROWS = [(i, f"The cat {i % 4} sat on the mat\nand {'rare' + str(i)} ran") for i in range(40)] + [(100, None), (101, ""), (102, " \t "), (3, "The cat sat"), (None, "the unseen zebra"), (103, "é É 字 " * 3000), (104, "w" * 600 + " " + "w" * 601)]


def test_operator(spark):
    df = spark.createDataFrame([(i, t, "w", 1) for i, t in ROWS], "id long, text string, words string, shard int")
    held = F.col("id") % 7 == 2
    got = M.score_documents(df, held, id_col="id", block_chars=300, shard_bytes=500).collect()
    tokens = [WORDS.findall((t or "").translate(LOWER)) + [None] for _, t in ROWS]
    count = collections.Counter(w for (i, _), ts in zip(ROWS, tokens) if not (i is not None and i % 7 == 2) for w in ts)
    n, v = sum(count.values()), len(count)
    want = collections.Counter()
    for (i, _), ts in zip(ROWS, tokens):
        want[(i, i is not None and i % 7 == 2, len(ts), sum(count[w] > 0 for w in ts), n, round(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in ts), 6))] += 1
    assert collections.Counter((r.id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 and math.isclose(r.perplexity, 10 ** (-r.score / r.n_tokens)) for r in got)


def test_nothing_learnt_and_empty(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    got = sorted(M.score_documents(df, F.lit(True)).collect())
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got] == [(3, 0, 0, 0.0), (1, 0, 0, 0.0)] and all(r.score <= 0 for r in got)
    assert M.score_documents(df.limit(0), F.lit(False)).collect() == []


def test_better_than_the_base_on_held_out_texts(spark, sf):
    from kgloom.llm.queries import QUERIES

    held = [r for r in QUERIES["op5_lm_scoring"](spark, sf).collect() if r.held_out]
    assert sum(r.score for r in held) > 0.9 * sum(r.base_score for r in held)


def test_order_and_spelling_count(spark):
    """A text and its words shuffled differ, and so do a plausible new word and line noise."""
    learnt = [(i, "the cat sat on the mat and the dog ran to the barn") for i in range(30)]
    asked = [(100, "the cat sat on the mat"), (101, "mat the on sat cat the"), (102, "the canter"), (103, "the q#7~Zx")]
    df = spark.createDataFrame(learnt + asked, "doc_id long, text string")
    got = {r.doc_id: r for r in M.score_documents(df, F.col("doc_id") >= 100, block_chars=200, shard_bytes=200).collect()}
    assert len(got) == 34 and got[100].base_score == got[101].base_score and got[102].base_score == got[103].base_score
    assert got[100].score > got[101].score + 3 and got[102].open_score > got[103].open_score + 1


def test_next_words_are_a_distribution():
    """What a context gives to learnt words, and leaves to others, sums to one in the mean of the samples."""
    d, th, n, size = 0.5, 1.0, 8, 2
    words, c, t, spelt = b" \na\nb", np.array([3, 4, 1]), np.array([2, 1, 1]), np.array([0.125, 0.25, 0.25])
    mass, customers = 10.0 + d * t.sum(), 10.0 + c.sum()
    known = M._row(M.WORD, 0, c, t, (M.floats(c - d * t) + M.floats(spelt)) * size, n, words=words, n=M.planes(c))
    many, seats = np.array([5, 2]), [np.array([2, 1]), np.array([3, 2])]
    ask = {"kind": M.PLACE, "shard": 0, "block": 1, "learnt": M.planes(np.array([1, 1, 1, 0])), "words": b"zq", "ranks": M.steps(np.arange(3))}
    spelling = Y.sample_spelling(np.zeros(0, np.int64), np.zeros(0, np.int64))
    one = collections.namedtuple("Shared", "value")(spelling)
    levels = [(mass, customers, 0.375)] * size

    def score(*places):
        """Of a text of the block's words (0 is the end); 1 was met before 0 and before 1, other pairs have no customers."""
        texts, learnt = [np.array([*places, 0])], np.array([True, True, True, False])
        _, asked, _ = M._learnt_pairs(texts, learnt)
        every = sorted({(1, 0), (1, 1), *((int(x) // 4, int(x) % 4) for x in asked)})
        n_of, t_of = dict(zip([(1, 0), (1, 1)], many)), dict(zip([(1, 0), (1, 1)], sum(seats)))
        met = np.unique([y for _, y in every])
        pairs = M._row(M.PAIR, 0, np.array([n_of.get(x, 0) for x in every]), np.zeros(len(every)), M.planes(np.array([t_of.get(x, 0) for x in every])), 7, runs=M.planes(np.bincount([x for x, _ in every], minlength=3)), met=M.steps(met), follow=M.planes(np.searchsorted(met, [y for _, y in every])), seats=M.planes(np.array([0, 3, 0, 0, 5, 0])))
        row = ask | {"places": M.steps(np.array([every.index((int(x) // 4, int(x) % 4)) for x in asked]))}
        answer = M._answer([one] * size, levels)(M.pa.Table.from_pylist([pairs, row], M._PAIRS), M.pa.Table.from_pylist([known], M._WORDS))
        doc = {"id": 1, "held_out": False, "places": M.planes(texts[0])}
        return M._score_block(n, 3, levels, d, th)(M.pa.Table.from_pylist([doc]), answer).to_pylist()[0]["score"]

    p = [*np.log10((c - d * t + mass * spelt) / customers), math.log10(mass / customers * 0.375)]
    end_after = [None] + [score(x) - p[x] for x in (1, 2, 3)]  # other contexts than 1 have no customers, so p alone counts
    after = [end_after[1]] + [score(1, x) - p[1] - end_after[x] for x in (1, 2, 3)]
    assert math.isclose(sum(10**x for x in after), 1, abs_tol=1e-5) and after[0] > p[0] and after[1] - p[1] > after[2] - p[2] + 0.1
    assert math.isclose(after[2] - p[2], after[3] - p[3], abs_tol=1e-5)  # what was not met is left to the parent alike
    assert math.isclose(sum(10**x for x in p), 1) and math.isclose(score(), p[0], abs_tol=1e-6)


def test_against_a_plain_sampler(spark):
    """Mean log probabilities of held-out texts near those of a sampler that takes out and seats one customer at a time, over the same base."""
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(12)]
    chain = rng.dirichlet(np.full(12, 0.3), size=12)

    def text(n):
        out = [int(rng.integers(12))]
        while len(out) < n:
            out.append(int(rng.choice(12, p=chain[out[-1]])))
        return " ".join(words[i] for i in out)

    rows = [(i, text(20)) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.score for r in M.score_documents(df, F.col("doc_id") >= 50, burn_in=3, samples=6).collect()}
    lines = [[12, *(words.index(w) for w in t.split()), 12] for _, t in rows]
    learnt, size = lines[:50], 13
    pairs = collections.Counter((a, b) for x in learnt for a, b in zip(x, x[1:]))
    d = Y.discount_of(np.array(list(pairs.values())))
    base, th1, th0 = np.full(size, 0.9 / size), 1.0, 10.0  # words of like spelling have like probabilities, some is left to others
    seated = {p: [] for p in pairs}  # customers of each table
    top = [[] for _ in range(size)]

    def p0(w):
        total, tables = sum(map(sum, top)), sum(map(len, top))
        return (sum(top[w]) - d * len(top[w]) + (th0 + d * tables) * base[w]) / (th0 + total)

    def open_top(w):
        total = sum(map(len, top))
        weights = [k - d for k in top[w]] + [(th0 + d * total) * base[w]]
        at = rng.choice(len(weights), p=np.array(weights) / sum(weights))
        top[w].append(1) if at == len(top[w]) else top[w].__setitem__(at, top[w][at] + 1)

    def leave(tables):
        at = rng.choice(len(tables), p=np.array(tables) / sum(tables))
        tables[at] -= 1
        if not tables[at]:
            tables.pop(at)
            return True
        return False

    def sit(a, b):
        tables = seated[a, b]
        open_ = (th1 + d * sum(len(seated[x, y]) for x, y in seated if x == a)) * p0(b)
        weights = [k - d for k in tables] + [open_]
        at = rng.choice(len(weights), p=np.array(weights) / sum(weights))
        if at == len(tables):
            tables.append(1)
            open_top(b)
        else:
            tables[at] += 1

    customers = [p for p, n in pairs.items() for _ in range(n)]
    for p in customers:
        sit(*p)
    want = np.zeros(10)
    for _ in range(3):
        for a, b in customers:
            if leave(seated[a, b]):
                leave(top[b])
            sit(a, b)
    whole = collections.Counter(a for a, _ in customers)
    tables = collections.Counter()
    for (a, _), x in seated.items():
        tables[a] += len(x)
    for k, line in enumerate(lines[50:]):
        want[k] = sum(math.log10((max(0, pairs[a, b] - d * len(seated.get((a, b), []))) + (th1 + d * tables[a]) * p0(b)) / (th1 + whole[a])) for a, b in zip(line, line[1:]))
    mine = np.array([got[i] for i in range(50, 60)])
    assert abs(mine.sum() / want.sum() - 1) < 0.05 and np.corrcoef(mine, want)[0, 1] > 0.9
