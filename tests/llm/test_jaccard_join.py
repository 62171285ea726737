import collections
import random
import re

import numpy as np
import pytest

from kgloom.llm import jaccard_join as J

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def brute(rows, percent=75, size=5):
    """{row number: (set size, component, links)} by comparing all pairs."""
    sets = []
    for _, text in rows:
        w = WORDS.findall((text or "").translate(LOWER))
        sets.append(frozenset(tuple(w[k : k + size]) for k in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else []))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = collections.Counter()
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                links[i] += 1
                links[j] += 1
                root[max(find(i), find(j))] = min(find(i), find(j))
    groups = collections.defaultdict(list)
    for i, (doc_id, _) in enumerate(rows):
        groups[find(i)].append(doc_id)
    least = {k: min((x for x in v if x is not None), default=None) for k, v in groups.items()}
    return collections.Counter((rows[i][0], len(sets[i]), least[find(i)], links[i]) for i in range(len(rows)))


def near_copies(rng, n, base_words=60, edits=3, vocabulary=400):
    base = [f"w{rng.randrange(vocabulary)}" for _ in range(base_words)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(edits + 1)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def got(df):
    return collections.Counter(tuple(r) for r in df.select("doc_id", "n_shingles", "component_id", "n_links").collect())


def test_word_hashes_tell_words_apart():
    texts = [b"a b a\tB", b"", b"  ab ba ", b"a" * 300 + b" " + b"a" * 301]
    sets = [J.shingle_sets([t], 1)[0] for t in texts]
    assert [len(s) for s in sets] == [2, 0, 2, 2]
    together = J.shingle_sets(texts, 1)
    assert all((a == b).all() for a, b in zip(sets, together))


def test_planes_round_trip():
    ids = np.sort(np.random.default_rng(1).integers(0, 1 << 56, 1000, dtype=np.uint64))
    owner = np.arange(1000) % 65536
    a, b = J.unpack(J.pack(ids, owner))
    assert (a == ids).all() and (b == owner).all()


def test_overlaps_are_exact():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 300, rng.integers(0, 90))) for _ in range(40)]
    want = np.array([[len(np.intersect1d(a, b)) for b in sets] for a in sets])
    got_ = J.overlaps(sets, width=64)
    off = ~np.eye(40, dtype=bool)
    assert (got_[off] == want[off]).all()
    assert (J.overlaps(sets[:10], sets[10:], width=32) == want[:10, 10:]).all()


EDGE = [
    (1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "One  TWO"), (6, "one two three"), (7, "a b c d e"), (7, "a b c d e"),
    (8, "a b c d e f g h i j k l m n o p q r s t"), (9, "a b c d e f g h i j k l m n o p q r s t u"), (10, "a b c d e f g h i j k l m n o p q r s t u v w x y z"),
    (None, "one two"), (None, "quite alone here with six words"), (11, "É é ß 中文 字 字 字"), (12, "x " * 3000), (13, "x " * 2000),
]


def test_edges(spark):
    df = spark.createDataFrame(EDGE, "doc_id long, text string")
    assert got(J.similar_documents(df)) == brute(EDGE)


def test_empty_and_clashing_columns(spark):
    assert J.similar_documents(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    df = spark.createDataFrame([(1, "a b c d e f", "s", 9), (2, "A b c d e f", "s", 9)], "doc_id long, text string, sid string, n int")
    assert [tuple(r) for r in J.similar_documents(df).orderBy("doc_id").collect()] == [(1, 2, 1, 1), (2, 2, 1, 1)]


@pytest.mark.parametrize("limit", [1200, 24])
def test_groups_beyond_the_limit(spark, limit):
    """With a small limit regions go through pivots, cells and tiles."""
    rng = random.Random(limit)
    texts = near_copies(rng, 150) + near_copies(rng, 60, 40, 6) + [t for _ in range(25) for t in near_copies(rng, 2, 30)] + [" ".join(f"w{rng.randrange(50)}" for _ in range(30)) for _ in range(40)]
    shared = near_copies(rng, 1, 55)[0]
    texts += [shared + " " + " ".join(f"y{rng.randrange(10**6)}" for _ in range(rng.choice([5, 12, 18, 200]))) for _ in range(90)]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert got(J.similar_documents(df, limit=limit, block_chars=20_000, shard_bytes=20_000)) == brute(rows)


def test_prefix_of_prefix_chain(spark):
    """Texts that grow word by word link in a chain to one component."""
    rows = [(k, " ".join(f"t{i}" for i in range(12 + k))) for k in range(40)]
    assert got(J.similar_documents(spark.createDataFrame(rows, "doc_id long, text string"), limit=8)) == brute(rows)


def test_regions_are_cut_again(spark, monkeypatch):
    """Several levels of cells, with lent sets, before tiles: links as by comparing all pairs, each counted once."""
    rng = random.Random(9)
    levels, cut = [], J._cut
    monkeypatch.setattr(J, "_cut", lambda *a: levels.append(a[2]) or cut(*a))
    groups = [range(k * 1000, k * 1000 + 100) for k in range(12)]
    sets = [sorted({*rng.sample(g, 97), *rng.sample(range(k * 1000, k * 1000 + 400), 2)}) for k, g in enumerate(groups * 12)]
    sets = [list(x) for x in dict.fromkeys(map(tuple, sets))]
    rows = [(b"all", b"%04d" % i, len(x), 1 + i % 3, x) for i, x in enumerate(sets)]
    regions = spark.createDataFrame(rows, "region binary, sid binary, n int, copies long, ids array<long>")
    want = collections.Counter()
    for i, x in enumerate(sets):
        for j, y in enumerate(sets):
            if i != j and 100 * len({*x} & {*y}) >= 92 * len({*x} | {*y}):
                want[b"%04d" % i] += 1 + j % 3
    found = collections.Counter()
    for r in J.join_regions(regions, 92, limit=10, pivots=4).collect():
        found[bytes(r.sid)] += r.links
    assert found == want and len(want) > 30 and max(levels) >= 1


def templated(rng, docs, pool):
    """Documents of 8 paragraphs out of a pool, and some near copies of these."""
    paragraphs = [" ".join(f"p{i}w{rng.randrange(10**6)}" for _ in range(20)) for i in range(pool)]
    texts = [rng.sample(paragraphs, 8) for _ in range(docs)]
    texts += [[*x[:7], x[7] + f" end{i}"] for i, x in enumerate(rng.sample(texts, docs // 20))]
    return [" ".join(x) for x in texts]


def test_templated_texts_are_not_compared_all_with_all(spark, monkeypatch):
    """Documents that share paragraphs without linking are one region that pivots don't part: split by shingle, the pairs compared grow with the corpus where the pool of paragraphs grows with it."""
    stored, pairs = J.stored, []

    def noted(df, label, *rest):
        out = stored(df, label, *rest)
        if label == "shingle-regions":
            pairs.append(sum(r["count"] ** 2 / 2 for r in out.groupBy("region").count().collect()))
        return out

    monkeypatch.setattr(J, "stored", noted)
    compared = []
    for docs, pool in ((500, 75), (1000, 150)):
        rows = list(enumerate(templated(random.Random(docs), docs, pool)))
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
        pairs.clear()
        found = got(J.similar_documents(df, limit=100, block_chars=100_000, shard_bytes=200_000))
        if docs == 500:
            assert found == brute(rows)
        assert sum(count for (*_, links), count in found.items() if links) >= docs // 10  # the near copies and their originals
        compared.append(sum(pairs))
    print("pairs compared:", compared)
    assert 0 < compared[0] < 500**2 / 4 and compared[1] < 2.5 * compared[0], compared
