import random

import pytest

from kgloom.llm import decontamination as D


def distances(pattern, text):
    """Least edits to a substring that ends at each place, by the plain recurrence."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[j - 1] + 1))
        row = new
    return row[1:]


def brute(text, items, rate):
    out = {}
    for item_id, item in items:
        if item_id is None or not item or not text:
            continue
        p, t = D.normal(item), D.normal(text)
        d, end = min((d, i + 1) for i, d in enumerate(distances(p, t)))
        if d <= D.budget(len(p), rate) and (d, end) < out.get(item_id, (d, end + 1)):
            out[item_id] = d, end
    return [(i, *out[i]) for i in sorted(out)]


def test_myers_is_the_recurrence():
    rng = random.Random(10)
    for _ in range(500):
        p, t = ("".join(rng.choice("abc") for _ in range(rng.randint(1, 90))) for _ in range(2))
        masks = {}
        for i, c in enumerate(p):
            masks[c] = masks.get(c, 0) | 1 << i
        assert D.myers(masks, len(p), t) == distances(p, t)


@pytest.mark.parametrize("block", [2_000_000, 50])
def test_operator(spark, block):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 7)))
    items = [(i, " ".join(word() for _ in range(12))) for i in range(8)] + [(None, "no id"), (20, None), (21, ""), (3, "another text of three"), (0, None)]

    def changed(t, n):
        t = list(t)
        for _ in range(n):
            k = rng.randrange(len(t))
            t[k : k + 1] = rng.choice([[], ["z"], [t[k], "y"]])
        return "".join(t)

    texts = [None, "", "clean " * 50] + [" ".join(word() for _ in range(rng.randint(0, 40))) + " " + changed(items[k % 8][1], k % 9).upper() + "\n" + word() for k in range(40)] + ["another\ttext OF three", "x" * 50_000 + items[1][1]]
    rows = [(i, t, "s") for i, t in enumerate(texts)] + [(3, texts[3], "s"), (None, texts[3], None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, leaks string")
    got = D.find_leaks(docs, spark.createDataFrame(items, "item_id long, text string"), 0.1, block_chars=block).collect()
    assert len(got) == len(rows)
    for r in got:
        assert [tuple(x) for x in r.leaks] == brute(r.text, items, 0.1)
    assert sum(bool(r.leaks) for r in got) > 15


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "abc")], "doc_id long, text string"), spark.createDataFrame([(1, "abc")], "item_id long, text string")
    assert D.find_leaks(docs, items.limit(0)).first().leaks == [] and D.find_leaks(docs.limit(0), items).collect() == []
    assert D.find_leaks(docs, items, keep_text=False).columns == ["doc_id", "leaks"]


@pytest.mark.parametrize("block", [2_000_000, 10])
def test_items_without_id_are_found(spark, block):
    items = spark.createDataFrame([(None, "how many angels dance here"), (4, "upon the head of a pin"), (None, "how many angels dance there")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x how many angels dance there upon the head of a pin"), (2, "how many devils")], "doc_id long, text string")
    got = {r.doc_id: [tuple(x) for x in r.leaks] for r in D.find_leaks(docs, items, 0.08, block_chars=block).collect()}
    assert got == {1: [(None, 0, 29), (4, 0, 52)], 2: []}
