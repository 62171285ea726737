import numpy as np
import pytest

from kgloom.llm import language_id as L
from kgloom.llm.queries import QUERIES


def test_gradients_are_those_of_the_loss():
    net = L.Network.initial(["a", "b", "c"], 3, 9, 0)
    for k in net.names:
        setattr(net, k, getattr(net, k).astype(np.float64))
    rows = np.random.default_rng(0).integers(0, 256, (5, 9)).astype(np.uint8)
    rows[2, 6:] = 0
    target = np.array([0, 1, 2, 1, 0])
    _, grads = net.gradients(rows, target)
    for k in net.names:
        a = getattr(net, k)
        for _ in range(3):
            at = np.unravel_index(np.abs(grads[k]).argmax(), a.shape)
            old = a[at]
            loss = []
            for step in (1e-3, -1e-3):
                a[at] = old + step
                loss.append(net.gradients(rows, target)[0])
            a[at] = old
            assert abs((loss[0] - loss[1]) / 2e-3 - grads[k][at]) < 1e-5
            grads[k][at] = 0


def test_pooling_covers_the_whole_text():
    net = L.Network.initial(["a", "b"], 4, 16, 1)
    long = "abc é" * 50
    p = net.pooled([long, "abc é"])
    rows = L.windows(long.encode(), 16)
    each = net.probabilities(rows) * (rows.T != 0)[..., None]
    assert np.allclose(p[0], each.sum((0, 1)) / each.sum()) and np.allclose(p.sum(1), 1)


def test_operator(spark):
    words = {"x": "qua zuk xor ", "y": "lee mia nol "}
    rows = [(i, words["xy"[i % 2]] * (i % 7 + 3), "xy"[i % 2], "s") for i in range(60)]
    rows += [(100, None, "x", "s"), (101, "", "y", "s"), (102, "12 34 !!", "x", "s"), (103, "lee mia nol " * 4000, None, "s"), (None, "qua zuk", None, None), (1, rows[1][1], "y", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    net = L.fit(df, per_language=20, chars=60, hidden=6, length=16, steps=60)
    assert net.languages == ["x", "y"]
    out = L.label_documents(df, net, chars=500)
    assert out.columns == ["doc_id", "text", "lang", "lang_pred", "score"]
    for r in out.collect():
        if r.doc_id in (100, 101, 102):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        else:
            assert r.lang_pred == ("x" if "zuk" in r.text else "y") and 0.5 < r.score <= 1
    none = L.fit(df.where("lang is null"))
    assert none is None and {r.lang_pred for r in L.label_documents(df, none).collect()} == {"und"}
    assert L.label_documents(df.limit(0), net).collect() == []
    assert all(len(t) <= 60 for _, t in L.labelled_sample(df, 5, 60)) and len(L.labelled_sample(df, 5, 60)) == 10


@pytest.mark.slow
def test_held_out_accuracy(spark, sf):
    got = QUERIES["op4_language_id"](spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang_pred == r.lang for r in got]) > 0.95
