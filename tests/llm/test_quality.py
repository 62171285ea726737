import numpy as np

from kgloom.llm import quality as Q


def test_logistic_regression_finds_the_direction():
    rng = np.random.default_rng(13)
    x = rng.standard_normal((2000, 3))
    y = (rng.random(2000) < 1 / (1 + np.exp(-(2 * x[:, 0] - x[:, 1] + 0.5)))).astype(float)
    w, centre, scale = Q.fit_logistic(x, y)
    assert np.allclose(w / np.append(scale, 1), [2, -1, 0, 0.5], atol=0.35)


def test_concentration_by_moments():
    assert Q.concentration(0.0, 100.0) == 10_000 and Q.concentration(None, None) == 10_000 and Q.concentration(50.0, 100.0) == 1.0
    assert abs(Q.concentration(10.0, 100.0) - 9) < 1e-9


GOOD, BAD = "A calm sentence with many different words of prose number {}. It ends here.", "BUY!! BUY!! BUY!! BUY!! $$$ {} BUY!! BUY!! BUY!!"


def rows():
    out = []
    for i in range(400):
        host = "clean" if i % 2 else "spam"
        bad = i % 20 == 1 if i % 2 else i % 10 != 0
        out.append((i, (BAD if bad else GOOD).format(i), host, "en", int(not bad)))
    return out


def test_operator(spark):
    data = rows()
    odd = [(900, None, "spam", "en"), (901, "", "clean", "en"), (902, GOOD.format(1), None, None), (903, "!" * 100_000, "spam", "en"), (None, GOOD.format(2), "clean", "en"), (5, GOOD.format(5), "clean", "en"), (904, None, "new", "fr")]
    docs = spark.createDataFrame([r[:4] for r in data] + odd, "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(r[0], r[4]) for r in data if r[0] % 3] + [(None, 1), (2, None), (1, 1)], "doc_id long, quality int")
    got = Q.score_quality(docs, labels, max_labelled=150).collect()
    assert len(got) == len(data) + len(odd) and all(0 < r.quality < 1 and r.keep == (r.quality >= 0.5) for r in got)
    by = {r.doc_id: r for r in got}
    truth = {r[0]: r[4] for r in data}
    assert np.mean([by[i].keep == bool(t) for i, t in truth.items() if i != 1]) > 0.97
    assert by[900].evidence == 0 and by[900].prior < by[904].prior < by[901].prior  # a site without rows of its own stands by the corpus
    assert by[902].keep and not by[903].keep


def test_priors_leave_the_row_itself_out(spark):
    docs = spark.createDataFrame([(1, "a", "h1", "en"), (2, "b", "h2", "en"), (3, "c", "h3", "en")], "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1)], "doc_id long, quality int")
    got = {r.doc_id: r.prior for r in Q.score_quality(docs, labels).collect()}
    assert max(got.values()) - min(got.values()) < 1e-3


def test_without_labels_and_empty(spark):
    docs = spark.createDataFrame([(1, "a", "h", "en")], "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert [(r.evidence, round(r.prior, 6)) for r in Q.score_quality(docs, labels).collect()] == [(0.0, 0.5)]
    assert Q.score_quality(docs.limit(0), labels).collect() == []
