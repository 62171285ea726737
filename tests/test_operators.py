import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kgloom.operators import funnel, kg, knn, match, metrics, state
from kgloom.operators.judge import ClientJudge, ExpressionJudge, ReplayJudge, backend
from kgloom.plans import fixtures, templates
from kgloom.sources import readers, sinks
from kgloom.streaming.ingest import chunk_stream

T = "head string, relation string, tail string"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_matching_splits_the_generated(spark):
    gen = spark.createDataFrame([("a_b", "r", "c"), ("a b", "r", "c"), ("A b", "r", "c"), ("x", "r", "y")], T)
    graph = spark.createDataFrame([("a b", "r", "c"), ("a b", "r", "c")], T)
    assert rows(match.matched(gen, graph)) == [("a b", "r", "c")] * 2
    assert match.matched(gen, graph).count() + match.unmatched(gen, graph).count() == gen.count()
    assert match.flagged(gen, graph).where("matched").count() == 2


def test_ends_are_pooled(spark):
    gen = spark.createDataFrame([("h", "r", "t")], T)
    near = spark.createDataFrame([("h", "A"), ("t", "B")], "query string, candidate string")
    graph = spark.createDataFrame([("B", "s", "A"), ("A", "s", "A"), ("A", "s", "z"), ("A", "s", "z"), ("y", "s", "z")], T)
    assert [r[3:] for r in rows(match.similar_triples(gen, near, graph))] == [("A", "s", "A"), ("B", "s", "A")]
    assert [r[3:] for r in rows(match.similar_triples(gen, near, graph, "lenient"))] == [("A", "s", "A"), ("A", "s", "z"), ("A", "s", "z"), ("B", "s", "A")]
    with pytest.raises(ValueError):
        match.similar_triples(gen, near, graph, "loose")


def test_funnel_stages_narrow(spark, sf):
    from kgloom.plans.funnel_queries import _funnel

    f = _funnel(spark, "/root/testdata/sf0.001")
    for wide, narrow in ((f.pairs, f.similar), (f.similar, f.equivalent), (f.equivalent, f.exact), (f.correct, f.new_beyond_exact)):
        assert narrow.exceptAll(wide).count() == 0
    assert f.correct.count() + f.wrong.count() == fixtures.generated(spark, "/root/testdata/sf0.001").count()


def test_conflicts_and_case(spark):
    new = spark.createDataFrame([("Heat", "r", "x"), ("b", "r", "y")], T)
    removal = spark.createDataFrame([("Heat", "r", "x", "heat", "r", "x")], "gen_head string, gen_relation string, gen_tail string, " + T)
    assert rows(funnel.resolve(new, removal)[0]) == rows(new)
    kept, gone = funnel.resolve(new, removal, any_case=True)
    assert rows(kept) == [("b", "r", "y")] and rows(gone) == [("Heat", "r", "x")]


def test_judges(spark):
    df = spark.createDataFrame([(1, "p"), (2, "q")], "i int, prompt string")
    assert [r.answer for r in ExpressionJudge("i = 1")(df).orderBy("i").collect()] == ["TRUE", "FALSE"]
    answers = spark.createDataFrame([("p", "yes")], "prompt string, answer string").select(ReplayJudge.key(F.col("prompt")).alias("prompt_key"), "answer")
    assert [r.answer for r in ReplayJudge(answers, F.col("prompt"))(df).orderBy("i").collect()] == ["yes", None]

    def make():
        def client(prompt):
            if prompt == "q":
                raise OSError
            return prompt.upper()

        return client

    assert [r.answer for r in ClientJudge(make, F.col("prompt"))(df).orderBy("i").collect()] == ["P", None]
    assert backend("client-70b") is ClientJudge
    with pytest.raises(ValueError):
        backend("unknown")


def test_graph_operators(spark):
    graph = spark.createDataFrame([("a", "r", "b"), ("b", "s", "c"), ("d", "r", "e")], T)
    keys = spark.createDataFrame([("b",), ("s",)], "keyword string")
    assert rows(kg.mask(graph, keys)) == [("a", "r", "b"), ("b", "s", "c")]
    lines = spark.createDataFrame([(10 * i,) for i in range(181)], "n long")
    parts = kg.split_file(lines, 10, "n").groupBy("part").agg(F.count(F.lit(1)).alias("c"), F.min("n").alias("m")).orderBy("part").collect()
    assert [r.c for r in parts] == [19] + [18] * 9 and [r.m for r in parts][:3] == [0, 190, 370]
    many = spark.range(0, 5000, 3).withColumnRenamed("id", "n")
    placed = readers.dense_index(many, "n", "i", rows_per_bucket=100)
    assert placed.where("n <> i * 3").count() == 0 and placed.count() == many.count()


def test_knn_in_blocks(spark):
    v = spark.createDataFrame([(f"e{i}", [float(i % 7), float(i % 5)]) for i in range(40)], "id string, vec array<double>")
    for metric in knn.METRICS[:2]:
        assert rows(knn.nearest(v, v, 4, metric, block_rows=7)) == rows(knn.nearest(v, v, 4, metric))
    assert knn.nearest(v.limit(0), v, 4).collect() == []
    with pytest.raises(ValueError):
        knn.nearest(v, v, 4, "other")


def test_knn_of_a_table_against_itself_in_tiles(spark):
    rng = np.random.default_rng(5)
    points = np.concatenate([rng.normal(size=(300, 6)), rng.integers(0, 2, (100, 6)), 3 + 1e-7 * rng.normal(size=(50, 6))])
    e = spark.createDataFrame([(f"e{i}", [float(x) for x in p], i) for i, p in enumerate(points)], "id string, vec array<double>, n int")
    asked = e.join(e.where("n % 3 > 0").select("id"), "id", "left_semi")
    dist = np.round(np.sqrt(((points[:, None] - points[None]) ** 2).sum(2)), 6)
    order = lambda i, own: sorted((dist[i, j], f"e{j}") for j in range(len(points)) if own or i != j)[:5]
    for own in (True, False):
        want = sorted((f"e{i}", r + 1, c) for i in range(len(points)) if i % 3 for r, (_, c) in enumerate(order(i, own)))
        for block in (20, 8192):
            assert sorted((r.query, r.rank, r.candidate) for r in knn.nearest(asked, e, 5, own=own, block_rows=block).collect()) == want
    pairs = knn.pairwise_cosine(asked, e.where("n < 300"), block_rows=256)
    assert pairs.count() == asked.count() * 300 and pairs.select("left", "right").distinct().count() == pairs.count()
    assert {len(f) for f in knn._every((list("abc"), np.ones((3, 2))), np.arange(100_000), np.ones((100_000, 2)), "cosine", True)} == {100_000}


@given(st.lists(st.tuples(st.integers(0, 5), st.integers(0, 9)), max_size=30), st.sets(st.integers(0, 9)))
@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
def test_cumulative_metrics(spark, items, relevant):
    got = metrics.cumulative(spark.createDataFrame(items, "iteration int, item int"), spark.createDataFrame([(r,) for r in relevant], "item int"), ["item"]).orderBy("iteration").collect()
    for r in got:
        so_far = {x for i, x in items if i <= r.iteration}
        assert (r.n_items, r.n_relevant) == (len(so_far), len(so_far & relevant))


def test_metrics_guard_zero(spark):
    empty = spark.createDataFrame([], "m string, i int, x int")
    gold = spark.createDataFrame([("a", 1, 5)], "m string, i int, x int")
    r = metrics.against_gold(empty, gold, ["m"], ["x"], "i").first()
    assert (r.tp, r.fp, r.fn, r.precision_micro, r.recall_micro) == (0, 0, 1, 0.0, 0.0)


def test_state(spark):
    done = spark.createDataFrame([(1, "x"), (2, "y")], "iteration int, evaluator string")
    every = spark.createDataFrame([(1,), (2,), (3,)], "iteration int")
    assert rows(state.missing(every, done)) == [(1, "y"), (2, "x"), (3, "x"), (3, "y")] and rows(state.missing(every, done, legacy_union=True)) == [(3,)]
    assert state.last_iteration(done) == 2 and state.last_iteration(done.limit(0)) == -1


def test_sources_and_sinks(spark, tmp_path):
    p = str(tmp_path)
    assert readers.raw_triples(readers.text_or_empty(spark, f"{p}/missing.txt")).count() == 0
    graph = spark.createDataFrame([("a", "r", "b"), ("a", "r", "b"), ("c", "s", "d")], T)
    assert sinks.save_triples(graph, f"{p}/triples") == 2
    assert rows(readers.triple_csv(spark, f"{p}/triples")) == [("a", " r", " b"), ("c", " s", " d")] and rows(readers.triple_csv(spark, f"{p}/triples", trim=True)) == [("a", "r", "b"), ("c", "s", "d")]
    sinks.save_mask(graph, kg.entities(graph), kg.relations(graph), p, "x")
    assert spark.read.text(f"{p}/relevant_entities_x").count() == 4
    (tmp_path / "articles.json").write_text('[{"ArticleID": "1", "Abstract": "", "body": "B. C"}, {"ArticleID": "2"}]')
    articles = readers.articles(spark, f"{p}/articles.json")
    from kgloom.functions.text import body, sentences

    assert sorted(len(r.s) for r in articles.select(sentences(body(F.col("Abstract"), F.col("body"))).alias("s")).collect()) == [0, 2]
    df = spark.createDataFrame([(1, "x"), (2, "y")], "v int, iteration string")
    sinks.save_results(df, f"{p}/results", ("iteration",))
    sinks.save_results(spark.createDataFrame([(9, "y")], "v int, iteration string"), f"{p}/results", ("iteration",))
    assert rows(spark.read.parquet(f"{p}/results").select("v", "iteration")) == [(1, "x"), (9, "y")]
    assert readers.results_or_empty(spark, f"{p}/none", df.schema).count() == 0
    assert readers.whole_file(spark, f"{p}/articles.json").startswith("[{")


def fake_search(query, database, n):
    return [{"ArticleID": f"{database}{i}", "Title": query, "Keywords": "Alpha, x", "Abstract": "a."} for i in range(n)]


def test_article_source(spark):
    spark.dataSource.register(readers.ArticleSource)
    got = spark.read.format("kgloom_articles").option("client", "tests.test_operators:fake_search").option("keywords", "alpha, beta").option("databases", "p,q").option("retmax", "3").load()
    assert got.count() == 6 and got.where("KeywordsMatch and Title = 'alpha AND beta'").count() == 6


def test_fetch_in_blocks(spark):
    docs = spark.createDataFrame([(i, f"red {'blue' if i % 2 else 'green'} {i}", "s") for i in range(20)], "doc_id long, text string, source string")
    keys = spark.createDataFrame([(1, ["red", "blue"]), (2, ["green"]), (3, ["none"])], "iteration int, keywords array<string>")
    got = rows(readers.fetch(docs, keys, 2, block_rows=1).select("iteration", "doc_id"))
    assert got == [(1, 1), (1, 3), (2, 0), (2, 2)]


def test_templates():
    document = '{"Generate_kg": {"a": ["for {{ purposes | replace(\'x\', \'\') | safe }}", "{{ other }}"], "n": 1}, "Filter_entity": {}, "Deduplicate_and_Prune_kg": {}, "Evaluate_kg": {"k": "{{ purposes }}"}}'
    values = {n: "v" for n in ("an_example", "more_examples", "entity_types", "entity_list", "relation_list")} | {"purposes": 'two\nlines "quoted"'}
    out = templates.criteria(document, values)
    assert out["Generate_kg"] == {"a": ["for two\nlines quoted", "{{ other }}"], "n": 1} and out["Evaluate_kg"] == {"k": "{{ purposes }}"}
    with pytest.raises(ValueError):
        templates.criteria(document, values | {"entity_list": ""})
    assert templates.family("mistral-7b") == "_mistral" and templates.family("none") == ""
    with pytest.raises(ValueError):
        templates.family("other")


def test_stream_is_idempotent(spark, tmp_path):
    p = str(tmp_path)
    docs = spark.createDataFrame([(i, f"one {i}. two {i}.") for i in range(6)], "doc_id long, text string")
    docs.repartition(3).write.parquet(f"{p}/in")
    for _ in range(2):
        chunk_stream(spark, f"{p}/in", docs.schema, f"{p}/out", f"{p}/checkpoint", files_per_batch=1).awaitTermination()
    assert spark.read.parquet(f"{p}/out").count() == 12


def test_bm25_deals_chunks_to_more_tasks_as_they_grow(spark, monkeypatch):
    from kgloom.operators import retrieve

    chunks = spark.createDataFrame([(i, 0, "common " * (1 + i % 3) + f"rare{i % 9}") for i in range(60)], "doc_id long, pos int, chunk string")
    queries = spark.createDataFrame([(1, "common rare3"), (2, "rare5 rare5"), (3, "absent")], "query_id long, query string")
    for rank, tokens in ((retrieve.bm25_lucene, retrieve.lucene_tokens), (retrieve.bm25_okapi, retrieve.space_tokens)):
        want = rows(rank(chunks, queries, 4))
        monkeypatch.setattr(retrieve, "CHUNKS_PER_TASK", 10)
        assert rows(rank(chunks, queries, 4)) == want
        assert retrieve._matches(chunks, queries, tokens)[0].rdd.getNumPartitions() == 24
        monkeypatch.undo()


def test_what_conflicts_is_parsed_once_for_all_removals(spark):
    from kgloom.functions import parse

    answer = "Conflicting Triples: (a, r, b) (c, r, d) (e, r, f)\nRemoval Triples: (e, r, f) (a, r, b) (x, r, y)"
    df = spark.createDataFrame([(answer,), (None,)], "a string").select(parse.conflicts(F.col("a"))[1].alias("removed"))
    assert [r.removed and [t.head for t in r.removed] for r in df.collect()] == [["e", "a"], None]
    assert "array_contains" not in df._jdf.queryExecution().optimizedPlan().toString()
