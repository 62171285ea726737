import random

import pytest
from pyspark.sql import functions as F

from kgloom.operators import kg, prompts, refine
from kgloom.operators.judge import ExpressionJudge
from kgloom.sources import sinks
from kgloom.sources.articles import ArticleStore


def maker(folder):
    """A client that notes its calls: ids that end in 3 have no record, those in 7 spoil their batch until a file says they are mended; the database q is out of order."""

    def make():
        import os
        import uuid

        class Client:
            def note(self, kind, what):
                with open(os.path.join(folder, f"{kind}-{uuid.uuid4().hex}"), "w") as f:
                    f.write(what)

            def search(self, query, database, limit):
                self.note("search", f"{database}: {query}")
                if database == "q" and not os.path.exists(os.path.join(folder, "mended")):
                    raise ConnectionError("no database")
                return [] if "nothing" in query else [f"{database}{len(query)}{i}" for i in range(limit)]

            def fetch(self, ids, database):
                self.note("fetch", " ".join(ids))
                if any(x.endswith("7") for x in ids) and not os.path.exists(os.path.join(folder, "mended")):
                    raise ValueError("bad id")
                return {x: {"title": f"T{x}", "keywords": "Alpha, x", "abstract": f"A{x}", "body": None} for x in ids if not x.endswith("3")}

        return Client()

    return make


def test_search_fetch_and_refetch(spark, tmp_path):
    desk = tmp_path / "desk"
    desk.mkdir()
    store = ArticleStore(spark, str(tmp_path / "store"), maker(str(desk)), ("p", "q"), retmax=6, batch=4, tasks=2, retries=2)
    keywords = spark.createDataFrame([(0, ["alpha", "b"]), (1, ["nothing"]), (2, ["alpha", "b"])], "iteration long, keywords array<string>")
    store.search(keywords)
    ids = [f"p11{i}" for i in range(9)]  # 9 of 6 wanted; "alpha AND b" has 11 characters
    assert sorted(r.article_id for r in store.articles().collect()) == [x for x in ids if x[-1] not in "37"]
    failed = {r.article_id: r for r in store.failed().collect()}
    assert set(failed) == {"p113", "p117"} and failed["p113"].error == "no record" and "bad id" in failed["p117"].error and failed["p117"].attempts == 2
    rows = store.results(keywords).collect()
    assert sorted((r.iteration, r.ArticleID) for r in rows) == [(i, f"p11{x}") for i in (0, 2) for x in (0, 1, 2, 4, 5, 6)]
    assert {(r.Database, r.SearchKeywords, r.KeywordsMatch, r.body == r.Abstract) for r in rows} == {("p", "alpha, b", True, True)}
    assert store.found().where("error is not null").count() == 3  # the searches of database q
    read = [f.read_text().split() for f in desk.iterdir() if f.name.startswith("fetch")]
    assert max(map(len, read)) <= 4 and not any(len(x) > 4 for x in read)
    n = len(list(desk.iterdir()))
    store.search(keywords.where("iteration < 0"))
    assert len(list(desk.iterdir())) == n
    (desk / "mended").write_text("")
    store.refetch()
    assert [r.article_id for r in store.failed().collect()] == ["p113"] and store.articles().where("article_id = 'p117'").count() == 1
    store.search(keywords)
    assert store.results(keywords).where("Database = 'q'").count() == 12
    searched = sorted(f.read_text() for f in desk.iterdir() if f.name.startswith("search"))
    assert searched.count("p: alpha AND b") == 2  # each iteration once, answered searches never again
    again = len([f for f in desk.iterdir() if f.name.startswith("fetch")])
    store.search(keywords)
    assert len([f for f in desk.iterdir() if f.name.startswith("fetch")]) == again


def test_triples_in_first_seen_order(spark, tmp_path):
    rnd = random.Random(1)
    rows = [(f"h{rnd.randrange(40)}", "r", f"t{rnd.randrange(3)}", i) for i in range(400)]
    graph = spark.createDataFrame(rows, "head string, relation string, tail string, line_no long").repartition(7)
    want = list(dict.fromkeys(f"{h}, {r}, {t}" for h, r, t, _ in rows))
    path = tmp_path / "triples"
    assert sinks.save_triples(graph, str(path), "line_no", parts=5) == len(want)
    files = sorted(path.glob("part-*"))
    assert len(files) > 1 and [x for f in files for x in f.read_text().splitlines()] == want
    words = spark.createDataFrame([("t1",), ("h3",)], "keyword string")
    masked = kg.mask(graph, words, "line_no")
    sinks.save_mask(masked, kg.entities(masked), kg.relations(masked), str(tmp_path), "x", "line_no")
    got = [x for f in sorted((tmp_path / "relevant_triples_x").glob("part-*")) for x in f.read_text().splitlines()]
    assert got == [x for x in want if x.endswith(", t1") or x.startswith("h3,")]


def last_words():
    return ExpressionJudge(F.array_join(F.transform(F.split("items", "\n"), lambda x: F.substring_index(x, " ", -1)), "\n"))


def test_refined_lists(spark):
    rnd = random.Random(2)
    rows = [("a", f"w{rnd.randrange(900)} word{rnd.randrange(30)}") for _ in range(700)] + [("b", " one "), ("b", "one"), ("b", ""), ("b", None), ("c", "x" * 300)]
    df = spark.createDataFrame(rows, "g string, item string")
    want = {("a", x.split(" ")[-1]) for g, x in rows if g == "a"} | {("b", "one"), ("c", "x" * 300)}
    sizes = []

    def ask(step, judge, lists):
        sizes.extend(r.n for r in lists.select(F.length("items").alias("n"), "n_items").where("n_items > 1").collect())
        return judge(lists)

    for parts in (1, 5):
        got = refine.refine(df.repartition(parts), ["g"], last_words(), max_chars=200, ask=ask).collect()
        assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert max(sizes) <= 200 and len(sizes) > 10
    silent = refine.refine(df, ["g"], ExpressionJudge(F.lit(None).cast("string")), max_chars=200)
    assert silent.where("g = 'a'").count() == len({x for g, x in rows if g == "a"})  # without answers the items stay
    assert refine.refine(df.limit(0), ["g"], last_words()).collect() == []


def test_compiled_templates(spark):
    df = spark.createDataFrame([('say "x"\n{{ b }}', None)], "a string, n string")
    c = prompts.compiled("<{{ a | replace('x', 'y') | safe }}|{{n}}|{{ other }}|{{ k }}>", {"a": F.col("a"), "n": F.col("n"), "k": 'k"'}, quotes=False)
    assert df.select(c).first()[0] == "<say x\n{{ b }}||{{ other }}|k>"
    with pytest.raises(KeyError):
        prompts.criteria({}, "Filter_entity", {"entity_types": "a"})
    with pytest.raises(ValueError):
        prompts.criteria({"Filter_entity": {"A": ["b"]}}, "Filter_entity", {"entity_types": ""})
    assert "conflict" not in prompts.judgements() and set(prompts.judges(lambda p: ExpressionJudge(p), ("conflict_graphusion",))) == {"entity", "similar", "equivalent", "exact", "correct", "conflict"}
