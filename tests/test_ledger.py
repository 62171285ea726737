import time

import pytest
from pyspark.sql import functions as F

from kgloom.engine import Engine
from kgloom.operators import denoise, funnel, prompts
from kgloom.operators.judge import ClientJudge, ExpressionJudge, ReplayJudge, replies
from kgloom.operators.ledger import Ledger, work_table


class Desk:
    """A client whose calls are noted in files, and which is out of order while a file says so, for the prompts that hold one of its texts, or all."""

    def __init__(self, folder):
        folder.mkdir(exist_ok=True)
        self.folder = str(folder)

    def outage(self, what=None):
        import os

        path = os.path.join(self.folder, "outage")
        if what is None:
            os.remove(path)
        else:
            with open(path, "w") as f:
                f.write(what)

    def maker(self, kind, answer):
        folder = self.folder

        def make():
            import os
            import uuid

            def ask(prompt):
                path = os.path.join(folder, "outage")
                if os.path.exists(path) and any(x in f"<{kind}> {prompt}" for x in open(path).read().split("|")):
                    raise ConnectionError("out of order")
                with open(os.path.join(folder, f"{kind}-{uuid.uuid4().hex}"), "w") as f:
                    f.write(prompt)
                return answer

            return ask

        return make

    def asked(self):
        import os

        out = {}
        for name in os.listdir(self.folder):
            if "-" in name:
                out.setdefault(name.split("-")[0], []).append(open(os.path.join(self.folder, name)).read())
        return out


def engine(spark, tmp_path, desk, **options):
    graph = spark.createDataFrame([("aspirin", "treats", "pain"), ("ibuprofen", "treats", "fever")], "head string, relation string, tail string")
    vectors = spark.createDataFrame([(n, [float(i), 1.0]) for i, n in enumerate(["aspirin", "asprin", "ibuprofen", "pain", "fever"])], "id string, vec array<double>")
    answers = {"entity": "TRUE", "similar": "TRUE", "equivalent": "TRUE", "exact": "FALSE", "correct": "TRUE"}
    judges = {k: ClientJudge(desk.maker(k, answers[k]), p, retries=2) for k, p in prompts.judgements().items()}
    return Engine(spark, str(tmp_path / "run"), graph, vectors, ClientJudge(desk.maker("generate", "(asprin, eases, pain)"), F.col("prompt"), retries=2), {"one": judges}, candidates=2, strictness="lenient", **options)


def inputs(spark):
    keywords = spark.createDataFrame([(0, ["pain"]), (1, ["fever"]), (2, ["absent"])], "iteration long, keywords array<string>")
    documents = spark.createDataFrame([(1, "The pain is here. Other words", "s"), (2, "fever and heat. A fever", "s")], "doc_id long, text string, source string")
    return {"keywords": keywords, "documents": documents}


def iterations(df):
    return sorted({r.iteration for r in df.collect()})


def test_outage_of_the_generator(spark, tmp_path):
    desk = Desk(tmp_path / "desk")
    e, given = engine(spark, tmp_path, desk), inputs(spark)
    desk.outage("")
    e.run("generate", **given)
    assert e.generated().isEmpty() and iterations(e.done("generated")) == [2]
    dead = e.dead_letters().collect()
    assert sorted(r.iteration for r in dead) == [0, 1] and {r.step for r in dead} == {"generated:triples"}
    assert all(r.attempts == 2 and "out of order" in r.error and "Keywords" in r.prompt for r in dead)
    desk.outage("fever")
    e.run("generate", **given)
    assert iterations(e.generated()) == [0] and [r.attempts for r in e.dead_letters().collect()] == [4]
    desk.outage()
    e.run("generate", **given)
    assert iterations(e.generated()) == [0, 1] and e.dead_letters().isEmpty()
    e.run("generate", **given)
    assert len(desk.asked()["generate"]) == 2


def test_outage_of_each_judge(spark, tmp_path):
    desk = Desk(tmp_path / "desk")
    e, given = engine(spark, tmp_path, desk), inputs(spark)
    e.run("generate", **given)
    for stage in ("entity", "similar", "equivalent", "exact", "correct"):
        desk.outage(f"<{stage}>|<correct>")  # correctness waits for no other stage
        e.run("eval")
        assert e.evaluations().isEmpty() and iterations(e.dead_letters()) == [0, 1], stage
    desk.outage()
    e.run("eval")
    assert iterations(e.evaluations()) == [0, 1] and e.dead_letters().isEmpty()
    asked = desk.asked()
    assert set(asked) == {"generate", "entity", "similar", "equivalent", "exact", "correct"} and all(len(v) == len(set(v)) for v in asked.values())
    seconds = {(r.step, r.iteration): r for r in e.timing().collect()}
    assert seconds["evaluated:one:correct", 0].n_prompts == 1 and seconds["evaluated:one:correct", 0].attempts == 11
    assert {s for s, _ in seconds} == {"generated:triples", *(f"evaluated:one:{k}" for k in ("entity", "similar", "equivalent", "exact", "correct"))}


def test_an_outage_for_one_iteration_leaves_the_others(spark, tmp_path):
    desk = Desk(tmp_path / "desk")
    e, given = engine(spark, tmp_path, desk, resume="after_last"), inputs(spark)
    e.run("generate", **given)
    desk.outage("fever and heat")  # in the chunks that the correctness judge reads
    e.run("eval")
    assert iterations(e.evaluations()) == [0]
    desk.outage()
    e.run("eval")
    assert iterations(e.evaluations()) == [0, 1]


def test_backfill_asks_what_lacks_alone(spark, tmp_path):
    desk = Desk(tmp_path / "desk")
    e, given = engine(spark, tmp_path, desk), inputs(spark)
    e.run("generate_and_eval", **given)
    n = len(desk.asked()["exact"])
    for _ in range(2):
        e.run("eval_exact_equiv")
    assert len(desk.asked()["exact"]) == n
    # results of a run without the exact stage: the marks and rows of iteration 1 lack
    e._done().where("not (step = 'exact:one' and iteration = 1)").write.parquet(str(tmp_path / "marks"))
    spark.read.parquet(str(tmp_path / "marks")).write.mode("overwrite").parquet(e._path("done"))
    e.run("eval_exact_equiv")
    new = len(desk.asked()["exact"]) - n
    assert new == e.evaluations().where("kind = 'equivalent' and iteration = 1").count() > 0
    e.run("eval_exact_equiv")
    assert len(desk.asked()["exact"]) == n + new


def test_conflicts_are_asked_anew_once(spark, tmp_path):
    desk = Desk(tmp_path / "desk")
    e, given = engine(spark, tmp_path, desk), inputs(spark)
    e.evaluators["one"]["conflict"] = ClientJudge(desk.maker("conflict", "no conflicting triples. no triples to remove"), prompts.judgements(("conflict_resolve",))["conflict"])
    e.run("generate_and_eval", **given)
    desk.outage("<conflict>")
    e.run("conflict_resolve")
    assert "conflict" not in desk.asked() and not e.evaluations().where("kind = 'new_without_conflict'").count()
    desk.outage()
    e.run("conflict_resolve")
    n = len(desk.asked()["conflict"])
    assert n == 2 and e.evaluations().where("kind = 'new_without_conflict'").count() == e.evaluations().where("kind = 'new_beyond_exact'").count() > 0
    e.run("conflict_resolve")
    assert len(desk.asked()["conflict"]) == 2 * n


def test_emptied_iterations_lose_their_partition(spark, tmp_path):
    desk = Desk(tmp_path / "desk")
    e, given = engine(spark, tmp_path, desk), inputs(spark)
    e.run("generate_and_eval", **given)
    own = e.evaluations().select("iteration", *funnel.GEN).distinct()
    kinds = [r.kind for r in e.evaluations().select("kind").distinct().collect()]
    none = spark.createDataFrame([], e.evaluations().select(*funnel.GEN, *funnel.NAMES).schema)
    e._save({k: none for k in kinds}, own.where("iteration = 0"), "one")
    assert iterations(e.evaluations()) == [1]


def test_replies_and_pauses(spark):
    def make():
        calls = []

        def ask(prompt):
            calls.append(prompt)
            if prompt == "slow" and calls.count("slow") < 3:
                raise ValueError("later")
            return "  " if prompt == "blank" else prompt.upper()

        return ask

    df = spark.createDataFrame([("slow",), ("blank",), ("a",)], "p string").coalesce(1)
    began = time.monotonic()
    got = {r.p: r for r in replies(ClientJudge(make, F.col("p"), retries=3, delay=0.2, growth=2.0, in_flight=3), df).collect()}
    assert time.monotonic() - began >= 0.6
    assert (got["slow"].answer, got["slow"].attempts, got["a"].attempts, got["a"].error) == ("SLOW", 3, 1, None)
    assert got["blank"].answer is None and got["blank"].error == "blank answer" and got["blank"].attempts == 3
    recorded = ReplayJudge(spark.createDataFrame([("x", "yes")], "prompt_key string, answer string"), F.col("p"))
    assert {r.error for r in replies(recorded, df).collect()} == {"no answer"}
    with pytest.raises(ValueError):
        ClientJudge(make, F.col("p"), per_second=0)


def test_the_rate_holds_over_four_tasks(spark, tmp_path):
    folder = str(tmp_path)

    def make():
        import os
        import time
        import uuid

        def ask(prompt):
            with open(os.path.join(folder, uuid.uuid4().hex), "w") as f:
                f.write(str(time.time()))
            return "x"

        return ask

    df = spark.range(24).select(F.col("id").cast("string").alias("p"))
    assert ClientJudge(make, F.col("p"), per_second=8.0, tasks=4, in_flight=2)(df).where("answer = 'x'").count() == 24
    times = sorted(float(f.read_text()) for f in tmp_path.iterdir())
    assert len(times) == 24
    for start in times:  # four tasks may start a call each at once, then one every half second
        assert sum(start <= t < start + 1 for t in times) <= 8 + 4


def test_calls_of_a_day(spark, tmp_path):
    desk = Desk(tmp_path / "desk")
    day = ["2001-01-01"]
    ledger = Ledger(spark, str(tmp_path / "asked"), work_table(spark, str(tmp_path / "work")), per_day=6, today=lambda: day[0])
    df = spark.range(8).select(F.col("id").alias("iteration"), F.concat(F.lit("p"), F.col("id")).alias("p"))
    judge = ClientJudge(desk.maker("x", "yes"), F.col("p"), retries=2)
    open_ = [len(iterations(ledger.ask("src:x", judge, df, lambda x: x)[1])) for _ in range(4)]
    assert open_ == [5, 4, 3, 3] and len(desk.asked()["x"]) == 5  # room for 3 at two attempts each, then for 1 and 1, then for none
    day[0] = "2001-01-02"
    answered, lacking = ledger.ask("src:x", judge, df, lambda x: x)
    assert iterations(lacking) == [] and answered.where("answer = 'yes'").count() == 8 and len(desk.asked()["x"]) == 8


def plain_rounds(keywords, chunks, name, rewrite, rounds):
    current, found = dict(chunks), {i: set() for i in keywords}
    for _ in range(rounds):
        named = {k: name(c) for k, c in current.items()}
        current = {k: rewrite(c, named[k]) for k, c in current.items()}
        for (i, _), words in named.items():
            found[i] |= set(words)
    return {i: k + sorted(found[i] - set(k)) for i, k in keywords.items()}, current


def test_denoising_against_a_plain_loop(spark):
    keywords = {0: ["own"], 1: ["b", "zz"], 2: []}
    chunks = {(0, 1): "a b c d e", (0, 2): "q r s t", (1, 1): "b own x y z", (1, 2): "one"}
    name = lambda c: sorted({c.split(" ")[0]} - {""})
    rewrite = lambda c, ks: c[len(ks[0]) + 1 :] if ks else c
    first = F.substring_index("chunk", " ", 1)
    judges = {"keywords": ExpressionJudge(F.concat(first, F.lit(","))), "text": ExpressionJudge(F.when(F.size("named") == 0, F.col("chunk")).otherwise(F.expr("substring(chunk, length(named[0]) + 2)")))}
    k = spark.createDataFrame(list(keywords.items()), "iteration long, keywords array<string>")
    c = spark.createDataFrame([(i, r, x) for (i, r), x in chunks.items()], "iteration long, rank int, chunk string")
    for rounds in (1, 3):
        words, texts, waiting = denoise.in_rounds(k, c, judges, rounds)
        want = plain_rounds(keywords, chunks, name, rewrite, rounds)
        assert {r.iteration: r.keywords for r in words.collect()} == want[0] and {(r.iteration, r["rank"]): r.chunk for r in texts.collect()} == want[1]
        assert waiting.isEmpty()


def test_denoising_in_the_engine_goes_on_where_it_stopped(spark, tmp_path):
    desk = Desk(tmp_path / "desk")
    denoisers = {"keywords": ClientJudge(desk.maker("keywords", "['heat']"), F.col("prompt")), "text": ClientJudge(desk.maker("text", "short text"), F.col("prompt"))}
    e, given = engine(spark, tmp_path, desk, enable=("denoising_doc", "criteria_more"), denoisers=denoisers), inputs(spark)
    desk.outage("<text> Denoise the text by the keywords.\nText: short")  # from the second round on
    e.run("generate", **given)
    assert e.generated().isEmpty() and iterations(e.dead_letters()) == [0, 1]
    n = len(desk.asked()["text"])
    desk.outage()
    e.run("generate", **given)
    asked = desk.asked()
    assert iterations(e.generated()) == [0, 1] and len(asked["text"]) > n and all("heat" in p and "short text" in p and prompts.MORE in p for p in asked["generate"])
    for kind in ("keywords", "text"):
        assert len(asked[kind]) <= 4 + 2  # the chunks of the first round, then the one text that all became, each round apart
    assert {r.chunk for r in e.used_chunks().collect()} == {"short text"}
    with pytest.raises(ValueError):
        engine(spark, tmp_path, desk, enable=("denoising_doc",))
    with pytest.raises(ValueError):
        engine(spark, tmp_path, desk, enable=("other",))


def test_retrieval_by_name(spark, tmp_path):
    from kgloom.operators import knn

    def make():
        return lambda texts: [[float(t.count("fever")), float(t.count("pain"))] for t in texts]

    desk, found = Desk(tmp_path / "desk"), {}
    for method in ("bm25s", "rankbm25", "bge"):
        e = engine(spark, tmp_path, desk, method=method, top_k=1, encode=knn.encoder(make))
        found[method] = {r.iteration: r.chunk for r in e.chunks(**inputs(spark)).collect()}
    assert found["bm25s"] == {0: "The pain is here", 1: "A fever"} and found["bge"] == {0: "The pain is here", 1: "fever and heat"} and set(found["rankbm25"]) == {0, 1}
    with pytest.raises(ValueError):
        engine(spark, tmp_path, desk, method="none").chunks(**inputs(spark))
