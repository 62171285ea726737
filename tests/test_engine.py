import pytest
from pyspark.sql import functions as F

from kgloom.engine import Engine
from kgloom.functions import text
from kgloom.operators import funnel
from kgloom.operators.judge import ClientJudge, ExpressionJudge


def engine(spark, folder):
    graph = spark.createDataFrame([("aspirin", "treats", "pain"), ("ibuprofen", "treats", "pain"), ("ibuprofen", "treats", "fever")], "head string, relation string, tail string")
    names = ["aspirin", "asprin", "ibuprofen", "pain", "fever"]
    vectors = spark.createDataFrame([(n, [float(i // 2), float(i)]) for i, n in enumerate(names)], "id string, vec array<double>")
    generator = ExpressionJudge(F.concat(F.lit("<'aspirin', 'treats', 'pain'> (asprin, eases, "), F.element_at("keywords", 1), F.lit(") <'"), F.element_at("chunks", 1), F.lit("', 'r', 'x'>")))
    own = text.triple_text(*[F.col(c) for c in funnel.GEN])
    judges = {k: ExpressionJudge("true") for k in ("entity", "similar", "equivalent")} | {"exact": ExpressionJudge("relation = gen_relation"), "correct": ExpressionJudge("relation = 'eases'")}
    judges["conflict"] = ExpressionJudge(F.concat(F.lit("Conflicting triples: "), F.col("triples"), F.lit("\nRemoval triples: "), own))
    return Engine(spark, folder, graph, vectors, generator, {"one": judges}, top_k=2, strictness="lenient", candidates=2)


def test_modes(spark, tmp_path):
    e = engine(spark, str(tmp_path / "run"))
    keywords = spark.createDataFrame([(0, ["pain"]), (1, ["fever"]), (2, ["absent"])], "iteration long, keywords array<string>")
    documents = spark.createDataFrame([(1, "The pain is here. Other words. More pain pain", "s"), (2, "fever and pain. A fever", "s"), (3, "  ", "s")], "doc_id long, text string, source string")
    assert [(r.iteration, r["rank"], r.chunk) for r in e.chunks(keywords, documents).where("rank = 1").orderBy("iteration").collect()] == [(0, 1, "More pain pain"), (1, 1, "A fever")]
    out = {r.iteration: r for r in e.run("generate_and_eval", keywords=keywords, documents=documents).collect()}
    assert set(out) == {0, 1} and out[0].n_generated == 3 and out[0].n_matched == 1 and out[1].evaluations["one"].n_rows > 0
    done = e.evaluations()
    kinds = {r.kind for r in done.collect()}
    assert {"similar", "equivalent", "correct", "wrong", "new_beyond_exact"} <= kinds and "conflict" not in kinds
    assert done.where("kind = 'correct'").select("iteration", "gen_tail").orderBy("iteration").collect() == [(0, "pain"), (1, "fever")]
    before = done.count()
    e.run("generate_and_eval", keywords=keywords, documents=documents)  # nothing is left to do
    assert e.evaluations().count() == before
    e.run("conflict_resolve")
    e.run("eval_exact_equiv")
    left = e.evaluations().where("kind = 'new_without_conflict'").count()
    assert left == 0 and e.evaluations().where("kind = 'removal'").count() > 0
    words = spark.createDataFrame([("pain",)], "keyword string")
    r = e.run("metric", keywords=words).orderBy("iteration").collect()
    assert r[0].recall == 0.5
    triples, entities, relations = e.run("mask", keywords=words, tag="x")
    assert (triples.count(), entities.count(), relations.count()) == (2, 3, 1)
    with pytest.raises(ValueError):
        e.run("other")


def test_each_prompt_is_asked_once(spark, tmp_path):
    """A client that notes its prompts: one prompt for each row of a stage, none in a second run, whatever the iteration gave."""
    notes = tmp_path / "notes"
    notes.mkdir()

    def client(kind, answer):
        folder = str(notes)

        def make():
            import os
            import uuid

            def ask(prompt):
                with open(os.path.join(folder, f"{kind}-{uuid.uuid4().hex}"), "w") as f:
                    f.write(prompt)
                return answer

            return ask

        return make

    e = engine(spark, str(tmp_path / "run"))
    pair = F.concat_ws(" ", *funnel.GEN, *funnel.NAMES)
    own = F.concat_ws(" ", *funnel.NAMES)
    prompts = {"entity": F.concat_ws(" ", "query", "candidate"), "similar": pair, "equivalent": pair, "exact": pair, "correct": own, "conflict": F.col("triples")}
    e.evaluators = {"one": {k: ClientJudge(client(k, "TRUE"), p) for k, p in prompts.items()}}
    e.generator = ClientJudge(client("generate", "(asprin, eases, pain)"), F.col("prompt"))
    e.resolve_conflicts = True
    keywords = spark.createDataFrame([(0, ["pain"]), (1, ["fever"]), (2, ["absent"])], "iteration long, keywords array<string>")
    documents = spark.createDataFrame([(1, "The pain is here. Other words", "s"), (2, "fever and pain. A fever", "s")], "doc_id long, text string, source string")
    e.run("generate_and_eval", keywords=keywords, documents=documents)
    asked = {}
    for f in notes.iterdir():
        asked.setdefault(f.name.split("-")[0], []).append(f.read_text())
    assert set(asked) == {"generate", *prompts} and all(len(v) == len(set(v)) for v in asked.values()), asked
    assert {r.iteration for r in e.done("generated").collect()} == {0, 1, 2}
    e.run("generate_and_eval", keywords=keywords, documents=documents)
    assert len(list(notes.iterdir())) == sum(map(len, asked.values()))


def test_a_rerun_leaves_no_stale_kinds(spark, tmp_path):
    e = engine(spark, str(tmp_path / "run"))
    keywords = spark.createDataFrame([(0, ["pain"])], "iteration long, keywords array<string>")
    documents = spark.createDataFrame([(1, "The pain is here", "s")], "doc_id long, text string, source string")
    e.run("generate_and_eval", keywords=keywords, documents=documents)
    e.run("conflict_resolve")
    kinds = lambda: {r.kind for r in e.evaluations().collect()}
    assert "removal" in kinds()
    before = e.evaluations().where("kind = 'similar'").count()
    e.evaluators["one"]["conflict"] = ExpressionJudge(F.lit("no conflicting triples"))
    e.run("conflict_resolve")
    assert not {"removal", "conflict"} & kinds() and e.evaluations().where("kind = 'similar'").count() == before


@pytest.mark.parametrize("name", ["prompts_conflicts", "prompts_correctness"])
def test_segments_meet_short_rows_last(spark, name):
    from kgloom.plans.all import QUERIES

    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    keys = [line for line in plan.split("\n") if "Aggregate [" in line]
    assert keys and not any("chunks" in line.split("Aggregate [")[1].split("]")[0] for line in keys)
    assert "RepartitionByExpression [iteration" in plan
