import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kgloom.functions import parse, text
from kgloom.operators import retrieve


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(("f", "value", "want"), [
    (text.clean_symbols, "a\nb, c_d", "ab c d"), (text.clean_symbols, " <'x'>  [\"y\"] (z)，w ", "x y z，w"), (text.clean_entity, "blood__sugar {x}", "blood sugar x"),
    (text.strip, " 　 a b\n", "a b"), (text.strip_prompt, "p [/INST] out ", "out"), (text.strip_prompt, " kept ", " kept "), (text.strip_prompt, "a [/INST] b [/INST]\nc", "c"),
    (text.verdict, "Incorrect.", True), (text.verdict, "FALSE", False), (text.verdict, None, False), (text.sentences, "a.. b.", ["a", "b"]), (text.sentences, "a. .", ["a", ""]),
    (text.keyword_line, "a\tb, c", ["a", "b", "c"]), (lambda x: text.verdict(x, strict=True), "Incorrect.", False), (lambda x: text.verdict(x, strict=True), " 'True' so", True),
    (lambda x: text.windows(x, 4, 2), "abcdefgh", ["abcd", "cdef", "efgh"]), (lambda x: text.windows(x, 4, 2), "abc", []),
])
def test_values(spark, f, value, want):
    assert one(spark, value, f) == want


def test_windows_need_a_step():
    with pytest.raises(ValueError):
        text.windows(F.lit("x"), 4, 4)


def squeeze(x):
    return re.sub(r"\s+", " ", x).strip()


def symbols(x):
    return squeeze("".join({"_": " ", ",": " "}.get(c, "" if c in "\n'\"<>[]()" else c) for c in x))


def triples(value, limit=80):
    out = []
    for pattern in (parse.QUOTED_TRIPLE, parse.LOOSE_TRIPLE):
        for m in re.finditer(pattern, value):
            t = tuple(map(symbols, m.groups()))
            if max(map(len, t)) <= limit and t not in out:
                out.append(t)
    return out


MESSY = [
    "<'a', 'is', 'b'> (c, of, d) ['e', 'is', 'f'] \"'g', 'is', 'h'\"", "'(x, y, z', <'i','j','k'|", "(p，q，r)\n(s, t, u\n(v, w", "('long', 'r', '" + "x" * 81 + "')", "<'same', 'r', 't'> (same, r, t)",
    "no triples", "", "(a, b_c, {d}) <a, , c>", "[('n1', 'r', 't1'), ('n2', 'r', 't2')]", "'(not quoted, at, all)' | <'m', 'n', 'o'",
]


@pytest.mark.parametrize("value", MESSY)
def test_triples_of_messy_answers(spark, value):
    assert [tuple(t) for t in one(spark, value, parse.model_triples)] == triples(value)


@given(st.lists(st.text(alphabet="ab'<>[](),，|\n_\" ", max_size=40), min_size=1, max_size=30))
@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
def test_triples_of_any_answer(spark, values):
    df = spark.createDataFrame(list(enumerate(values)), "i int, x string").select("i", parse.model_triples(F.col("x")).alias("t"))
    assert {r.i: [tuple(t) for t in r.t] for r in df.collect()} == {i: triples(v) for i, v in enumerate(values)}


def conflicts(spark, value):
    row = spark.createDataFrame([(value,)], "x string").select(*[c.alias(n) for c, n in zip(parse.conflicts(F.col("x")), "ab")]).first()
    return [tuple(t) for t in row.a], [tuple(t) for t in row.b]


def test_conflicts(spark):
    assert conflicts(spark, "No conflicting triples\nNo triples to remove") == ([], [])
    found, gone = conflicts(spark, "Conflicting Triples: (Heat, causes, Cold) (cold, causes, heat)\nRemoval Triples: (heat, causes, cold) (x, y, z)\nExplanation: (u, v, w)")
    assert found == [("heat", "causes", "cold"), ("cold", "causes", "heat")] and gone == [("heat", "causes", "cold")]
    assert conflicts(spark, "Conflicting triples: (a, b, c)\nRemoval triples: none") == ([("a", "b", "c")], [])


def test_cleaning_twice_changes_nothing(spark):
    df = spark.createDataFrame([(" a__{b} 　 c ",)], "x string").select(text.clean_entity(F.col("x")).alias("y"))
    assert df.where(text.clean_entity(F.col("y")) != F.col("y")).count() == 0


def test_okapi_fills_up_with_zero_scores(spark):
    chunks = spark.createDataFrame([(1, 0, "a b"), (1, 1, "c d"), (2, 0, "e f"), (2, 1, "g h")], "doc_id long, pos int, chunk string")
    queries = spark.createDataFrame([(1, "c"), (2, "nothing")], "query_id long, query string")
    got = [(r.query_id, r["rank"], r.doc_id, r.pos) for r in retrieve.bm25_okapi(chunks, queries, 3).orderBy("query_id", "rank").collect()]
    assert got == [(1, 1, 1, 1), (1, 2, 1, 0), (1, 3, 2, 0), (2, 1, 1, 0), (2, 2, 1, 1), (2, 3, 2, 0)]
    with pytest.raises(ValueError):
        retrieve.retrieve("other", chunks, queries, 3)
