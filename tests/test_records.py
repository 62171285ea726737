import pytest
from pyspark.sql import functions as F

from kgloom.functions import parse
from kgloom.operators import knn, retrieve, state
from kgloom.sources import readers


def test_tuple_keys(spark):
    values = [("a", "b", "c"), ("it's", 'say "x"', "d, e"), ("back\\slash", "(", ")"), ("é", "", "both ' and \"")]
    rows = [(repr(v),) for v in values] + [("('a', 'b')",), ("__import__('os')",), (None,)]
    got = [r.t for r in spark.createDataFrame(rows, "key string").select(parse.tuple_key(F.col("key"), ["head", "relation", "tail"]).alias("t")).collect()]
    assert [tuple(t) for t in got[:4]] == values and got[4:] == [None] * 3


def test_dense_retrieval_by_name(spark):
    def make():
        return lambda texts: [[float(t.count("a")), float(t.count("b"))] for t in texts]

    chunks = spark.createDataFrame([(1, 0, "aaa"), (1, 1, "bb"), (2, 0, "ab"), (3, 0, None)], "doc_id long, pos int, chunk string").where("chunk is not null")
    queries = spark.createDataFrame([(7, "a"), (8, "bbb")], "query_id long, query string")
    found = retrieve.retrieve("bge", chunks, queries, 2, knn.encoder(make, batch=2)).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r["rank"], r.doc_id, r.pos, r.score) for r in found] == [(7, 1, 1, 0, 3.0), (7, 2, 2, 0, 1.0), (8, 1, 1, 1, 6.0), (8, 2, 2, 0, 3.0)]
    with pytest.raises(ValueError):
        retrieve.retrieve("bge", chunks, queries, 2)
    with pytest.raises(ValueError):
        retrieve.retrieve("other", chunks, queries, 2)


def test_start(spark):
    every, done = spark.range(6).toDF("iteration"), spark.createDataFrame([(1,), (3,)], "iteration long")
    of = lambda df: sorted(r.iteration for r in df.collect())
    assert of(state.from_start(every, done)) == [4, 5] and of(state.from_start(every, done, 2)) == [2, 4, 5] and of(state.from_start(every, done.limit(0))) == [*range(6)]


def test_whole_line_keywords(spark, tmp_path):
    (tmp_path / "k.txt").write_text(" heart attack, pain \nheart attack, pain\n\n")
    assert sorted(r.keyword for r in readers.load_keywords(spark, str(tmp_path / "k.txt")).collect()) == ["", "heart attack, pain"]
