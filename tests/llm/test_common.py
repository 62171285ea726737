from kgloom.llm import common


def test_a_session_without_a_shared_folder_gets_one(spark, monkeypatch):
    monkeypatch.setattr(type(spark.conf), "get", lambda self, key, default=None: default)
    common._own.clear()
    folder = common.scratch(spark)
    assert folder.startswith("file:///") and common.scratch(spark) == folder
    monkeypatch.undo()
    assert common.scratch(spark) != folder


def test_stored_tables_can_be_discarded(spark):
    df = common.stored(spark.range(3).toDF("n"), "test")
    assert df.count() == 3
    common.discard(df)
    assert (spark, df._stored_at) not in common._written


def test_fresh_names(spark):
    assert common.fresh(spark.createDataFrame([(1, 2)], "a int, _A int"), "a", "b") == ["__a", "b"]


def test_stored_by_value(spark):
    df = spark.createDataFrame([(0, "a"), (2, "b"), (0, "c")], "k int, v string")
    out = common.stored_by(df, "k", (0, 1, 2), "test")
    assert [sorted(r.v for r in out[k].collect()) for k in (0, 1, 2)] == [["a", "c"], [], ["b"]]
    common.discard(out[0])
    assert out[2].count() == 1
