"""Keys of prompts with segments: against whole prompts hashed by hand, and the queries against SQL on odd conversations."""

import hashlib

import duckdb
import pytest
from pyspark.sql import functions as F

from kgloom.operators import prompt_keys, prompts
from kgloom.plans.all import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("piece", [1, 9, 1 << 19])
def test_keys_are_those_of_whole_prompts(spark, monkeypatch, piece):
    monkeypatch.setattr(prompt_keys, "ROWS", 3)
    monkeypatch.setattr(prompt_keys, "PARTS", 2)
    texts = [(0, 1, 2, "später"), (0, 1, 1, ""), (0, 1, None, "last of one"), (0, 2, 0, "x" * 3000), (0, 0, 0, "first"), (0, 0, 1, None), (2, 5, 0, "no rows"), (None, 7, 0, "no iteration"), (3, 1, 0, "")]
    rows = [(0, f"é{i}") for i in range(40)] + [(0, "twice"), (0, "twice"), (1, "no segments"), (None, "no iteration"), (3, "an empty segment"), (3, None)]
    segments = spark.createDataFrame(texts, "iteration long, conv long, turn int, text string").repartition(3)
    made = spark.createDataFrame(rows, "iteration long, name string")
    name = F.coalesce("name", F.lit(""))
    shown = {"a": (F.concat(F.lit("A "), name), F.lit("")), "b": (F.lit("B "), F.concat(F.lit(" end "), name))}
    got = prompt_keys.sha256_keys(made, segments, shown, ["iteration", "name"], ["conv", "turn"], piece)
    assert got.columns == ["iteration", "name", "a", "b"]
    chunks = {0: "\n".join(["first", "", "später", "last of one", "x" * 3000]), 3: ""}
    key = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = [(i, n, key(f"A {n or ''}{chunks.get(i, '')}"), key(f"B {chunks.get(i, '')} end {n or ''}")) for i, n in rows]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_around_chunks_is_the_prompt(spark):
    row = spark.range(1).select(*[F.lit(c).alias(c) for c in ("head", "relation", "tail", "chunks", "triples")], *[F.lit(c).alias(f"gen_{c}") for c in ("head", "relation", "tail")])
    for stage, enable in (("correct", ()), ("correct", ("correctness_got",)), ("conflict", ("conflict_resolve",)), ("conflict", ("conflict_graphusion",))):
        before, after = prompts.around_chunks(stage, enable)
        whole, parted = row.select(prompts.judgements(enable)[stage], F.concat(before, "chunks", after)).first()
        assert whole == parted
    with pytest.raises(ValueError):
        prompts.around_chunks("similar")


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    """A folder in which the first turn of every fourth conversation has no number, and some conversations have no id or no text."""
    folder, con = tmp_path_factory.mktemp("odd"), duckdb.connect()
    con.sql("CREATE TABLE embeddings AS SELECT * FROM '/root/testdata/sf0.001/embeddings.parquet'")
    con.sql("""CREATE TABLE conversations AS SELECT CASE WHEN conv_id % 23 = 5 THEN NULL ELSE conv_id END AS conv_id, CASE WHEN conv_id % 4 = 1 AND turn = low THEN NULL ELSE turn END AS turn, role,
      CASE conv_id % 20 WHEN 7 THEN NULL ELSE text END AS text FROM (SELECT *, min(turn) OVER (PARTITION BY conv_id) AS low FROM '/root/testdata/sf0.001/conversations.parquet')""")
    for t in ("embeddings", "conversations"):
        con.sql(f"COPY {t} TO '{folder}/{t}.parquet'")
    return str(folder), con


@pytest.mark.parametrize("name", ["prompts_correctness", "prompts_conflicts"])
def test_odd_conversations_as_in_sql(spark, odd, name):
    got, want = QUERIES[name](spark, odd[0]), odd[1].sql(ORACLE_SQL[name])
    rows = sorted((tuple(r[c] for c in want.columns) for r in got.collect()), key=repr)
    assert rows and rows == sorted(want.fetchall(), key=repr)


@pytest.mark.parametrize("name", ["prompts_correctness", "prompts_conflicts"])
def test_no_prompt_is_built(spark, name):
    """Segments pass by the hashes of all rows of a part; no row has them in a column, whole or in a prompt."""
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "sha2(" not in plan and "collect_list(" not in plan and "MapInArrow" in plan
