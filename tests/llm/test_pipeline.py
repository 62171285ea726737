import __spark_entry__ as entry
import corpus_pipeline as C
import public_tokenizers as P
import tiktoken

from kgloom.llm.bpe import Vocabulary

ROWS = [
    (1, "Plain words of one kind follow each other in this sentence about nothing.", "en"), (2, "PLAIN words of one kind follow each other in this sentence about nothing.", "en"),
    (3, "12 34 56 !!", "en"), (4, None, None), (5, "A text of its own that quotes the benchmark: how many angels dance upon the head of a pin today", "en"),
    (6, "Ein anderer Text ganz für sich\nalways here", "de"), (None, "Another text without an id and with other words than all the rest", "en"), (1, "Plain words of one kind follow each other in this sentence about nothing.", "en"),
] + [(20 + i, f"Own words number {i} stand in this line alone {i * 7} times\nalways here", "en") for i in range(12)]


def test_stages(spark, tmp_path):
    folder = str(tmp_path)
    docs = spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in ROWS], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, "how many angels dance upon the head of a pin")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    assert [k for k, _ in C.STAGES] == ["language ID", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "byte-level BPE"]
    seen, after = spark.read.parquet(f"{folder}/documents.parquet"), []
    for n, (_, stage) in enumerate(C.STAGES[:-1]):
        seen = stage(spark, seen, folder)
        assert seen.columns == docs.columns
        seen.write.parquet(f"{folder}/stage{n}")
        seen = spark.read.parquet(f"{folder}/stage{n}")
        after.append(seen.collect())
    ids = [sorted(str(r.doc_id) for r in rows) for rows in after]
    assert "3" not in ids[0] and "4" not in ids[0] and len(ids[0]) == len(ROWS) - 2
    assert ids[1] == ids[0] and all("always here" not in (r.text or "") and r.n_chars == len(r.text) for r in after[1])
    assert "2" not in ids[2] and ids[2].count("1") == 1 and "None" in ids[2] and "6" in ids[2]
    assert "5" not in ids[3] and len(ids[3]) == len(ids[2]) - 1
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=Vocabulary.load(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    encoded = C.STAGES[-1][1](spark, seen, folder).collect()
    assert sorted((str(r.doc_id), r.ids) for r in encoded) == sorted((str(r.doc_id), library.encode_ordinary(r.text)) for r in after[3])


def test_near_copies_without_ids_or_under_one_id_stay_once(spark):
    words = [f"word{i}" for i in range(60)]
    text = lambda k, end: " ".join(f"{w}{k}" for w in words) + end
    rows = [(None, text(1, "")), (None, text(1, " more")), (None, text(2, "")), (5, text(2, " more")), (7, text(3, "")), (7, text(3, " more")), (7, text(4, "")), (9, text(4, "")), (None, text(5, "")), (None, ""), (8, None), (8, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [(r.doc_id, r.text) for r in C.drop_near_duplicates(spark, docs, "").collect()]
    assert len(kept) == 8 and set(kept) - {(None, text(1, "")), (None, text(1, " more")), (7, text(3, "")), (7, text(3, " more"))} == {(5, text(2, " more")), (7, text(4, "")), (None, text(5, "")), (None, ""), (8, None), (8, "")}


def test_registered():
    names = entry.queries()
    assert "pipeline" in names and {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{i}" for i in range(1, 14)}


CLASHING = "doc_id long, text string, lang string, source string, n_chars long, _key string, _row int, score string, lang_pred string, n_dropped string, n_lines string, leaks string, component_id string"


def test_clashing_names_long_texts_and_empty_tables(spark, tmp_path):
    """Extra columns come back as they were from every stage but the last, whatever their names; a very long text passes; an empty table stays empty."""
    folder = str(tmp_path)
    extra = ("k", 7, "0.1", "xx", "d", "l", "leak", "c")
    long_text = " ".join(f"word{i} of a very long text" for i in range(30_000))
    rows = [(i, t, lang, "s", len(t or ""), *extra) for i, t, lang in ROWS] + [(500, long_text, "en", "s", len(long_text), *extra), (501, "", "en", "s", 0, *extra)]
    docs = spark.createDataFrame(rows, CLASHING)
    spark.createDataFrame([(1, "how many angels dance upon the head of a pin")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    empty = docs.limit(0)
    for n, (_, stage) in enumerate(C.STAGES[:-1]):
        docs, empty = stage(spark, docs, folder), stage(spark, empty, folder)
        assert docs.columns == empty.columns == CLASHING.replace(" long", "").replace(" string", "").replace(" int", "").split(", ")
        docs.write.parquet(f"{folder}/s{n}")
        docs = spark.read.parquet(f"{folder}/s{n}")
        got = docs.collect()
        assert got and all(tuple(r)[5:] == extra for r in got) and empty.collect() == []
        assert [r.text for r in got if r.doc_id == 500] == [long_text]
    assert C.STAGES[-1][1](spark, empty, folder).collect() == []


def test_former_stages_are_discarded(spark, tmp_path):
    folder = str(tmp_path)
    spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in ROWS], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    import os

    where = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    before = set(os.listdir(where))
    out = C.run(spark, folder)
    new = [x for x in set(os.listdir(where)) - before if x.startswith("pipeline-")]
    assert len(new) == 1 and out.count() == len(out.collect()) > 0
