import collections

from kgloom.llm.line_dedup import drop_frequent_lines

BLANKS = " \t\n\x0b\f\r"
LOWER = {i: i + 32 for i in range(65, 91)}


def brute(rows, threshold, least=1):
    key = lambda x: x.strip(BLANKS).translate(LOWER)
    seen = collections.defaultdict(set)
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= least:
                seen[key(line)].add(doc_id)
    hot = {k for k, d in seen.items() if len(d) >= threshold}
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if key(x) not in hot]
        out.append((doc_id, text if len(kept) == len(lines) else "\n".join(kept), len(lines), len(lines) - len(kept)))
    return collections.Counter(out)


def got(df):
    return collections.Counter(tuple(r) for r in df.select("doc_id", "text", "n_lines", "n_dropped").collect())


def test_against_brute_force(spark):
    rows = [(i, f"Common Line {i % 3}\nown {i}\n\n  common line 0\t\r\n É{i % 2}\xa0") for i in range(12)]
    rows += [(100, None), (101, ""), (102, "\n\n"), (103, "common line 0"), (103, "common line 0"), (103, "other"), (None, "common line 1\nx"), (None, "common line 1\ny"), (104, "own 3\n" * 5000), (105, "ÉCOMMON\x0b")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for threshold in (1, 2, 5, 10):
        assert got(drop_frequent_lines(df, threshold)) == brute(rows, threshold)
    assert got(drop_frequent_lines(df, 3, min_length=6)) == brute(rows, 3, 6)


def test_columns_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "a\nb", 5, "h", "i")], "doc_id long, text string, n_lines int, _h string, _id string")
    out = drop_frequent_lines(df, 1)
    assert out.columns == ["doc_id", "text", "n_lines", "_h", "_id", "n_dropped"]
    assert tuple(out.first()) == (1, "", 2, "h", "i", 2)
    assert drop_frequent_lines(df.limit(0)).collect() == []
