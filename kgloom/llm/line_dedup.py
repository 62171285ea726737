"""Line dedup: normalised lines are exploded as hashes, documents are counted for each hash, frequent lines go, the rest is reassembled by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgloom.llm.common import BLANKS, ascii_lower, fresh


#: A frequent line meets its documents in so many parts.
SALTS = 16


def line_keys(lines: Column) -> Column:
    return F.transform(lines, lambda x: ascii_lower(F.btrim(x, F.lit(BLANKS))))


def _hash(key: Column) -> Column:
    """128 bits of a key: no other line shares those of a frequent one."""
    return F.struct(F.xxhash64(key).alias("a"), F.xxhash64(F.lit(7), key).alias("b"))


def drop_frequent_lines(docs: DataFrame, min_docs: int = 10, min_length: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Drops all lines whose key occurs in min_docs or more distinct documents.

    A line's key is the line stripped of ASCII blanks at both ends with A-Z lower-cased; keys of fewer than min_length
    code points always stay. The result has every row and column of docs, with text_col rewritten where a line went,
    and n_lines, n_dropped (long), which replace columns of these names.

    Null and empty texts are one empty line and come back as they were. Documents are told apart by id_col: rows that
    repeat an id count once for a line, all rows without an id count as one document. Repeated rows stay repeated. An
    empty table gives an empty result.

    Only hashes are exploded and shuffled for the count; the texts are shuffled once, by row, to meet their frequent
    lines. A line that most documents hold is counted from partial sums, and handed back by a join on the line and one of
    SALTS parts of its documents.
    """
    doc, text, lines, keys, hot, h, row, salt = fresh(docs, "_id", "_text", "_lines", "_keys", "_hot", "_h", "_row", "_salt")
    base = docs.withColumns({doc: F.col(id_col), text: F.coalesce(F.col(text_col), F.lit("")), row: F.struct(F.xxhash64(F.col(id_col), F.col(text_col)).alias("a"), F.xxhash64(F.lit(7), F.col(id_col), F.col(text_col)).alias("b"))})
    long_enough = F.filter(line_keys(F.split(F.col(text), "\n")), lambda k: F.length(k) >= min_length)
    seen = base.select(doc, row, F.explode(F.array_distinct(F.transform(long_enough, _hash))).alias(h))
    frequent = seen.select(h, doc).distinct().groupBy(h).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_docs).select(h, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias(salt))
    found = seen.withColumn(salt, F.pmod(F.col(f"{row}.a"), F.lit(SALTS)).cast("int")).join(frequent, [h, salt]).groupBy(row).agg(F.collect_set(h).alias(hot))
    joined = base.join(found, row, "left").withColumn(lines, F.split(F.col(text), "\n"))
    kept = F.filter(F.col(lines), lambda x: ~F.exists(F.array(ascii_lower(F.btrim(x, F.lit(BLANKS)))), lambda k: (F.length(k) >= min_length) & F.array_contains(F.col(hot), _hash(k))))
    joined = joined.withColumn(keys, F.when(F.col(hot).isNull(), F.col(lines)).otherwise(kept))
    whole = F.when(F.col(hot).isNull(), F.col(text_col)).otherwise(F.array_join(F.col(keys), "\n"))
    out = joined.withColumns({text_col: whole, "n_lines": F.size(lines).cast("long"), "n_dropped": (F.size(lines) - F.size(keys)).cast("long")})
    return out.select(*docs.columns, *(c for c in ("n_lines", "n_dropped") if c not in docs.columns))
