"""Chunks of articles and their ranking by BM25."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from kgloom.functions import text

#: Words that the Lucene-style tokenizer leaves out.
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "if", "in", "into", "is", "it", "no", "not", "of", "on", "or", "such", "that", "the",
    "their", "then", "there", "these", "they", "this", "to", "was", "will", "with",
)
K1, B, FLOOR = 1.5, 0.75, 0.25


def sentence_chunks(docs: DataFrame, id_col: str = "doc_id", body: Column | None = None) -> DataFrame:
    pieces = text.sentences(F.col("text") if body is None else body)
    return docs.select(id_col, F.posexplode(pieces).alias("pos", "chunk"))


def fixed_chunks(docs: DataFrame, size: int = 256, overlap: int = 50, id_col: str = "doc_id") -> DataFrame:
    """Character windows, and the last size characters of a text whose length no step divides, unless an earlier document or one of its own windows has just these."""
    step = size - overlap
    base = docs.select(id_col, F.coalesce("text", F.lit("")).alias("text"))
    whole = base.select(id_col, F.posexplode(text.windows(F.col("text"), size, overlap)).alias("pos", "chunk"))
    n = F.length("text")
    last = base.where(n % step != 0).select(id_col, F.greatest(F.lit(0), F.floor((n - size) / step) + 1).cast("int").alias("pos"), F.substring("text", F.greatest(F.lit(1), n - size + 1), F.lit(size)).alias("chunk"))
    known = whole.groupBy("chunk").agg(F.min(id_col).alias("_in_window"))
    tails = last.groupBy("chunk").agg(F.min(id_col).alias("_in_tail"))
    new = last.join(known, "chunk", "left").join(tails, "chunk").where((F.col("_in_window").isNull() | (F.col("_in_window") > F.col(id_col))) & (F.col("_in_tail") >= F.col(id_col)))
    return whole.union(new.select(id_col, "pos", "chunk"))


def lucene_tokens(x: Column) -> Column:
    """Lower-case runs of two or more letters, digits and underscores, without stop words."""
    return F.filter(F.regexp_extract_all(F.lower(x), F.lit(r"([\p{L}\p{N}_]{2,})"), F.lit(1)), lambda t: ~t.isin(*STOP_WORDS))


def space_tokens(x: Column) -> Column:
    """Pieces between single spaces, empty ones too."""
    return F.split(x, " ")


#: Fixed value: chunks whose terms a task counts.
CHUNKS_PER_TASK = 200_000


def _matches(chunks: DataFrame, queries: DataFrame, tokens, vocabulary: bool = False) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(term counts of chunks that share a term with a query, query terms with their counts, corpus sums, chunks that hold each term: a query's or, with vocabulary, any)."""
    tokenised = chunks.select("doc_id", "pos", tokens(F.col("chunk")).alias("tokens"))
    asked = queries.select("query_id", F.explode(tokens(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("times"))
    # one pass: the chunks of each term, and under a null term all chunks and their mean length
    none = F.array(F.lit(None).cast("string"))
    held = tokenised.select(F.size("tokens").alias("length"), F.explode(F.concat(F.coalesce(F.array_distinct("tokens"), F.array().cast("array<string>")), none)).alias("term"))
    if not vocabulary:
        sought = asked.select(F.col("term").alias("sought")).distinct().union(queries.sparkSession.range(1).select(F.lit(None).cast("string")))
        held = held.join(F.broadcast(sought), F.col("term").eqNullSafe(F.col("sought")), "left_semi")
    counted = held.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.avg(F.when(F.col("term").isNull(), F.col("length"))).alias("mean_length"))
    # only the null term has a length; both sides read the same columns, so the pass is made once
    corpus = counted.where("mean_length is not null").select(F.col("df").alias("n"), "mean_length")
    spread = tokenised.select("doc_id", "pos", F.size("tokens").alias("length"), F.explode("tokens").alias("term"))
    wanted = spread.join(F.broadcast(asked.select("term").distinct()), "term", "left_semi")
    # a chunk's terms stay in one task from here to its scores
    dealt = wanted.repartition(max(1, -(-chunks.count() // CHUNKS_PER_TASK)) * 4, "doc_id", "pos")
    return dealt.groupBy("doc_id", "pos", "length", "term").agg(F.count(F.lit(1)).alias("tf")), asked, corpus, counted.where("mean_length is null").select("term", "df")


def _ranked(scores: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "doc_id", "pos"))
    return scores.withColumn("rank", rank).where(F.col("rank") <= k)


def _saturated(tf: Column, length: Column, mean: Column) -> Column:
    return tf / (tf + K1 * (1 - B + B * length / mean))


def bm25_lucene(chunks: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, rank, doc_id, pos, score: the k best chunks of each query by Lucene's BM25; ties by document and position.

    chunks: doc_id, pos, chunk; queries: query_id, query. Only terms that a query has are counted.
    """
    tf, asked, corpus, df = _matches(chunks, queries, lucene_tokens)
    idf = df.join(F.broadcast(corpus)).select("term", "mean_length", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    part = F.col("times") * F.col("idf") * _saturated(F.col("tf"), F.col("length"), F.col("mean_length"))
    scores = tf.join(F.broadcast(idf.join(asked, "term")), "term").groupBy("query_id", "doc_id", "pos").agg(F.round(F.sum(part), 6).alias("score"))
    return _ranked(scores, k).select("query_id", "rank", "doc_id", "pos", "score")


def bm25_okapi(chunks: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """As bm25_lucene, by Okapi's BM25 over pieces between spaces: negative idf becomes a quarter of the vocabulary's mean idf, and chunks without a common term, which score 0, fill up to k."""
    tf, asked, corpus, df = _matches(chunks, queries, space_tokens, vocabulary=True)
    raw = F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    vocabulary = df.join(F.broadcast(corpus)).select("term", "mean_length", raw.alias("raw"))
    mean_idf = vocabulary.agg(F.avg("raw").alias("mean_idf"))
    idf = vocabulary.join(asked, "term").join(F.broadcast(mean_idf)).withColumn("idf", F.when(F.col("raw") < 0, FLOOR * F.col("mean_idf")).otherwise(F.col("raw")))
    part = F.col("times") * F.col("idf") * _saturated(F.col("tf"), F.col("length"), F.col("mean_length")) * (K1 + 1)
    scores = tf.join(F.broadcast(idf), "term").groupBy("query_id", "doc_id", "pos").agg(F.round(F.sum(part), 6).alias("score"))
    best = _ranked(scores, k).select("query_id", "doc_id", "pos", "score")
    # a query with m < k matches lacks k - m; the first 2k chunks hold as many that it doesn't match
    first = chunks.select("doc_id", "pos").orderBy("doc_id", "pos").limit(2 * k).agg(F.collect_list(F.struct("doc_id", "pos")).alias("first"))
    filling = queries.select("query_id").join(F.broadcast(first)).select("query_id", F.inline("first")).withColumn("score", F.lit(None).cast("double"))
    both = best.unionByName(filling).groupBy("query_id", "doc_id", "pos").agg(F.coalesce(F.max("score"), F.lit(0.0)).alias("score"))
    return _ranked(both, k).select("query_id", "rank", "doc_id", "pos", "score")


def bm25_lucene_own(chunks: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """As bm25_lucene where each query has a corpus of its own: chunks have a query_id, and counts and lengths are those of its chunks."""
    tokenised = chunks.select("query_id", "doc_id", "pos", lucene_tokens(F.col("chunk")).alias("tokens"))
    asked = queries.select("query_id", F.explode(lucene_tokens(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("times"))
    corpus = tokenised.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("tokens")).alias("mean_length"))
    spread = tokenised.select("query_id", "doc_id", "pos", F.size("tokens").alias("length"), F.explode("tokens").alias("term")).join(asked, ["query_id", "term"])
    tf = spread.groupBy("query_id", "term", "times", "doc_id", "pos", "length").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = F.col("times") * idf * _saturated(F.col("tf"), F.col("length"), F.col("mean_length"))
    scores = tf.join(df, ["query_id", "term"]).join(corpus, "query_id").groupBy("query_id", "doc_id", "pos").agg(F.round(F.sum(part), 6).alias("score"))
    return _ranked(scores, k).select("query_id", "rank", "doc_id", "pos", "score")


def bm25_okapi_own(chunks: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """As bm25_okapi where each query has a corpus of its own (see bm25_lucene_own)."""
    tokenised = chunks.select("query_id", "doc_id", "pos", space_tokens(F.col("chunk")).alias("tokens"))
    asked = queries.select("query_id", F.explode(space_tokens(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("times"))
    corpus = tokenised.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("tokens")).alias("mean_length"))
    df = tokenised.select("query_id", F.explode(F.array_distinct("tokens")).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("df"))
    raw = df.join(corpus, "query_id").select("query_id", "term", "mean_length", (F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw"))
    mean = raw.groupBy("query_id").agg(F.avg("raw").alias("mean_idf"))
    idf = raw.join(asked, ["query_id", "term"]).join(mean, "query_id").withColumn("idf", F.when(F.col("raw") < 0, FLOOR * F.col("mean_idf")).otherwise(F.col("raw")))
    spread = tokenised.select("query_id", "doc_id", "pos", F.size("tokens").alias("length"), F.explode("tokens").alias("term")).join(asked.select("query_id", "term"), ["query_id", "term"], "left_semi")
    tf = spread.groupBy("query_id", "term", "doc_id", "pos", "length").agg(F.count(F.lit(1)).alias("tf"))
    part = F.col("times") * F.col("idf") * _saturated(F.col("tf"), F.col("length"), F.col("mean_length")) * (K1 + 1)
    scores = tf.join(idf, ["query_id", "term"]).groupBy("query_id", "doc_id", "pos").agg(F.round(F.sum(part), 6).alias("score"))
    # chunks without a common term score 0: every chunk of a query's corpus is ranked
    every = chunks.select("query_id", "doc_id", "pos").join(queries.select("query_id"), "query_id", "left_semi").join(scores, ["query_id", "doc_id", "pos"], "left")
    return _ranked(every.withColumn("score", F.coalesce("score", F.lit(0.0))), k).select("query_id", "rank", "doc_id", "pos", "score")


def dense_own(chunks: DataFrame, queries: DataFrame, k: int, encode) -> DataFrame:
    """As dense where each query has a corpus of its own: chunks meet their query alone."""
    asked = queries.select("query_id", encode(F.col("query")).alias("_asked"))
    product = F.aggregate(F.zip_with("vec", "_asked", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    scores = chunks.select("query_id", "doc_id", "pos", encode(F.col("chunk")).alias("vec")).join(asked, "query_id").select("query_id", "doc_id", "pos", F.round(product, 6).alias("score"))
    return _ranked(scores, k).select("query_id", "rank", "doc_id", "pos", "score")


#: Retrieval methods by name.
METHODS = {"bm25s": bm25_lucene, "rankbm25": bm25_okapi}
OWN_METHODS = {"bm25s": bm25_lucene_own, "rankbm25": bm25_okapi_own}


def dense(chunks: DataFrame, queries: DataFrame, k: int, encode) -> DataFrame:
    """query_id, rank, doc_id, pos, score: the chunks of greatest product with a query's vector; encode gives a text column's vectors."""
    from kgloom.operators import knn

    where = F.struct("doc_id", "pos")
    vectors = chunks.select(F.to_json(where).alias("id"), encode(F.col("chunk")).alias("vec"))
    asked = queries.select(F.col("query_id").alias("id"), encode(F.col("query")).alias("vec"))
    found = knn.nearest(asked, vectors, k, "dot")
    at = F.from_json("candidate", chunks.select(where.alias("s")).schema["s"].dataType)
    return found.select(F.col("query").alias("query_id"), "rank", at.alias("at"), F.col("dist").alias("score")).select("query_id", "rank", "at.doc_id", "at.pos", "score")


#: Names of the dense method, which differ in batches and devices only.
DENSE = ("bge", "bge_cpu", "bge_nobatch")


def _by_name(method: str, k_and_rest: tuple, methods: dict, by_vectors, encode):
    if method in DENSE:
        if encode is None:
            raise ValueError(f"{method!r} needs an encoder")
        return by_vectors(*k_and_rest, encode)
    if method not in methods:
        raise ValueError(f"no retrieval method {method!r}; there are {', '.join((*METHODS, *DENSE))}")
    return methods[method](*k_and_rest)


def retrieve(method: str, chunks: DataFrame, queries: DataFrame, k: int, encode=None) -> DataFrame:
    """A retrieval method by name; dense ones need an encoder, a function from a text column to vectors (knn.encoder)."""
    return _by_name(method, (chunks, queries, k), METHODS, dense, encode)


def retrieve_own(method: str, chunks: DataFrame, queries: DataFrame, k: int, encode=None) -> DataFrame:
    """As retrieve where chunks have a query_id: each query's corpus is its own chunks."""
    return _by_name(method, (chunks, queries, k), OWN_METHODS, dense_own, encode)
