"""The registered queries of the training-data operators, each over its whole table, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kgloom.llm import bpe, decontamination, jaccard_join, kd_sharding, language_id, line_dedup, lm_scoring, periodic_runs, quality, secret_scan, token_transducer, topk_search, weighted_kmeans
from kgloom.llm.common import crc_mod, read

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def _query(f):
    QUERIES[f.__name__] = f
    return f


@_query
def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan_secrets(read(spark, sf_dir, "documents").select("doc_id", "text"))
    of = lambda *kinds: F.filter("secrets", lambda s: s["kind"].isin(*kinds))
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")]
    base = F.sha2(secret_scan.span_list(of("assign", "access", "hex")), 256).alias("base_sha256")
    return found.select("doc_id", *counts, base, secret_scan.span_list(F.col("secrets")).alias("spans"))


@_query
def op2_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk_search.exact_topk(vectors, vectors.where("vec_id % 20 = 0"), k=20)


ORACLE_SQL["op2_exact_topk"] = """
WITH usable AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM usable q JOIN usable c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
  WHERE q.vec_id % 20 = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 20
"""


@_query
def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar_documents(read(spark, sf_dir, "documents").select("doc_id", "text"), percent=75, size=5)


@_query
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = crc_mod(F.col("doc_id"), 4) == 2
    net = language_id.fit(docs.where(~held_out))
    return language_id.label_documents(docs.select("doc_id", held_out.alias("held_out"), "text"), net, keep_text=False)


@_query
def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return lm_scoring.score_documents(docs, crc_mod(F.col("doc_id"), 7) == 2)


@_query
def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    return quality.score_quality(docs, read(spark, sf_dir, "labels").select("doc_id", "quality"))


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    """Where the public rank file lies on the driver."""
    import public_tokenizers

    return public_tokenizers.path(name)


@_query
def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode_documents(docs, vocabulary_path(), ("n_tokens", "ids_sha256", "decoded_sha256"))


@_query
def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontamination.find_leaks(docs, read(spark, sf_dir, "benchmark").select("item_id", "text"), keep_text=False)
    return found.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.item_id", "leak.errors", F.col("leak.end").alias("end_pos"))


@_query
def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    return kd_sharding.shard_by_bytes(docs, shards=8).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


@_query
def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    kept = line_dedup.drop_frequent_lines(docs, min_docs=10, min_length=1)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


ORACLE_SQL["op10_line_dedup"] = r"""
WITH lines AS (
  SELECT d.row_id, d.doc_id, u.pos, u.line,
         translate(trim(u.line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT row_number() OVER () AS row_id, doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents) d,
       LATERAL (SELECT unnest(d.parts) AS line, generate_subscripts(d.parts, 1) AS pos) u
), hot AS (
  SELECT key FROM (SELECT DISTINCT key, doc_id FROM lines WHERE length(key) >= 1) GROUP BY key HAVING count(*) >= 10
), marked AS (
  SELECT l.*, h.key IS NOT NULL AS gone FROM lines l LEFT JOIN hot h ON l.key = h.key
)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY row_id
"""


@_query
def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return token_transducer.count_tokens(docs, vocabulary_path("byte_bpe_50k.json"), limit=512)


@_query
def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return weighted_kmeans.cluster_vectors(vectors).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _lloyd_sql(dim: int = 64, scale: int = 1024, clusters: int = 8, rounds: int = 10, seed: int = 3) -> str:
    """The rounds one after the other, vectors as lists, a centroid's components summed by position."""
    apart = f"CAST(list_sum(list_transform(range(1, {dim + 1}), lambda i: (k.v[i] - c.v[i]) * (k.v[i] - c.v[i]))) AS BIGINT)"
    steps = [f"""WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS row_id, vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c0 AS MATERIALIZED (
  SELECT CAST(row_number() OVER (ORDER BY h NULLS LAST, v) - 1 AS INTEGER) AS cluster, v
  FROM (SELECT sha256('{seed}:' || CAST(vec_id AS VARCHAR)) AS h, v FROM kept ORDER BY h NULLS LAST, v LIMIT {clusters})
)"""]  # fmt: skip
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (
  SELECT row_id, any_value(vec_id) AS vec_id, any_value(v) AS v, arg_min(cluster, far * {clusters} + cluster) AS cluster, min(far) AS distance
  FROM (SELECT k.row_id, k.vec_id, k.v, c.cluster, {apart} AS far FROM kept k CROSS JOIN c{r} c) GROUP BY row_id
)""")
        if r < rounds:
            steps.append(f"""c{r + 1} AS MATERIALIZED (
  SELECT o.cluster, coalesce(n.v, o.v) AS v FROM c{r} o LEFT JOIN (
    SELECT cluster, list(CAST((s - ((s % n) + n) % n) / n AS BIGINT) ORDER BY i) AS v FROM (
      SELECT cluster, i, sum(x) AS s, count(*) AS n FROM (SELECT cluster, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{r}) GROUP BY cluster, i
    ) GROUP BY cluster
  ) n ON o.cluster = n.cluster
)""")
    return ",\n".join(steps) + f"""
SELECT a.vec_id, a.cluster, a.distance, CAST(sum(a.distance) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia,
       CAST(sum(a.distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON a.cluster = c.cluster
"""


ORACLE_SQL["op12_centroid_clustering"] = _lloyd_sql()


def planted_periods(doc_id: Column, text: Column) -> Column:
    """The text; where crc32(id) % 10 = 0, with its words from word a on repeated with period p. A null id counts as the empty text."""
    h = F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))
    g = F.floor(h / 10)

    def rewritten(words: Column) -> Column:
        n = F.size(words)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        word = lambda i: F.get(words, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))
        return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0), n - 1), word), " ")).otherwise("")

    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"[ \t\n\x0B\f\r]+"), lambda w: w != "")
    return F.when(h % 10 == 0, F.element_at(F.transform(F.array(words), rewritten), 1)).otherwise(text)


@_query
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = periodic_runs.find_runs(docs.select("doc_id", planted_periods(F.col("doc_id"), F.col("text")).alias("text")), min_length=24, min_exponent=3)
    best = F.aggregate("runs", F.get("runs", 0), lambda top, r: F.when(r["length"] * top["period"] > top["length"] * r["period"], r).otherwise(top))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    digests = F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256")
    exponent = F.expr("1000 * best.length div best.period").alias("exponent_milli")
    return found.withColumn("best", best).select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", exponent, *digests)
