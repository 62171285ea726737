"""Inputs of the registered queries, made from the given tables: the graph, model answers, entity vectors, keyword lines. Each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgloom.operators import kg as K
from kgloom.session import table

GRAPH_SQL = """kg AS (
  SELECT c_name AS head, 'located in' AS relation, n_name AS tail FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION SELECT s_name, 'located in', n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION SELECT n_name, 'part of', r_name FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION SELECT c_name, 'in segment', c_mktsegment FROM customer
  UNION SELECT p_name, 'isa', p_type FROM part
  UNION SELECT p_name, 'made by', p_brand FROM part
  UNION SELECT s_name, 'supplies', p_name FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey
)"""

ANSWERS_SQL = """styled AS (
  SELECT c_custkey, c_custkey // 40 AS iteration, CASE c_custkey % 6
    WHEN 0 THEN '<''' || c_name || ''', ''in segment'', ''' || c_mktsegment || '''>'
    WHEN 1 THEN '(' || c_name || ', in segment, ' || c_mktsegment || ')'
    WHEN 2 THEN '[''' || c_name || ''', ''in_segment'', ''' || c_mktsegment || ''']'
    WHEN 3 THEN '<' || c_name || '，in segment，' || c_mktsegment || '>'
    WHEN 4 THEN '(''' || lower(c_name) || ''', ''in segment'', ''' || c_mktsegment || ''')'
    ELSE '<''' || c_name || ''', ''in segment'', ''' || c_mktsegment || ' x''>' END AS line
  FROM customer
), answers AS (SELECT iteration, string_agg(line, chr(10) ORDER BY c_custkey) AS text FROM styled GROUP BY iteration)"""

ENTITIES_SQL = """sized AS (SELECT count(*) AS n FROM embeddings), entities AS (
  SELECT 'e' || vec_id AS id, embedding AS vec, label, vec_id FROM embeddings
), edges AS (
  SELECT 'e' || vec_id AS head, 'r' || label AS relation, 'e' || ((vec_id * 7 + 3) % n) AS tail, vec_id AS line_no FROM embeddings, sized
), generated AS (
  SELECT 'e' || vec_id AS head, 'r' || (label + vec_id // 100) % 10 AS relation, 'e' || ((vec_id * 11 + 5) % n) AS tail, vec_id % 20 AS iteration FROM embeddings, sized
)"""

#: Every third generated triple comes again three iterations later, around the end to the first ones.
AGAIN_SQL = f"""{ENTITIES_SQL}, again AS (
  SELECT head, relation, tail, iteration FROM generated
  UNION ALL SELECT head, relation, tail, (iteration + 3) % 20 FROM generated WHERE CAST(substring(head, 2) AS BIGINT) % 3 = 0
)"""

KEYWORDS_SQL = """keyword_sets AS (
  SELECT item_id AS iteration, [split_part(text, ' ', 1), split_part(text, ' ', 2), split_part(text, ' ', 3)] AS keywords FROM benchmark
), queries AS (SELECT iteration AS query_id, array_to_string(keywords, ', ') AS query FROM keyword_sets)"""

CHUNKS_SQL = r"""chunks AS (
  SELECT doc_id, CAST(pos - 1 AS INTEGER) AS pos, regexp_replace(piece, '^\s+|\s+$', '', 'g') AS chunk FROM (
    SELECT doc_id, unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS pos FROM (
      SELECT doc_id, list_filter(string_split(coalesce(text, ''), '.'), lambda x: x <> '') AS pieces FROM documents))
)"""


def graph(spark: SparkSession, sf: str) -> DataFrame:
    return K.star_graph({n: table(spark, sf, n) for n in ("region", "nation", "customer", "supplier", "part", "lineitem")})


def answers(spark: SparkSession, sf: str) -> DataFrame:
    """Model answers of 40 triples an iteration, written in six ways."""
    c, m, k = F.col("c_name"), F.col("c_mktsegment"), F.col("c_custkey") % 6
    quoted = lambda a, x, r, y, b: F.concat(F.lit(f"{a}'"), x, F.lit(f"', '{r}', '"), y, F.lit(f"'{b}"))
    loose = lambda a, comma, b: F.concat(F.lit(a), c, F.lit(f"{comma}in segment{comma}"), m, F.lit(b))
    line = F.when(k == 0, quoted("<", c, "in segment", m, ">")).when(k == 1, loose("(", ", ", ")")).when(k == 2, quoted("[", c, "in_segment", m, "]"))
    line = line.when(k == 3, loose("<", "，", ">")).when(k == 4, quoted("(", F.lower(c), "in segment", m, ")")).otherwise(quoted("<", c, "in segment", F.concat(m, F.lit(" x")), ">"))
    rows = table(spark, sf, "customer").select(F.expr("c_custkey div 40").alias("iteration"), "c_custkey", line.alias("line"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", "line"))), lambda x: x["line"])
    return rows.groupBy("iteration").agg(F.array_join(lines, "\n").alias("text"))


def entities(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.concat(F.lit("e"), F.col("vec_id").cast("string")).alias("id"), F.col("embedding").alias("vec"), "label", "vec_id")


def edges(spark: SparkSession, sf: str) -> DataFrame:
    """A graph over the entities with vectors."""
    e = table(spark, sf, "embeddings")
    n = e.count()
    name = lambda x: F.concat(F.lit("e"), x.cast("string"))
    return e.select(name(F.col("vec_id")).alias("head"), F.concat(F.lit("r"), F.col("label").cast("string")).alias("relation"), name((F.col("vec_id") * 7 + 3) % n).alias("tail"), F.col("vec_id").alias("line_no"))


def generated(spark: SparkSession, sf: str) -> DataFrame:
    """Generated triples over the entities, one for each."""
    e = table(spark, sf, "embeddings")
    n = e.count()
    name = lambda x: F.concat(F.lit("e"), x.cast("string"))
    relation = F.concat(F.lit("r"), ((F.col("label") + F.expr("vec_id div 100")) % 10).cast("string"))
    return e.select(name(F.col("vec_id")).alias("head"), relation.alias("relation"), name((F.col("vec_id") * 11 + 5) % n).alias("tail"), (F.col("vec_id") % 20).alias("iteration"))


def again(spark: SparkSession, sf: str) -> DataFrame:
    """Generated triples, a third of them in two iterations."""
    g = generated(spark, sf)
    return g.unionByName(g.where("cast(substring(head, 2) as bigint) % 3 = 0").withColumn("iteration", (F.col("iteration") + 3) % 20))


def keyword_sets(spark: SparkSession, sf: str) -> DataFrame:
    """Three keywords of each benchmark item."""
    words = F.split("text", " ")
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("iteration"), F.array(*[F.coalesce(F.get(words, F.lit(i)), F.lit("")) for i in range(3)]).alias("keywords"))


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents")
