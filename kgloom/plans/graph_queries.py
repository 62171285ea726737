"""Queries on the graph: building, masking, cleaning, statistics, indexes, keyword files."""

from __future__ import annotations

from pyspark.sql import functions as F

from kgloom.functions import text
from kgloom.operators import kg as K
from kgloom.plans import fixtures as X
from kgloom.plans.registry import query
from kgloom.session import table
from kgloom.sources import readers

G = f"WITH {X.GRAPH_SQL} "


@query(G + "SELECT * FROM kg")
def kg_from_star(spark, sf):
    return X.graph(spark, sf)


@query(G + "SELECT head AS entity FROM kg UNION SELECT tail FROM kg")
def kg_entities(spark, sf):
    return K.entities(X.graph(spark, sf))


@query(G + "SELECT DISTINCT relation FROM kg")
def kg_relations(spark, sf):
    return K.relations(X.graph(spark, sf))


@query(G + "SELECT 'hr' AS kind, head AS first, relation AS second FROM kg UNION SELECT 'rt', relation, tail FROM kg UNION SELECT 'ht', head, tail FROM kg")
def kg_keyword_pairs(spark, sf):
    return K.keyword_pairs(X.graph(spark, sf))


@query(G + "SELECT entity, count(*) AS n FROM (SELECT head AS entity FROM kg UNION ALL SELECT tail FROM kg) GROUP BY entity ORDER BY n DESC, entity LIMIT 20")
def kg_top_entities(spark, sf):
    return K.top_entities(X.graph(spark, sf), 20)


MASKED = G + """, keywords AS (SELECT n_name AS keyword FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' UNION ALL SELECT 'part of'),
masked AS (SELECT * FROM kg WHERE head IN (SELECT keyword FROM keywords) OR relation IN (SELECT keyword FROM keywords) OR tail IN (SELECT keyword FROM keywords)) """  # fmt: skip


def _mask(spark, sf):
    asia = table(spark, sf, "nation").join(table(spark, sf, "region").where("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("keyword"))
    return K.mask(X.graph(spark, sf), asia.union(spark.createDataFrame([("part of",)], "keyword string")))


@query(MASKED + "SELECT * FROM masked")
def mask_triples(spark, sf):
    return _mask(spark, sf)


@query(MASKED + "SELECT head AS entity FROM masked UNION SELECT tail FROM masked")
def mask_entities(spark, sf):
    return K.entities(_mask(spark, sf))


@query(MASKED + "SELECT DISTINCT relation FROM masked")
def mask_relations(spark, sf):
    return K.relations(_mask(spark, sf))


@query(G + "SELECT * FROM kg WHERE relation IN ('located in', 'part of')")
def filter_by_relations(spark, sf):
    return K.with_relations(X.graph(spark, sf), spark.createDataFrame([("located in",), ("part of",)], "relation string"))


@query(G + r"""SELECT * FROM kg WHERE relation <> 'supplies' AND greatest(length(head), length(relation), length(tail)) <= 500
AND NOT regexp_matches(head, '^\d+(\.\d+)?$') AND NOT regexp_matches(relation, '^\d+(\.\d+)?$') AND NOT regexp_matches(tail, '^\d+(\.\d+)?$')
AND NOT regexp_matches(head || relation || tail, '[^\x00-\x7F]')""")
def kg_clean_rules(spark, sf):
    return K.cleaned(X.graph(spark, sf), spark.createDataFrame([("supplies",)], "relation string"))


@query(G + """, classes AS (SELECT p_name AS entity, p_type AS class FROM part UNION ALL SELECT n_name, 'nation' FROM nation UNION ALL SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey),
banned AS (SELECT entity FROM classes WHERE class IN ('ASIA', 'AFRICA') OR class LIKE '%BRASS')
SELECT * FROM kg WHERE head NOT IN (SELECT entity FROM banned) AND tail NOT IN (SELECT entity FROM banned) AND relation <> 'made by'""")
def kg_without_classes(spark, sf):
    nation, region, part = (table(spark, sf, n) for n in ("nation", "region", "part"))
    regions = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "r_name")
    classes = part.select(F.col("p_name").alias("entity"), F.col("p_type").alias("class")).union(nation.select("n_name", F.lit("nation"))).union(regions)
    excluded = part.where("p_type like '%BRASS'").select(F.col("p_type").alias("class")).distinct().union(spark.createDataFrame([("ASIA",), ("AFRICA",)], "class string"))
    return K.cleaned(X.graph(spark, sf), spark.createDataFrame([("made by",)], "relation string"), classes=classes, excluded_classes=excluded).where("relation <> 'made by'")


@query(G + "SELECT relation, count(*) AS n FROM kg GROUP BY relation ORDER BY n DESC, relation LIMIT 5")
def kg_top_relations(spark, sf):
    return K.top_relations(X.graph(spark, sf), 5)


@query(G + """, degree AS (SELECT entity, count(*) AS n FROM (SELECT head AS entity FROM kg UNION ALL SELECT tail FROM kg) GROUP BY entity),
few AS (SELECT relation FROM kg GROUP BY relation ORDER BY count(*) DESC, relation LIMIT 4), scored AS (SELECT kg.*, a.n + b.n AS weight FROM kg JOIN few USING (relation) JOIN degree a ON a.entity = head JOIN degree b ON b.entity = tail)
SELECT relation, CAST(rank AS INTEGER) AS rank, head, tail, weight FROM (SELECT *, row_number() OVER (PARTITION BY relation ORDER BY weight DESC, head, tail) AS rank FROM scored) WHERE rank <= 5""")
def kg_example_triples(spark, sf):
    return K.example_triples(X.graph(spark, sf), 4, 5)


@query(G + """, per AS (SELECT entity, count(DISTINCT relation) AS n_relations FROM (SELECT head AS entity, relation FROM kg UNION ALL SELECT tail, relation FROM kg) GROUP BY entity)
SELECT i.n_relations, coalesce(n_entities, 0) AS n_entities, round(100.0 * coalesce(n_entities, 0) / total, 6) AS percent
FROM (SELECT unnest(range(1, 20)) AS n_relations) i LEFT JOIN (SELECT n_relations, count(*) AS n_entities FROM per GROUP BY 1) c USING (n_relations), (SELECT count(*) AS total FROM per)""")
def entity_relation_histogram(spark, sf):
    return K.statistics(X.graph(spark, sf))


LINES = "WITH lines AS (SELECT c_name AS head, c_mktsegment AS relation, 'NATION_' || c_nationkey AS tail, c_custkey AS line_no FROM customer) "


def _lines(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_name").alias("head"), F.col("c_mktsegment").alias("relation"), F.concat(F.lit("NATION_"), F.col("c_nationkey").cast("string")).alias("tail"), F.col("c_custkey").alias("line_no"))


@query(LINES + "SELECT row_number() OVER (ORDER BY seen) - 1 AS id, name FROM (SELECT name, min(seen) AS seen FROM (SELECT head AS name, line_no * 2 AS seen FROM lines UNION ALL SELECT tail, line_no * 2 + 1 FROM lines) GROUP BY name)")
def entity_index(spark, sf):
    return K.first_seen_index(_lines(spark, sf), ("head", "tail"))


@query(LINES + "SELECT row_number() OVER (ORDER BY seen) - 1 AS id, name FROM (SELECT relation AS name, min(line_no) AS seen FROM lines GROUP BY relation)")
def relation_index(spark, sf):
    return K.first_seen_index(_lines(spark, sf), ("relation",))


@query("SELECT item_id, CAST(ntile(10) OVER (ORDER BY item_id) AS INTEGER) AS part FROM benchmark")
def split_keywords(spark, sf):
    return K.split_file(table(spark, sf, "benchmark").select("item_id"), 10, "item_id")


@query("""WITH lines AS (SELECT row_number() OVER (ORDER BY item_id) - 1 AS index, split_part(text, ' ', 1) || chr(9) || split_part(text, ' ', 2) || ', ' || split_part(text, ' ', 3) AS line FROM benchmark)
SELECT o.iteration, string_split(replace(line, chr(9), ', '), ', ') AS keywords FROM (SELECT o_orderkey AS iteration FROM orders) o JOIN lines ON index = o.iteration % (SELECT count(*) FROM benchmark)""")
def indexed_keywords(spark, sf):
    words = F.split("text", " ")
    lines = table(spark, sf, "benchmark").select(F.col("item_id").alias("line_no"), F.concat(words[0], F.lit("\t"), F.get(words, F.lit(1)), F.lit(", "), F.get(words, F.lit(2))).alias("value"))
    return readers.indexed_keywords(lines, table(spark, sf, "orders").select(F.col("o_orderkey").alias("iteration")))


@query(G + "SELECT * FROM kg WHERE relation IN ('isa', 'made by', 'part of')")
def integrate_results(spark, sf):
    kg = X.graph(spark, sf)
    return K.integrated(kg.where("relation in ('isa', 'made by')"), kg.where("relation in ('made by', 'part of')").select("tail", "head", "relation"))


@query(G + """, aliases AS (SELECT p_brand AS alias, 'Brand ' || min(p_type) AS canonical FROM part GROUP BY p_brand), renamed AS (
SELECT coalesce(a.canonical, head) AS head, relation, coalesce(b.canonical, tail) AS tail FROM kg LEFT JOIN aliases a ON head = a.alias LEFT JOIN aliases b ON tail = b.alias)
SELECT DISTINCT * FROM renamed WHERE head <> tail""")
def canonical_triples(spark, sf):
    aliases = table(spark, sf, "part").groupBy(F.col("p_brand").alias("alias")).agg(F.concat(F.lit("Brand "), F.min("p_type")).alias("canonical"))
    return K.canonical(X.graph(spark, sf), aliases)


@query(LINES + "SELECT trim(replace(head, '#', '_')) || ', ' || relation || ', ' || tail AS value, min(line_no) AS first_line FROM lines GROUP BY ALL")
def accumulated_triples(spark, sf):
    lines = _lines(spark, sf).withColumn("head", text.strip(F.replace("head", F.lit("#"), F.lit("_"))))
    first = K.first_seen(lines, ["head", "relation", "tail"], ["line_no"])
    return first.select(text.triple_line(F.col("head"), F.col("relation"), F.col("tail")).alias("value"), F.col("first.line_no").alias("first_line"))


@query(r"""SELECT regexp_replace(replace(replace(line, '''', ''), '"', ''), '^\s+|\s+$', '', 'g') AS line, c_name AS head, c_mktsegment AS relation, 'N' || c_nationkey AS tail
FROM (SELECT *, ' <''' || c_name || ''', "' || c_mktsegment || '", N' || c_nationkey || '>' AS line FROM customer)""")
def raw_triple_lines(spark, sf):
    c = table(spark, sf, "customer")
    return readers.raw_triples(c.select(F.concat(F.lit(" <'"), "c_name", F.lit("', \""), "c_mktsegment", F.lit("\", N"), F.col("c_nationkey").cast("string"), F.lit(">")).alias("value")))


@query("SELECT c_name AS head, 'in segment' AS relation, c_mktsegment AS tail FROM customer UNION ALL SELECT c_mktsegment, 'has', c_name FROM customer")
def quoted_triple_lines(spark, sf):
    c = table(spark, sf, "customer")
    return readers.quoted_triples(c.select(F.concat(F.lit("<' "), "c_name", F.lit("' , 'in segment','"), "c_mktsegment", F.lit("'] x ('"), "c_mktsegment", F.lit("', 'has', '"), "c_name", F.lit("')")).alias("value")))
