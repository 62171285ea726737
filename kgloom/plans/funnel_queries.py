"""Queries on vectors, candidates, the evaluation funnel, metrics and state."""

from __future__ import annotations

from pyspark.sql import functions as F

from kgloom.functions import text
from kgloom.operators import funnel, knn, match, metrics, state
from kgloom.operators.judge import ExpressionJudge
from kgloom.plans import fixtures as X
from kgloom.plans.registry import query
from kgloom.session import table

E = f"WITH {X.ENTITIES_SQL}"
L2 = "sqrt(list_sum(list_transform(range(1, len(q.vec) + 1), lambda i: pow(CAST(q.vec[i] AS DOUBLE) - CAST(c.vec[i] AS DOUBLE), 2))))"
DOT = "list_sum(list_transform(range(1, len({0}.vec) + 1), lambda i: CAST({0}.vec[i] AS DOUBLE) * CAST({1}.vec[i] AS DOUBLE)))"
COSINE = f"1 - {DOT.format('q', 'c')} / (sqrt({DOT.format('q', 'q')}) * sqrt({DOT.format('c', 'c')}))"


def nearest_sql(distance: str, k: int, queries: str = "q.vec_id % 100 = 0", candidates: str = "c.vec_id <> q.vec_id", descending: str = "") -> str:
    return f"""SELECT query, CAST(rank AS INTEGER) AS rank, candidate, dist FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY dist {descending}, candidate) AS rank FROM (
SELECT q.id AS query, c.id AS candidate, round({distance}, 6) AS dist FROM entities q, entities c WHERE {queries} AND {candidates})) WHERE rank <= {k}"""


def _asked(spark, sf):
    """The query set, and all rows."""
    e = X.entities(spark, sf)
    return e.where("vec_id % 100 = 0"), e


@query(f"{E} {nearest_sql(DOT.format('q', 'c'), 10, candidates='true', descending='DESC')}")
def dense_topk(spark, sf):
    return knn.nearest(*_asked(spark, sf), 10, "dot")


@query(f"{E} {nearest_sql(L2, 6)}")
def knn_entities_k6(spark, sf):
    return knn.nearest(*_asked(spark, sf), 6, own=False)


@query(f"{E} {nearest_sql(L2, 1)}")
def nearest_entity(spark, sf):
    return knn.nearest(*_asked(spark, sf), 1, own=False)


@query(f"{E}, near AS ({nearest_sql(L2, 6)}) SELECT query, candidate, round({COSINE}, 6) AS distance FROM near n JOIN entities q ON n.query = q.id JOIN entities c ON n.candidate = c.id")
def cosine_distance(spark, sf):
    near, e = knn.nearest(*_asked(spark, sf), 6, own=False), X.entities(spark, sf)
    both = near.join(e.select(F.col("id").alias("query"), F.col("vec").alias("a")), "query").join(e.select(F.col("id").alias("candidate"), F.col("vec").alias("b")), "candidate")
    return both.select("query", "candidate", F.round(knn.cosine_distance(F.col("a"), F.col("b")), 6).alias("distance"))


@query(f"{E} SELECT q.id AS \"left\", c.id AS \"right\", round({COSINE}, 6) + 0 AS dist FROM entities q, entities c WHERE q.vec_id % 100 = 0")
def pairwise_cosine(spark, sf):
    pairs = knn.pairwise_cosine(*_asked(spark, sf))
    return pairs.withColumn("dist", F.col("dist") + 0.0)


#: Ends of the generated triples against all other entities; a candidate is confirmed if its label is the query's or the next.
CANDIDATES = f"""{E}, wanted AS (SELECT head AS id FROM generated UNION SELECT tail FROM generated),
asked AS (SELECT e.* FROM entities e JOIN wanted USING (id)),
candidates AS (SELECT query, CAST(rank AS INTEGER) AS rank, candidate, dist FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY dist, candidate) AS rank FROM (
SELECT q.id AS query, c.id AS candidate, round({L2}, 6) AS dist FROM asked q, entities c)) WHERE rank <= 6),
confirmed AS (SELECT c.* FROM candidates c JOIN entities a ON query = a.id JOIN entities b ON candidate = b.id WHERE (b.label - a.label + 10) % 10 <= 1)"""


def _candidates(spark, sf):
    e = X.entities(spark, sf)
    wanted = X.generated(spark, sf).select(F.explode(F.array("head", "tail")).alias("id")).distinct()
    return knn.nearest(e.join(wanted, "id", "left_semi"), e, 6)


def _entity_judge(spark, sf):
    """Answers by the labels of both entities."""
    labels = X.entities(spark, sf).select("id", "label")

    def judge(df):
        a, b = labels.select(F.col("id").alias("query"), F.col("label").alias("_a")), labels.select(F.col("id").alias("candidate"), F.col("label").alias("_b"))
        return ExpressionJudge("(_b - _a + 10) % 10 <= 1")(df.join(a, "query").join(b, "candidate"))

    return judge


#: Judges of pairs, by the names' lengths, the relations and the numbers in names; their SQL beside them.
SIMILAR, EQUIVALENT, EXACT = "length(gen_head) >= length(head) - 1", "right(relation, 1) <= right(gen_relation, 1)", "right(head, 1) <> right(gen_tail, 1)"
CORRECT = "right(tail, 1) in ('0', '1', '2', '3', '4', '5', '7')"


def _judges(spark, sf):
    return {"entity": _entity_judge(spark, sf), "similar": ExpressionJudge(SIMILAR), "equivalent": ExpressionJudge(EQUIVALENT), "exact": ExpressionJudge(EXACT), "correct": ExpressionJudge(CORRECT)}


def pairs_sql(test: str) -> str:
    return f"""{CANDIDATES}, pool AS (SELECT DISTINCT g.head AS gen_head, g.relation AS gen_relation, g.tail AS gen_tail, c.candidate FROM generated g JOIN confirmed c ON c.query IN (g.head, g.tail)),
own AS (SELECT DISTINCT gen_head, gen_relation, gen_tail FROM pool),
pairs AS (SELECT gen_head, gen_relation, gen_tail, e.head, e.relation, e.tail FROM own o, edges e WHERE
  EXISTS (SELECT 1 FROM pool p WHERE p.gen_head = o.gen_head AND p.gen_relation = o.gen_relation AND p.gen_tail = o.gen_tail AND p.candidate = e.head) {test}
  EXISTS (SELECT 1 FROM pool p WHERE p.gen_head = o.gen_head AND p.gen_relation = o.gen_relation AND p.gen_tail = o.gen_tail AND p.candidate = e.tail))"""


def _pairs(spark, sf, strictness):
    confirmed = funnel.agreed(_candidates(spark, sf), _entity_judge(spark, sf))
    return match.similar_triples(X.generated(spark, sf), confirmed, X.edges(spark, sf).drop("line_no"), strictness)


@query(pairs_sql("AND") + " SELECT * FROM pairs")
def similar_triples_strict(spark, sf):
    return _pairs(spark, sf, "strict")


@query(pairs_sql("OR") + " SELECT * FROM pairs")
def similar_triples_lenient(spark, sf):
    return _pairs(spark, sf, "lenient")


@query(f"""{CANDIDATES}, near AS (SELECT query, candidate FROM candidates WHERE rank = 2)
SELECT head, relation, tail, kg_line FROM (SELECT g.*, l.kg_line, row_number() OVER (PARTITION BY g.head, g.relation, g.tail ORDER BY l.line_no) AS r
FROM (SELECT DISTINCT head, relation, tail FROM generated) g JOIN near a ON a.query = g.head JOIN near b ON b.query = g.tail
JOIN (SELECT line_no, head || ', ' || relation || ', ' || tail AS kg_line FROM edges) l ON contains(kg_line, a.candidate) AND contains(kg_line, b.candidate)) WHERE r = 1""")
def substring_similar(spark, sf):
    near = _candidates(spark, sf).where("rank = 2").select("query", "candidate")
    return match.containing(X.generated(spark, sf).drop("iteration"), near, X.edges(spark, sf))


FUNNEL = pairs_sql("OR") + f""", alike AS (SELECT * FROM pairs WHERE {SIMILAR}), equivalent AS (SELECT * FROM alike WHERE {EQUIVALENT}), exact AS (SELECT * FROM equivalent WHERE {EXACT}),
correct AS (SELECT head, relation, tail FROM generated WHERE {CORRECT}), keys AS (SELECT DISTINCT gen_head AS head, gen_relation AS relation, gen_tail AS tail FROM exact),
expanded AS (SELECT c.* FROM correct c WHERE NOT EXISTS (SELECT 1 FROM keys k WHERE k.head = c.head AND k.relation = c.relation AND k.tail = c.tail))"""


def _funnel(spark, sf):
    return funnel.run(X.generated(spark, sf).drop("iteration"), _candidates(spark, sf), X.edges(spark, sf).drop("line_no"), _judges(spark, sf), "lenient")


@query(FUNNEL + """ SELECT 'confirmed' AS stage, count(*) AS n FROM confirmed UNION ALL SELECT 'pairs', count(*) FROM pairs UNION ALL SELECT 'similar', count(*) FROM alike UNION ALL SELECT 'equivalent', count(*) FROM equivalent
UNION ALL SELECT 'exact', count(*) FROM exact UNION ALL SELECT 'correct', count(*) FROM correct UNION ALL SELECT 'wrong', (SELECT count(*) FROM generated) - (SELECT count(*) FROM correct) UNION ALL SELECT 'expanded', count(*) FROM expanded""")
def funnel_counts(spark, sf):
    f = _funnel(spark, sf)
    stages = {"confirmed": f.confirmed, "pairs": f.pairs, "similar": f.similar, "equivalent": f.equivalent, "exact": f.exact, "correct": f.correct, "wrong": f.wrong, "expanded": f.new_beyond_exact}
    out = None
    for name, df in stages.items():
        part = df.agg(F.lit(name).alias("stage"), F.count(F.lit(1)).alias("n"))
        out = part if out is None else out.union(part)
    return out


@query(FUNNEL + " SELECT * FROM expanded")
def expanded_knowledge(spark, sf):
    return _funnel(spark, sf).new_beyond_exact


#: The conflict judge finds every similar triple in conflict, and asks for the generated one's removal where its head ends in an even digit.
CONFLICT = FUNNEL + """, grouped AS (SELECT DISTINCT gen_head AS head, gen_relation AS relation, gen_tail AS tail FROM alike), removal AS (SELECT * FROM grouped WHERE CAST(right(head, 3) AS INTEGER) // 100 % 2 = 0)"""


def _conflict_judge():
    own = text.triple_text(*[F.col(c) for c in funnel.GEN])
    even = F.expr("cast(regexp_replace(right(gen_head, 3), '[^0-9]', '') as int) div 100 % 2 = 0")
    answer = F.concat(F.lit("Conflicting Triples:\n"), F.col("triples"), F.lit("\nRemoval Triples: "), F.when(even, own).otherwise(F.lit("None")), F.lit("\n"))
    return ExpressionJudge(answer)


CONFLICT = CONFLICT.replace("CAST(right(head, 3) AS INTEGER)", "CAST(regexp_replace(right(head, 3), '[^0-9]', '', 'g') AS INTEGER)")


@query(CONFLICT + " SELECT e.* FROM expanded e WHERE NOT EXISTS (SELECT 1 FROM removal r WHERE r.head = e.head AND r.relation = e.relation AND r.tail = e.tail)")
def conflict_free_knowledge(spark, sf):
    f = _funnel(spark, sf)
    _, removal = funnel.detect_conflicts(f.similar, _conflict_judge())
    return funnel.resolve(f.new_beyond_exact, removal)[0]


@query(CONFLICT + " SELECT * FROM removal")
def triples_to_remove(spark, sf):
    _, removal = funnel.detect_conflicts(_funnel(spark, sf).similar, _conflict_judge())
    return funnel.resolve(removal.select("head", "relation", "tail"), removal)[1]


@query(FUNNEL + """ SELECT DISTINCT head, relation, tail FROM alike s WHERE EXISTS (SELECT 1 FROM correct c WHERE c.head = s.gen_head AND c.relation = s.gen_relation AND c.tail = s.gen_tail)""")
def corresponding_graph_triples(spark, sf):
    f = _funnel(spark, sf)
    return match.lookup(f.similar, f.correct)


@query(f"""{CANDIDATES} SELECT c.query, count(*) AS n_original, count(f.candidate) AS n_filtered, count(*) - count(f.candidate) AS n_filtered_out, 100 * round((count(*) - count(f.candidate)) / count(*), 6) AS percent_filtered_out
FROM candidates c LEFT JOIN confirmed f ON c.query = f.query AND c.candidate = f.candidate GROUP BY c.query""")
def candidate_filter_rate(spark, sf):
    c = _candidates(spark, sf).select("query", "candidate")
    return metrics.filter_rate(c, funnel.agreed(c, _entity_judge(spark, sf)), ["query"])


@query(f"{CANDIDATES} SELECT query, list(candidate ORDER BY rank) AS candidates FROM candidates GROUP BY query")
def candidate_map(spark, sf):
    return match.candidate_lists(_candidates(spark, sf))


@query("""WITH m AS (SELECT DISTINCT source AS model, doc_id // 1000 AS iteration, doc_id FROM documents WHERE n_chars > 500), g AS (SELECT DISTINCT source AS model, doc_id // 1000 AS iteration, doc_id FROM documents JOIN labels USING (doc_id) WHERE quality = 1),
e AS (SELECT coalesce(m.model, g.model) AS model, coalesce(m.iteration, g.iteration) AS iteration, count(*) FILTER (WHERE m.doc_id IS NOT NULL AND g.doc_id IS NOT NULL) AS tp, count(*) FILTER (WHERE g.doc_id IS NULL) AS fp, count(*) FILTER (WHERE m.doc_id IS NULL) AS fn
  FROM m FULL JOIN g ON m.model = g.model AND m.iteration = g.iteration AND m.doc_id = g.doc_id GROUP BY 1, 2),
l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY iteration DESC) AS r FROM e) WHERE r = 1)
SELECT s.model, CAST(s.tp AS BIGINT) AS tp, CAST(s.fp AS BIGINT) AS fp, CAST(s.fn AS BIGINT) AS fn, round(CASE WHEN s.tp + s.fp = 0 THEN 0 ELSE s.tp / (s.tp + s.fp) END, 6) AS precision_micro, round(CASE WHEN s.tp + s.fn = 0 THEN 0 ELSE s.tp / (s.tp + s.fn) END, 6) AS recall_micro,
round(CASE WHEN l.tp + l.fp = 0 THEN 0 ELSE l.tp / (l.tp + l.fp) END, 6) AS precision_last, round(CASE WHEN l.tp + l.fn = 0 THEN 0 ELSE l.tp / (l.tp + l.fn) END, 6) AS recall_last
FROM (SELECT model, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM e GROUP BY model) s JOIN l USING (model)""")
def precision_recall_vs_gold(spark, sf):
    docs = X.documents(spark, sf).select(F.col("source").alias("model"), F.expr("doc_id div 1000").alias("iteration"), "doc_id", "n_chars")
    gold = docs.join(table(spark, sf, "labels").where("quality = 1").select("doc_id"), "doc_id")
    return metrics.against_gold(docs.where("n_chars > 500"), gold, ["model"], ["doc_id"], "iteration")


RECORDS = """done AS (SELECT user_id AS iteration, event_type AS evaluator, event_id, value, CASE WHEN event_id % 3 > 0 THEN value * 2 END AS exact FROM events)"""


def _records(spark, sf):
    e = table(spark, sf, "events")
    return e.select(F.col("user_id").alias("iteration"), F.col("event_type").alias("evaluator"), "event_id", "value", F.when(F.col("event_id") % 3 > 0, F.col("value") * 2).alias("exact"))


@query(f"WITH {RECORDS} SELECT o.iteration, n.evaluator FROM (SELECT DISTINCT o_custkey AS iteration FROM orders WHERE o_custkey >= 5) o, (SELECT DISTINCT evaluator FROM done) n WHERE NOT EXISTS (SELECT 1 FROM done d WHERE d.iteration = o.iteration AND d.evaluator = n.evaluator)")
def missing_iterations(spark, sf):
    return state.missing(table(spark, sf, "orders").select(F.col("o_custkey").alias("iteration")), _records(spark, sf), start=5)


@query(f"WITH {RECORDS} SELECT DISTINCT o_custkey AS iteration FROM orders WHERE o_custkey NOT IN (SELECT iteration FROM done)")
def missing_iterations_legacy(spark, sf):
    return state.missing(table(spark, sf, "orders").select(F.col("o_custkey").alias("iteration")), _records(spark, sf), legacy_union=True)


@query(f"""WITH {RECORDS}, f AS (SELECT user_id AS iteration, event_type AS evaluator, max(value) AS exact FROM events GROUP BY ALL)
SELECT d.iteration, d.evaluator, d.event_id, d.value, CASE WHEN d.exact IS NULL THEN f.exact ELSE d.exact END AS exact FROM done d LEFT JOIN f ON d.iteration = f.iteration AND d.evaluator = f.evaluator""")
def backfill_exact(spark, sf):
    records = _records(spark, sf)
    return state.backfill(records, records.groupBy("iteration", "evaluator").agg(F.max("value").alias("exact")), ["exact"])


@query(f"""WITH {RECORDS}, first AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY iteration, evaluator ORDER BY event_id) AS r FROM done) WHERE r = 1)
SELECT c_custkey AS iteration, c_name AS name, n.evaluator, f.event_id FROM customer, (SELECT DISTINCT evaluator FROM done) n LEFT JOIN first f ON f.iteration = c_custkey AND f.evaluator = n.evaluator""")
def combined_results(spark, sf):
    generated = table(spark, sf, "customer").select(F.col("c_custkey").alias("iteration"), F.col("c_name").alias("name"))
    rows = state.combined(generated, _records(spark, sf).select("iteration", "evaluator", "event_id"), ["event_id"])
    return rows.select("iteration", "name", F.explode("evaluations").alias("evaluator", "v")).select("iteration", "name", "evaluator", F.col("v.event_id").alias("event_id"))
