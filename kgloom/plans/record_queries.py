"""Queries on article records, keys of saved results, accumulation over iterations, levels of evaluation and the start rule."""

from __future__ import annotations

from pyspark.sql import functions as F

from kgloom.functions import parse, text
from kgloom.operators import match, metrics, state
from kgloom.plans import fixtures as X
from kgloom.plans.funnel_queries import CORRECT, E, EQUIVALENT, EXACT, SIMILAR
from kgloom.plans.registry import query
from kgloom.session import table
from kgloom.sources import readers

NAMES = match.NAMES


@query(r"""SELECT DISTINCT regexp_replace(line, '^\s+|\s+$', '', 'g') AS keyword FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM conversations WHERE text IS NOT NULL)""")
def whole_line_keywords(spark, sf):
    return readers.whole_keywords(table(spark, sf, "conversations").select(F.explode(F.split("text", "\n")).alias("value")))


@query("SELECT conv_id, string_agg(text, ', ' ORDER BY turn) AS joined FROM conversations WHERE text IS NOT NULL GROUP BY conv_id")
def joined_lines(spark, sf):
    talks = table(spark, sf, "conversations").where("text is not null")
    return readers.joined_lines(talks, "text", ["conv_id"], "turn")


@query("""SELECT doc_id, concat_ws(', ', lang, source) AS keywords, coalesce(split_part(text, '.', 1), '') AS title, coalesce(text, '') AS abstract,
contains(lower(concat_ws(', ', lang, source)), 'en') AS keywords_match FROM documents""")
def medline_records(spark, sf):
    terms = F.filter(F.array("lang", "source"), lambda x: x.isNotNull())
    record = text.article_record(terms, F.split("text", r"\.")[0], F.col("text"), F.array(F.lit("EN")))
    return X.documents(spark, sf).select("doc_id", record.alias("r")).select("doc_id", "r.*")


@query(f"{E} SELECT head || ' ' || relation || ' ' || tail AS sentence FROM generated")
def triple_sentences(spark, sf):
    return X.generated(spark, sf).select(text.triple_sentence(F.col("head"), F.col("relation"), F.col("tail")).alias("sentence"))


@query(f"{E} SELECT head || '''s' AS head, relation, tail FROM generated")
def stringified_keys(spark, sf):
    """Keys as another program wrote them, with an apostrophe in the first part, read back."""
    key = F.concat(F.lit('("'), "head", F.lit("'s\", '"), "relation", F.lit("', '"), "tail", F.lit("')"))
    return X.generated(spark, sf).select(key.alias("key")).select(parse.tuple_key(F.col("key"), NAMES).alias("t")).select("t.*")


@query(f"""WITH {X.AGAIN_SQL}, first AS (SELECT head, relation, tail, min(iteration) AS iteration FROM again GROUP BY 1, 2, 3),
counts AS (SELECT iteration, count(*) AS n_items FROM again GROUP BY 1), new AS (SELECT iteration, count(*) AS n_new FROM first GROUP BY 1)
SELECT iteration, n_items, coalesce(n_new, 0) AS n_new, CAST(sum(n_items) OVER (ORDER BY iteration) AS BIGINT) AS n_accumulated, CAST(sum(coalesce(n_new, 0)) OVER (ORDER BY iteration) AS BIGINT) AS n_distinct
FROM counts LEFT JOIN new USING (iteration)""")
def accumulation(spark, sf):
    return metrics.accumulated(X.again(spark, sf), NAMES)


PAIRED = f"""{E}, pairs AS (SELECT g.iteration, g.head AS gen_head, g.relation AS gen_relation, g.tail AS gen_tail, e.head, e.relation, e.tail FROM generated g JOIN edges e ON g.head = e.head),
judged AS (SELECT g.*, {CORRECT} AS ok FROM generated g)"""


def level_sql(name: str, test: str, extra: str) -> str:
    hit = f"SELECT DISTINCT j.iteration, j.head, j.relation, j.tail FROM judged j WHERE {extra} AND EXISTS (SELECT 1 FROM pairs p WHERE p.iteration = j.iteration AND p.gen_head = j.head AND p.gen_relation = j.relation AND p.gen_tail = j.tail AND {test})"
    return f"SELECT iteration, '{name}' AS level, count(*) AS n FROM ({hit}) GROUP BY iteration"


LEVELS = {"similar": SIMILAR, "equivalent": f"{SIMILAR} AND {EQUIVALENT}", "exact": f"{SIMILAR} AND {EQUIVALENT} AND {EXACT}"}


@query(PAIRED + " " + " UNION ALL ".join(level_sql(f"{n}{s}", t, x) for n, t in LEVELS.items() for s, x in (("", "true"), ("_and_correct", "ok"))))
def evaluation_levels(spark, sf):
    """How many generated triples of each iteration reach each level, and are judged correct besides."""
    g = X.generated(spark, sf)
    edges = X.edges(spark, sf).drop("line_no")
    pairs = g.select("iteration", *[F.col(c).alias(f"gen_{c}") for c in NAMES]).join(edges, F.col("gen_head") == F.col("head"))
    return metrics.level_counts({n: pairs.where(t) for n, t in LEVELS.items()}, g.where(CORRECT), NAMES)


@query("SELECT conv_id AS iteration FROM (SELECT DISTINCT conv_id FROM conversations) WHERE conv_id > (SELECT max(conv_id) FROM conversations WHERE role = 'user' AND conv_id % 3 = 1)")
def start_rule(spark, sf):
    talks = table(spark, sf, "conversations")
    done = talks.where("role = 'user' and conv_id % 3 = 1").select(F.col("conv_id").alias("iteration"))
    return state.from_start(talks.select(F.col("conv_id").alias("iteration")).distinct(), done)
