"""Queries on text: chunks, parsing of answers, cleaning, retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from kgloom.functions import parse, text
from kgloom.operators import metrics, retrieve
from kgloom.plans import fixtures as X
from kgloom.plans.registry import query
from kgloom.session import table
from kgloom.sources import readers

NAMES = ("head", "relation", "tail")


def sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def squeezed(x: str) -> str:
    return rf"regexp_replace(regexp_replace({x}, '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g')"


def symbols_sql(x: str) -> str:
    return squeezed(f"translate({x}, '_,' || chr(10) || '''\"<>[]()', '  ')")


def entity_sql(x: str) -> str:
    return squeezed(f"translate({x}, '_{{}}', ' ')")


def parsed_sql(source: str, key: str, text_col: str, name: str) -> str:
    """CTEs that end in name(key, pos, head, relation, tail): the triples of a model's answers."""
    groups = lambda p: ", ".join(f"regexp_extract_all({text_col}, {sql_text(p)}, {i})" for i in (1, 2, 3))
    each = lambda kind, p: f"SELECT {key}, {kind} AS kind, unnest(range(1, len(h) + 1)) AS i, unnest(h) AS h, unnest(r) AS r, unnest(t) AS t FROM (SELECT {key}, m[1] AS h, m[2] AS r, m[3] AS t FROM (SELECT {key}, [{groups(p)}] AS m FROM {source}))"
    return f"""{name}_raw AS ({each(0, parse.QUOTED_TRIPLE)} UNION ALL {each(1, parse.LOOSE_TRIPLE)}),
{name}_clean AS (SELECT {key}, kind, i, {symbols_sql('h')} AS head, {symbols_sql('r')} AS relation, {symbols_sql('t')} AS tail FROM {name}_raw),
{name}_first AS (SELECT {key}, head, relation, tail, min(kind * 1000000 + i) AS seen FROM {name}_clean WHERE greatest(length(head), length(relation), length(tail)) <= 80 GROUP BY ALL),
{name} AS (SELECT {key}, CAST(row_number() OVER (PARTITION BY {key} ORDER BY seen) - 1 AS INTEGER) AS pos, head, relation, tail FROM {name}_first)"""


@query(f"WITH {X.CHUNKS_SQL} SELECT * FROM chunks")
def chunk_sentences(spark, sf):
    return retrieve.sentence_chunks(X.documents(spark, sf))


@query("""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), w AS (
  SELECT doc_id, CAST(s // 206 AS INTEGER) AS pos, substring(t, CAST(s + 1 AS INTEGER), 256) AS chunk FROM (SELECT doc_id, t, unnest(range(0, length(t) - 255, 206)) AS s FROM d WHERE length(t) >= 256)
), l AS (
  SELECT doc_id, CAST(greatest(0, floor((length(t) - 256) / 206.0) + 1) AS INTEGER) AS pos, substring(t, greatest(1, length(t) - 255), 256) AS chunk FROM d WHERE length(t) % 206 <> 0
)
SELECT * FROM w UNION ALL
SELECT l.* FROM l LEFT JOIN (SELECT chunk, min(doc_id) AS m FROM w GROUP BY 1) a USING (chunk) JOIN (SELECT chunk, min(doc_id) AS m FROM l GROUP BY 1) b USING (chunk)
WHERE (a.m IS NULL OR a.m > doc_id) AND b.m >= doc_id""")
def chunk_fixed_len(spark, sf):
    return retrieve.fixed_chunks(X.documents(spark, sf))


STOP_SQL = ", ".join(map(sql_text, retrieve.STOP_WORDS))


def bm25_sql(tokens: str, query_tokens: str, idf: str, factor: str, extra: str = "") -> str:
    return f"""WITH {X.CHUNKS_SQL}, {X.KEYWORDS_SQL},
tokenised AS (SELECT doc_id, pos, {tokens} AS tokens FROM chunks),
corpus AS (SELECT count(*) AS n, avg(len(tokens)) AS mean_length FROM tokenised),
asked AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest({query_tokens}) AS term FROM queries) GROUP BY ALL),
tf AS (SELECT doc_id, pos, length, term, count(*) AS tf FROM (SELECT doc_id, pos, len(tokens) AS length, unnest(tokens) AS term FROM tokenised) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term){extra},
scores AS (SELECT query_id, doc_id, pos, round(sum(times * {idf} * (tf / (tf + 1.5 * (1 - 0.75 + 0.75 * length / mean_length))){factor}), 6) AS score
  FROM tf JOIN df USING (term) JOIN asked USING (term), corpus{', mean' if extra else ''} GROUP BY ALL)"""


LUCENE_TOKENS = r"list_filter(regexp_extract_all(lower({}), '([\p{{L}}\p{{N}}_]{{2,}})', 1), lambda t: t NOT IN (" + STOP_SQL + "))"


@query(bm25_sql(LUCENE_TOKENS.format("chunk"), LUCENE_TOKENS.format("query"), "ln(1 + (n - df + 0.5) / (df + 0.5))", "") + """
SELECT query_id, CAST(rank AS INTEGER) AS rank, doc_id, pos, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id, pos) AS rank FROM scores) WHERE rank <= 10""")
def bm25_lucene_topk(spark, sf):
    queries = X.keyword_sets(spark, sf).select(F.col("iteration").alias("query_id"), text.keyword_query(F.col("keywords")).alias("query"))
    return retrieve.retrieve("bm25s", retrieve.sentence_chunks(X.documents(spark, sf)), queries, 10)


@query(bm25_sql("string_split(chunk, ' ')", "string_split(query, ' ')", "CASE WHEN ln(n - df + 0.5) - ln(df + 0.5) < 0 THEN 0.25 * mean_idf ELSE ln(n - df + 0.5) - ln(df + 0.5) END", " * 2.5",
  ", mean AS (SELECT avg(ln(n - d + 0.5) - ln(d + 0.5)) AS mean_idf FROM (SELECT term, count(*) AS d FROM (SELECT unnest(list_distinct(tokens)) AS term FROM tokenised) GROUP BY term), corpus)") + """,
first AS (SELECT doc_id, pos FROM chunks ORDER BY doc_id, pos LIMIT 20),
filled AS (SELECT * FROM scores UNION ALL SELECT query_id, doc_id, pos, 0.0 FROM queries, first WHERE NOT EXISTS (SELECT 1 FROM scores s WHERE s.query_id = queries.query_id AND s.doc_id = first.doc_id AND s.pos = first.pos))
SELECT query_id, CAST(rank AS INTEGER) AS rank, doc_id, pos, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id, pos) AS rank FROM filled) WHERE rank <= 10""")
def bm25_okapi_topk(spark, sf):
    queries = X.keyword_sets(spark, sf).select(F.col("iteration").alias("query_id"), text.keyword_query(F.col("keywords")).alias("query"))
    return retrieve.retrieve("rankbm25", retrieve.sentence_chunks(X.documents(spark, sf)), queries, 10)


PARSED = f"WITH {X.ANSWERS_SQL}, {parsed_sql('answers', 'iteration', 'text', 'parsed')}"


def _parsed(spark, sf):
    return X.answers(spark, sf).select("iteration", F.posexplode(parse.model_triples(F.col("text"))).alias("pos", "t")).select("iteration", "pos", "t.*")


@query(PARSED + " SELECT * FROM parsed")
def parse_llm_triples(spark, sf):
    return _parsed(spark, sf)


@query(f"SELECT c_custkey, {entity_sql('dirty')} AS entity, {symbols_sql('dirty')} AS symbols FROM (SELECT c_custkey, ' {{' || replace(c_name, '#', '_#__') || '}}  (' || c_mktsegment || '), ' || chr(10) || ' <x> ' AS dirty FROM customer)")
def clean_entities(spark, sf):
    dirty = F.concat(F.lit(" {"), F.replace("c_name", F.lit("#"), F.lit("_#__")), F.lit("}  ("), "c_mktsegment", F.lit("), \n <x> "))
    return table(spark, sf, "customer").select("c_custkey", text.clean_entity(dirty).alias("entity"), text.clean_symbols(dirty).alias("symbols"))


KEYWORD_TEXT = "'[''' || c_name || ''', ''' || c_mktsegment || '''], (' || c_mktsegment || ', nation_' || c_nationkey || ')'"


@query(f"""WITH t AS (SELECT c_custkey, {KEYWORD_TEXT} AS text FROM customer)
SELECT c_custkey, list_sort(list_distinct(list_filter(list_transform(list_concat(regexp_extract_all(text, {sql_text(parse.QUOTED_KEYWORD)}, 1), regexp_extract_all(text, {sql_text(parse.LOOSE_KEYWORD)}, 1)), lambda x: {entity_sql('x')}), lambda x: x <> ''))) AS keywords FROM t""")
def parse_keywords(spark, sf):
    value = F.concat(F.lit("['"), "c_name", F.lit("', '"), "c_mktsegment", F.lit("'], ("), "c_mktsegment", F.lit(", nation_"), F.col("c_nationkey").cast("string"), F.lit(")"))
    return table(spark, sf, "customer").select("c_custkey", parse.model_keywords(value).alias("keywords"))


@query("""SELECT o_orderkey, k = 0 OR k = 1 AS some, CASE k WHEN 0 THEN [a, b] WHEN 1 THEN [a, b] ELSE [] END AS conflicting, CASE k WHEN 0 THEN [b] ELSE [] END AS removed FROM (
SELECT o_orderkey, o_orderkey % 3 AS k, 'order ' || o_orderkey || '|has|' || lower(replace(o_orderpriority, '-', ' ')) AS a, 'order ' || o_orderkey || '|lacks|' || lower(replace(o_orderpriority, '-', ' ')) AS b FROM orders)""")
def parse_conflicts(spark, sf):
    k, name = F.col("o_orderkey") % 3, F.concat(F.lit("Order_"), F.col("o_orderkey").cast("string"))
    what = F.replace("o_orderpriority", F.lit("-"), F.lit(" "))
    t = lambda r: F.concat(F.lit("("), name, F.lit(f", {r}, "), what, F.lit(")"))
    listed = F.concat(F.lit(" Conflicting Triples: "), t("has"), F.lit(" "), t("LACKS"), F.lit("\n"))
    answer = F.when(k == 0, F.concat(listed, F.lit("Removal Triples: "), t("lacks"), F.lit(" (x, y, z)\nExplanation: (u, v, w)"))).when(k == 1, F.concat(listed, F.lit("Removal Triples: None"))).otherwise(F.lit("No conflicting triples\nNo triples to remove"))
    found, removal = parse.conflicts(answer)
    flat = lambda x: F.transform(x, lambda r: F.concat_ws("|", r["head"], r["relation"], r["tail"]))
    return table(spark, sf, "orders").select("o_orderkey", (F.size(found) > 0).alias("some"), flat(found).alias("conflicting"), flat(removal).alias("removed"))


@query("""SELECT event_id, regexp_matches(lower(a), 'true|yes|correct|right|equivalent') AS agrees, regexp_matches(a, '(?i)^\\s*[''"]?true\\b') AS agrees_strictly
FROM (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'True, ' || event_type WHEN 1 THEN 'Incorrect.' WHEN 2 THEN ' "TRUE"' WHEN 3 THEN 'FALSE ' || event_type ELSE 'They are not Equivalent' END AS a FROM events)""".replace("\\\\", "\\"))
def verdict(spark, sf):
    k = F.col("event_id") % 5
    a = F.when(k == 0, F.concat(F.lit("True, "), "event_type")).when(k == 1, "Incorrect.").when(k == 2, ' "TRUE"').when(k == 3, F.concat(F.lit("FALSE "), "event_type")).otherwise("They are not Equivalent")
    return table(spark, sf, "events").select("event_id", text.verdict(a).alias("agrees"), text.verdict(a, strict=True).alias("agrees_strictly"))


@query(r"""SELECT conv_id, turn, CASE WHEN contains(a, '[/INST]') THEN regexp_replace(string_split(a, '[/INST]')[-1], '^\s+|\s+$', '', 'g') ELSE a END AS answer
FROM (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN '[INST] ' || role || ' [/INST] x [/INST] ' || text || chr(10) ELSE text END AS a FROM conversations)""")
def strip_prompt(spark, sf):
    a = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("[INST] "), "role", F.lit(" [/INST] x [/INST] "), "text", F.lit("\n"))).otherwise(F.col("text"))
    return table(spark, sf, "conversations").select("conv_id", "turn", text.strip_prompt(a).alias("answer"))


FETCHED = f"""WITH {X.KEYWORDS_SQL}, hits AS (
  SELECT iteration, doc_id, source FROM documents, keyword_sets WHERE contains(text, keywords[1]) AND contains(text, keywords[2]) AND contains(text, keywords[3])
), fetched AS (SELECT iteration, doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY iteration, source ORDER BY doc_id) AS r FROM hits) WHERE r <= 10)"""


def _fetched(spark, sf):
    return readers.fetch(X.documents(spark, sf), X.keyword_sets(spark, sf), 10)


@query(FETCHED + " SELECT * FROM fetched")
def fetch_and_filter(spark, sf):
    return _fetched(spark, sf).select("iteration", "doc_id", "source")


@query("""SELECT doc_id, contains(lower(k), 'the') OR contains(lower(k), 'de') AS matches, source AS database FROM (SELECT doc_id, source, concat_ws(', ', lang, source, text) AS k FROM documents)""")
def keywords_match_flag(spark, sf):
    listed = F.concat_ws(", ", "lang", "source", "text")
    return X.documents(spark, sf).select("doc_id", text.any_keyword_in(F.array(F.lit("The"), F.lit("DE")), listed).alias("matches"), F.col("source").alias("database"))


@query(r"SELECT source, lang, count(*) AS n_articles FROM documents GROUP BY ALL HAVING bool_or(length(regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g')) > 500)")
def abstract_gate(spark, sf):
    filled = F.bool_or(F.length(text.strip(text.body(F.col("text")))) > 500)
    return X.documents(spark, sf).groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n_articles"), filled.alias("_some")).where("_some").drop("_some")


@query(f"""WITH {X.KEYWORDS_SQL}, talks AS (SELECT conv_id AS iteration, list(text ORDER BY turn) AS chunks FROM conversations WHERE text <> '' GROUP BY conv_id)
SELECT iteration, array_to_string(keywords, ', ') AS query, coalesce(len(chunks), 0) AS n_chunks, coalesce(chunks[1], '') AS first_chunk FROM keyword_sets LEFT JOIN talks USING (iteration)""")
def copied_chunks(spark, sf):
    from kgloom.operators import state

    talks = table(spark, sf, "conversations").where("text <> ''").groupBy(F.col("conv_id").alias("iteration")).agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("chunks"))
    joined = state.with_default(X.keyword_sets(spark, sf), talks, "chunks")
    return joined.select("iteration", text.keyword_query(F.col("keywords")).alias("query"), F.size("chunks").cast("long").alias("n_chunks"), F.coalesce(F.get("chunks", F.lit(0)), F.lit("")).alias("first_chunk"))


def matched_sql() -> str:
    return PARSED + f""", {X.GRAPH_SQL}, cleaned AS (SELECT iteration, pos, {entity_sql('head')} AS head, {entity_sql('relation')} AS relation, {entity_sql('tail')} AS tail FROM parsed),
flagged AS (SELECT c.*, EXISTS (SELECT 1 FROM kg WHERE kg.head = c.head AND kg.relation = c.relation AND kg.tail = c.tail) AS matched FROM cleaned c)"""


@query(matched_sql() + " SELECT iteration, pos, head, relation, tail FROM flagged WHERE matched")
def match_triples(spark, sf):
    from kgloom.operators import match

    return match.matched(_parsed(spark, sf), X.graph(spark, sf))


@query(matched_sql() + " SELECT iteration, pos, head, relation, tail FROM flagged WHERE NOT matched")
def unmatched_triples(spark, sf):
    from kgloom.operators import match

    return match.unmatched(_parsed(spark, sf), X.graph(spark, sf))


@query(matched_sql() + " SELECT iteration, count(*) AS n, count(*) FILTER (WHERE matched) AS n_matched, round(count(*) FILTER (WHERE matched) / count(*), 6) AS rate FROM flagged GROUP BY iteration")
def match_rate_by_iteration(spark, sf):
    from kgloom.operators import match

    hit = F.count(F.when(F.col("matched"), 1))
    return match.flagged(_parsed(spark, sf), X.graph(spark, sf)).groupBy("iteration").agg(F.count(F.lit(1)).alias("n"), hit.alias("n_matched"), F.round(hit / F.count(F.lit(1)), 6).alias("rate"))


CUMULATIVE = matched_sql() + """, first AS (SELECT head, relation, tail, min(iteration) AS iteration FROM cleaned GROUP BY 1, 2, 3),
relevant AS (SELECT DISTINCT * FROM kg WHERE relation = 'in segment'),
new AS (SELECT f.iteration, count(*) AS n, count(r.head) AS r FROM first f LEFT JOIN relevant r USING (head, relation, tail) GROUP BY 1),
so_far AS (SELECT iteration, sum(coalesce(n, 0)) OVER (ORDER BY iteration) AS n_items, sum(coalesce(r, 0)) OVER (ORDER BY iteration) AS n_relevant FROM (SELECT DISTINCT iteration FROM cleaned) LEFT JOIN new USING (iteration))
SELECT iteration, CAST(n_items AS BIGINT) AS n_items, CAST(n_relevant AS BIGINT) AS n_relevant, round(n_relevant / (SELECT count(*) FROM relevant), 6) AS recall, round(n_relevant / n_items, 6) AS precision FROM so_far"""


@query(CUMULATIVE)
def cumulative_recall(spark, sf):
    from kgloom.operators import match

    items = match.cleaned(_parsed(spark, sf))
    return metrics.cumulative(items, X.graph(spark, sf).where("relation = 'in segment'"), list(NAMES))


@query(matched_sql() + """, mine AS (SELECT DISTINCT head, relation, tail FROM cleaned), relevant AS (SELECT * FROM kg WHERE relation = 'in segment'), found AS (SELECT * FROM mine INTERSECT SELECT * FROM relevant),
lowered AS (SELECT 'C' || substring(head, 2) AS head, relation, tail FROM mine), more AS (SELECT * FROM found UNION SELECT * FROM (SELECT * FROM lowered INTERSECT SELECT * FROM relevant)),
good AS (SELECT * FROM found UNION (SELECT * FROM mine WHERE substring(head, 1, 1) = 'c'))
SELECT *, round(n_found / n_relevant, 6) AS recall, round(n_found / n_generated, 6) AS precision, round(n_more / n_relevant, 6) AS recall_relaxed, round(n_good / n_generated, 6) AS precision_relaxed FROM (
SELECT (SELECT count(*) FROM mine) AS n_generated, (SELECT count(*) FROM relevant) AS n_relevant, (SELECT count(*) FROM found) AS n_found, (SELECT count(*) FROM more) AS n_more, (SELECT count(*) FROM good) AS n_good)""".replace("SELECT *, round", "SELECT n_generated, n_relevant, n_found, round"))
def relaxed_metrics(spark, sf):
    from kgloom.operators import match

    items = match.cleaned(_parsed(spark, sf)).select(*NAMES)
    lowered = items.withColumn("head", F.concat(F.lit("C"), F.expr("substring(head, 2)")))
    return metrics.level_metrics(items, X.graph(spark, sf).where("relation = 'in segment'"), items.where("substring(head, 1, 1) = 'c'"), lowered, list(NAMES))


@query(PARSED + f""", listed AS (SELECT iteration, list_distinct(list_concat(regexp_extract_all(text, {sql_text(parse.QUOTED_KEYWORD)}, 1), regexp_extract_all(text, {sql_text(parse.LOOSE_KEYWORD)}, 1))) AS k FROM answers)
SELECT iteration, len(list_distinct(list_filter(list_concat(list_transform(k, lambda x: {entity_sql('x')}), ['own']), lambda x: x <> ''))) AS n_keywords FROM listed""")
def denoised_keywords(spark, sf):
    from kgloom.operators import funnel

    a = X.answers(spark, sf).select("iteration", F.col("text").alias("answer"), F.array(F.lit("own")).alias("keywords"))
    return funnel.denoised_keywords(a).select("iteration", F.size("keywords").cast("long").alias("n_keywords"))


