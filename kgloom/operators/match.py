"""Matching generated triples against a graph: exact, by similar ends, by containment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from kgloom.functions import text

NAMES = ["head", "relation", "tail"]


def cleaned(generated: DataFrame) -> DataFrame:
    """Generated triples with entity cleaning at both ends and relation cleaning between; other columns stay."""
    return generated.withColumns({"head": text.clean_entity(F.col("head")), "relation": text.clean_relation(F.col("relation")), "tail": text.clean_entity(F.col("tail"))})


def matched(generated: DataFrame, kg: DataFrame) -> DataFrame:
    """Cleaned generated triples that the graph has, case and all; repeated ones stay repeated."""
    return cleaned(generated).join(kg, NAMES, "left_semi").select(generated.columns)


def unmatched(generated: DataFrame, kg: DataFrame) -> DataFrame:
    return cleaned(generated).join(kg, NAMES, "left_anti").select(generated.columns)


def flagged(generated: DataFrame, kg: DataFrame) -> DataFrame:
    """Both at once: a boolean column matched."""
    known = kg.select(*NAMES).distinct().withColumn("_known", F.lit(True))
    return cleaned(generated).join(known, NAMES, "left").withColumn("matched", F.coalesce("_known", F.lit(False))).drop("_known")


def similar_triples(generated: DataFrame, candidates: DataFrame, kg: DataFrame, strictness: str = "strict") -> DataFrame:
    """Pairs of a generated triple (gen_head, ...) and a graph triple (head, ...): the graph triple's ends, both (strict) or one (lenient), are among the candidates of either end of the generated one.

    candidates: query, candidate. Candidates of head and tail are pooled, so reversed pairs qualify; relations don't
    count. Generated triples are distinct; repeated graph triples stay repeated. Ends meet candidates by equi-joins only.
    """
    if strictness not in ("strict", "lenient"):
        raise ValueError(f"no strictness {strictness!r}")
    gen = [F.col(c).alias(f"gen_{c}") for c in NAMES]
    gen_names = [f"gen_{c}" for c in NAMES]
    distinct = generated.select(*gen).distinct()
    pool = distinct.select(*gen_names, F.explode(F.array_distinct(F.array("gen_head", "gen_tail"))).alias("query")).join(candidates.select("query", "candidate"), "query").select(*gen_names, "candidate").distinct()
    if strictness == "lenient":
        edges = kg.groupBy(*NAMES).agg(F.count(F.lit(1)).alias("_times"))
        hit = edges.select(*NAMES, "_times", F.explode(F.array_distinct(F.array("head", "tail"))).alias("candidate")).join(pool, "candidate").select(*gen_names, *NAMES, "_times").distinct()
        return hit.select(*gen_names, *NAMES, F.explode(F.sequence(F.lit(1).cast("long"), "_times")).alias("_i")).drop("_i")
    first = kg.join(pool.withColumnRenamed("candidate", "head"), "head")
    return first.join(pool.withColumnRenamed("candidate", "tail"), [*gen_names, "tail"], "left_semi").select(*gen_names, *NAMES)


def containing(generated: DataFrame, nearest: DataFrame, kg: DataFrame, line: str = "line_no") -> DataFrame:
    """For each generated triple the first graph line that contains the nearest entities (query, candidate) of both its ends as substrings.

    Lines are read as text, so an end may match within a longer name. Containment has no equi-key: the distinct pairs
    of nearest entities are the query set, whose blocks meet the lines in one pass over each.
    """
    from kgloom.sources.readers import held

    near = nearest.select("query", "candidate")
    pairs = generated.select(*NAMES).distinct().join(near.select(F.col("query").alias("head"), F.col("candidate").alias("near_head")), "head").join(near.select(F.col("query").alias("tail"), F.col("candidate").alias("near_tail")), "tail")
    lines = kg.select(line, text.triple_line(F.col("head"), F.col("relation"), F.col("tail")).alias("kg_line"))
    hits = held(lines, "kg_line", pairs.select("near_head", "near_tail").distinct(), F.array("near_head", "near_tail"), 20_000)
    first = hits.groupBy("near_head", "near_tail").agg(F.min(F.struct(line, "kg_line")).alias("first"))
    return pairs.join(first, ["near_head", "near_tail"]).select(*NAMES, F.col("first.kg_line").alias("kg_line"))


def lookup(pairs: DataFrame, keys: DataFrame) -> DataFrame:
    """Distinct graph triples that belong to the generated triples given."""
    return pairs.join(keys.select(*[F.col(c).alias(f"gen_{c}") for c in NAMES]), [f"gen_{c}" for c in NAMES], "left_semi").select(*NAMES).distinct()


def without(triples: DataFrame, pairs: DataFrame) -> DataFrame:
    """Triples that are no key of a pair table."""
    return triples.join(pairs.select(*[F.col(f"gen_{c}").alias(c) for c in NAMES]).distinct(), NAMES, "left_anti")


def candidate_lists(candidates: DataFrame) -> DataFrame:
    """A row for each query with its candidates, nearest first."""
    ordered = F.array_sort(F.collect_list(F.struct("rank", "candidate")))
    return candidates.groupBy("query").agg(F.transform(ordered, lambda x: x["candidate"]).alias("candidates"))


def row_first(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(W.partitionBy(*key).orderBy(*order))).where("_r = 1").drop("_r")
