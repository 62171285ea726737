"""Operators on a graph of triples: building, masking, cleaning, counting, indexing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from kgloom.sources.readers import dense_index

NAMES = ("head", "relation", "tail")


def triples_of(df: DataFrame, head: str, relation: str, tail: str) -> DataFrame:
    """Rows of a table as triples; head and tail are columns, relation is a constant."""
    return df.select(F.col(head).alias("head"), F.lit(relation).alias("relation"), F.col(tail).alias("tail"))


def star_graph(t: dict[str, DataFrame]) -> DataFrame:
    """The star schema's tables as one graph of distinct triples."""
    customers = t["customer"].join(t["nation"], F.col("c_nationkey") == F.col("n_nationkey"))
    suppliers = t["supplier"].join(t["nation"], F.col("s_nationkey") == F.col("n_nationkey"))
    nations = t["nation"].join(t["region"], F.col("n_regionkey") == F.col("r_regionkey"))
    pairs = t["lineitem"].select("l_suppkey", "l_partkey").distinct()
    supplies = pairs.join(t["supplier"], F.col("l_suppkey") == F.col("s_suppkey")).join(t["part"], F.col("l_partkey") == F.col("p_partkey"))
    return reduce(DataFrame.union, [
        triples_of(customers, "c_name", "located in", "n_name"), triples_of(suppliers, "s_name", "located in", "n_name"), triples_of(nations, "n_name", "part of", "r_name"),
        triples_of(t["customer"], "c_name", "in segment", "c_mktsegment"), triples_of(t["part"], "p_name", "isa", "p_type"), triples_of(t["part"], "p_name", "made by", "p_brand"), triples_of(supplies, "s_name", "supplies", "p_name"),
    ]).distinct()


def ends(kg: DataFrame, name: str = "entity") -> DataFrame:
    """Heads and tails, a row each."""
    return kg.select(F.explode(F.array("head", "tail")).alias(name))


def entities(kg: DataFrame) -> DataFrame:
    return ends(kg).distinct()


def relations(kg: DataFrame) -> DataFrame:
    return kg.select("relation").distinct()


def keyword_pairs(kg: DataFrame) -> DataFrame:
    """Distinct pairs of a triple's parts, with what they are."""
    pair = lambda a, b, kind: F.struct(F.lit(kind).alias("kind"), F.col(a).alias("first"), F.col(b).alias("second"))
    return kg.select(F.inline(F.array(pair("head", "relation", "hr"), pair("relation", "tail", "rt"), pair("head", "tail", "ht")))).distinct()


def top_entities(kg: DataFrame, k: int) -> DataFrame:
    """The k entities that most triples have, for examples."""
    return ends(kg).groupBy("entity").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "entity").limit(k)


def top_relations(kg: DataFrame, k: int) -> DataFrame:
    """The k relations that most triples have."""
    return kg.groupBy("relation").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "relation").limit(k)


def example_triples(kg: DataFrame, relations: int, each: int) -> DataFrame:
    """Examples for a prompt: of the relations that most triples have the triples whose two ends most triples have, rank 1 to each; ties by name.

    An entity counts once for each triple it ends. Each relation's triples are narrowed by salt before they are ranked,
    so no task ranks a whole relation.
    """
    degree = ends(kg).groupBy("entity").agg(F.count(F.lit(1)).alias("_n"))
    few = top_relations(kg, relations)  # a row for each of so many
    scored = kg.select(*NAMES).distinct().join(F.broadcast(few), "relation")
    for c in ("head", "tail"):
        scored = scored.join(degree.select(F.col("entity").alias(c), F.col("_n").alias(f"_{c}")), c)
    scored = scored.withColumn("weight", F.col("_head") + F.col("_tail"))
    best = [F.desc("weight"), F.asc("head"), F.asc("tail")]
    salted = scored.withColumn("_salt", F.pmod(F.xxhash64("head", "tail"), F.lit(64)))
    some = salted.withColumn("_r", F.row_number().over(W.partitionBy("relation", "_salt").orderBy(*best))).where(F.col("_r") <= each)
    return some.withColumn("rank", F.row_number().over(W.partitionBy("relation").orderBy(*best))).where(F.col("rank") <= each).select("relation", "rank", "head", "tail", "weight")


def mask(kg: DataFrame, keywords: DataFrame, order: str | None = None) -> DataFrame:
    """Distinct triples of which head, relation or tail is a keyword: the three parts as rows meet the keywords in one equi-join, instead of a join by OR. With order, a column of kg, each triple has its least value."""
    key = keywords.columns[0]
    kept = [*NAMES, *([order] if order else [])]
    parts = kg.select(*kept, F.explode(F.array(*NAMES)).alias(key))
    found = parts.join(keywords, key, "left_semi").select(*kept)
    return found.groupBy(*NAMES).agg(F.min(order).alias(order)) if order else found.distinct()


def with_relations(kg: DataFrame, allowed: DataFrame) -> DataFrame:
    """Triples of allowed relations; repeated ones stay repeated."""
    return kg.join(allowed, "relation", "left_semi").select(*NAMES)


def cleaned(kg: DataFrame, excluded: DataFrame, max_length: int = 500, classes: DataFrame | None = None, excluded_classes: DataFrame | None = None) -> DataFrame:
    """Triples without excluded relations, overlong, numeric or non-ASCII parts.

    classes: entity, class (an entity may have several, or none); with excluded_classes (class) a triple goes if either
    end has one of these.
    """
    good = kg.join(excluded, "relation", "left_anti").select(*NAMES)
    for c in NAMES:
        good = good.where((F.length(c) <= max_length) & ~F.col(c).rlike(r"^\d+(\.\d+)?$") & ~F.col(c).rlike(r"[^\x00-\x7F]"))
    if classes is not None and excluded_classes is not None:
        banned = classes.join(excluded_classes.select("class"), "class", "left_semi").select("entity").distinct()
        for c in ("head", "tail"):
            good = good.join(banned.withColumnRenamed("entity", c), c, "left_anti").select(*NAMES)
    return good


def split_file(lines: DataFrame, parts: int, order: str) -> DataFrame:
    """Contiguous parts of a file, the first ones a line longer where sizes differ; by arithmetic on line numbers."""
    n = lines.count()
    size, longer = divmod(n, parts)
    i = F.col("_i")
    part = F.when(i < longer * (size + 1), F.floor(i / (size + 1))).otherwise(F.lit(longer) + F.floor((i - longer * (size + 1)) / max(1, size)))
    return dense_index(lines, order, "_i").withColumn("part", (part + 1).cast("int")).drop("_i")


def integrated(*results: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, results).distinct()


def statistics(kg: DataFrame, most: int = 19) -> DataFrame:
    """How many entities have 1, 2, ... distinct relations, and their share of all entities."""
    per = kg.select(F.explode(F.array("head", "tail")).alias("entity"), "relation").distinct().groupBy("entity").agg(F.count(F.lit(1)).alias("n_relations"))
    counts = per.groupBy("n_relations").agg(F.count(F.lit(1)).alias("n_entities"))
    total = counts.agg(F.sum("n_entities").alias("total"))
    all_rows = kg.sparkSession.range(1, most + 1).select(F.col("id").alias("n_relations"))
    joined = all_rows.join(counts, "n_relations", "left").join(F.broadcast(total))  # one row
    return joined.select("n_relations", F.coalesce("n_entities", F.lit(0)).alias("n_entities"), F.round(100 * F.coalesce("n_entities", F.lit(0)) / F.col("total"), 6).alias("percent"))


def first_seen_index(kg: DataFrame, columns: tuple[str, ...], order: str = "line_no") -> DataFrame:
    """Dense ids of names in the order of their first occurrence; of a line the columns count in turn."""
    width = len(columns)
    at = kg.select(F.inline(F.array(*[F.struct(F.col(c).alias("name"), (F.col(order) * width + i).alias("seen")) for i, c in enumerate(columns)])))
    return dense_index(at.groupBy("name").agg(F.min("seen").alias("seen")), "seen", "id").select("id", "name")


def first_seen(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """A row for each key with the order of its first occurrence."""
    return df.groupBy(*key).agg(F.min(F.struct(*order)).alias("first"))


def canonical(kg: DataFrame, aliases: DataFrame) -> DataFrame:
    """Distinct triples with aliases (alias, canonical) replaced at both ends, without those that link a name to itself."""
    out = kg
    for c in ("head", "tail"):
        names = aliases.select(F.col("alias").alias(c), F.col("canonical").alias("_name"))
        out = out.join(names, c, "left").withColumn(c, F.coalesce("_name", c)).drop("_name")
    return out.select(*NAMES).where("head <> tail").distinct()
