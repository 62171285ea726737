"""Connected components by alternating stars; no node's neighbours ever meet in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgloom.llm.common import discard, stored


def _stars(edges: DataFrame) -> bool:
    """Whether all edges lead straight to a centre: no node has two, none with one is another's centre."""
    ends = edges.select(F.col("u").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up = 1 and down = 1").isEmpty()


#: A node's edges meet its least neighbour in so many parts.
SALTS = 16


def _with_least(edges: DataFrame, least: DataFrame) -> DataFrame:
    salted = edges.withColumn("s", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))
    return salted.join(least.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["u", "s"])


def connected(edges: DataFrame) -> DataFrame:
    """Edges (u, v) of any ordered type become stars: (u, v) with v the least node of u's component, for every u but that.

    Large stars hang a node's greater neighbours from its least neighbour, small stars its lesser ones; rounds end when
    all edges are stars, after about the logarithm of the longest path. Least neighbours come from partial minima and go
    back by a join on the node and one of SALTS parts of its neighbours, so a centre's neighbours don't meet in a task.
    Loops and repeated edges do no harm; an edge with
    a null end is none; no edges give no rows. Each round's table is deleted once the next is written.
    """
    edges = stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while not _stars(edges):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = _with_least(both.where("v > u"), least).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = _with_least(large, least).select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        before, edges = edges, stored(small, "edges")
        discard(before)
    return edges
