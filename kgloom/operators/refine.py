"""Lists refined by a tree of judge calls: partial lists are merged level by level, each prompt of bounded size."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from kgloom.functions import text
from kgloom.operators import prompts
from kgloom.operators.judge import Judge

TYPES = """Merge this list of entity types to one without synonyms or types that another one covers. One type a line, nothing else.
{{ items }}"""
PURPOSES = """Merge these purposes of a knowledge graph to the fewest that say all of them. One purpose a line, nothing else.
{{ items }}"""


def lines_of(answer: Column) -> Column:
    """The distinct non-blank lines of an answer, stripped."""
    return F.array_distinct(F.filter(F.transform(F.split(answer, "\n"), text.strip), lambda x: x != ""))


def bundled(items: DataFrame, by: list[str], max_chars: int) -> DataFrame:
    """items (by, item, distinct) with a bundle number: of bundles of one group each has max_chars characters at most, or is a single item.

    Items are dealt by their hash to as many buckets as the group's size asks for, and a bucket is cut where it is too
    long, so neither the partitioning nor the order of rows counts, and no task sees a whole group.
    """
    size = F.length("item") + 1
    groups = items.groupBy(*by).agg(F.ceil(2 * F.sum(size) / F.lit(max_chars)).alias("_buckets"), F.sum(size).alias("_size"))
    one = F.col("_size") <= max_chars
    dealt = items.join(groups, by).withColumn("_bucket", F.when(one, F.lit(0)).otherwise(F.pmod(F.xxhash64("item"), F.col("_buckets"))))
    order = W.partitionBy(*by, "_bucket").orderBy("item")
    before = F.sum(size).over(order.rowsBetween(W.unboundedPreceding, 0))
    # two neighbours of one part lie in one half of the bound, so a part holds no more than that and one item
    part = F.when(one, F.lit(0)).when(size * 2 > max_chars, -F.row_number().over(order)).otherwise(F.floor((before - 1) * 2 / max_chars))
    return dealt.withColumn("bundle", F.struct("_bucket", part.cast("long").alias("_part"))).drop("_bucket", "_buckets", "_size")


def refine(
    items: DataFrame, by: list[str], judge: Judge, template: str = TYPES, max_chars: int = 4000, levels: int = 20,
    keep: Callable[[DataFrame, str], DataFrame] = lambda df, name: df, ask: Callable[[str, Judge, DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """by, item: each group's list as the judge leaves it when it saw it in one prompt.

    items: by columns and item (string; null and blank ones don't count, repeated ones count once). The judge's prompt is
    in the column prompt, the items joined by line ends in items; it answers with a line for each item of the merged
    list. A bundle without an answer keeps its items. Level by level the partial lists are dealt anew and merged, until
    each group is one bundle; a group that no longer shrinks, or is not one after so many levels, stays as it is. An item
    longer than max_chars has a prompt of its own.
    """
    ask = ask or (lambda step, judge, df: judge(df))
    clean = items.select(*by, text.strip(F.col("item")).alias("item")).where("item <> ''").distinct()
    current, finished = keep(clean, "refine-0"), None
    for level in range(1, levels + 1):
        dealt = bundled(current, by, max_chars)
        lists = dealt.groupBy(*by, "bundle").agg(F.array_join(F.array_sort(F.collect_list("item")), "\n").alias("items"), F.count(F.lit(1)).alias("n_items"))
        told = ask(f"refine-{level}", judge, lists.withColumn("prompt", prompts.compiled(template, {"items": F.col("items")})))
        merged = keep(told.select(*by, "bundle", "n_items", lines_of(F.coalesce("answer", F.col("items"))).alias("merged")), f"refine-{level}")
        sizes = merged.groupBy(*by).agg(F.count(F.lit(1)).alias("_bundles"), F.sum("n_items").alias("_before"), F.sum(F.size("merged")).alias("_after"))
        state = keep(sizes.select(*by, ((F.col("_bundles") == 1) | (F.col("_after") >= F.col("_before")) | F.lit(level == levels)).alias("_end")), f"refine-state-{level}")
        after = merged.select(*by, F.explode("merged").alias("item")).distinct().join(state, by)
        done = after.where("_end").drop("_end")
        finished = done if finished is None else finished.unionByName(done)
        if state.where("not _end").isEmpty():
            break
        current = after.where("not _end").drop("_end")
    return finished
