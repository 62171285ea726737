"""Denoising in rounds: a round's answers are the next round's input, each round a table of its own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgloom.functions import parse
from kgloom.operators import prompts
from kgloom.operators.judge import Judge


def asked_directly(step: str, judge: Judge, df: DataFrame) -> tuple[DataFrame, DataFrame]:
    out = judge(df)
    return out, out.where(F.col("answer").isNull()).select("iteration").distinct()


def in_rounds(
    keywords: DataFrame, chunks: DataFrame, judges: dict[str, Judge], rounds: int = 3,
    ask: Callable[[str, Judge, DataFrame], tuple[DataFrame, DataFrame]] = asked_directly, keep: Callable[[DataFrame, str], DataFrame] = lambda df, name: df,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(keywords with all that the rounds found added, chunks denoised, iterations that wait for an answer).

    keywords: iteration, keywords (array), further columns, which stay; chunks: iteration, rank, chunk. In each round the
    judge keywords names the keywords of each chunk (its prompt: column prompt), then the judge text rewrites the chunk by
    them; the next round starts from that text. An iteration that lacks an answer takes no further part; ask finds the
    answers of its former rounds again, so a later run goes on where it stopped. An iteration's keywords are its own
    first, then the found ones, sorted; those of one chunk never denoise another. All chunks are kept, empty ones too.
    """
    current = chunks.select("iteration", "rank", "chunk")
    found = current.select("iteration", F.lit(None).cast("string").alias("keyword")).where("false")
    waiting = current.select("iteration").where("false")
    for r in range(1, rounds + 1):
        named, lacking = ask(f"keywords-{r}", judges["keywords"], current.withColumn("prompt", prompts.extract_keywords(F.col("chunk"))))
        named = named.join(lacking, "iteration", "left_anti").select("iteration", "rank", "chunk", parse.model_keywords(F.coalesce("answer", F.lit(""))).alias("named"))
        named = keep(named, f"keywords-{r}")
        told, lacking_text = ask(f"text-{r}", judges["text"], named.withColumn("prompt", prompts.denoise(F.col("chunk"), F.col("named"))))
        waiting = keep(waiting.union(lacking).union(lacking_text).distinct(), f"waiting-{r}")
        current = keep(told.join(waiting, "iteration", "left_anti").select("iteration", "rank", F.col("answer").alias("chunk")), f"text-{r}")
        found = found.union(named.select("iteration", F.explode("named").alias("keyword")))
    more = found.groupBy("iteration").agg(F.array_sort(F.collect_set("keyword")).alias("_more"))
    none = F.array().cast("array<string>")
    whole = F.concat("keywords", F.array_except(F.coalesce("_more", none), F.coalesce("keywords", none)))
    return keywords.join(more, "iteration", "left").withColumn("keywords", whole).drop("_more"), current, waiting
