"""The corpus pipeline: whole documents in, encoded training documents out.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns
of documents. Line dedup empties documents whose every line is frequent, such as those of large groups of exact copies:
they stay, with an empty text, through the stages after it.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kgloom.llm import bpe, decontamination, jaccard_join, language_id, line_dedup
from kgloom.llm.common import discard, stored

#: Below this pooled probability no language explains a text; with few languages chance alone gives less.
MIN_LANGUAGE_SCORE = 0.35


def _packed(docs: DataFrame, *apart: str) -> DataFrame:
    """The columns named, and all others in one, _row, where no name of theirs can clash with an operator's."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in apart]
    return docs.select(F.struct(*others or [F.lit(0).alias("_")]).alias("_row"), *apart)


def _unpacked(df: DataFrame, columns: list[str], *apart: str, **changed: Column) -> DataFrame:
    return df.select(*[changed.get(c, F.col(c) if c in apart else F.col("_row").getField(c)).alias(c) for c in columns])


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter (und), null and empty ones among them, and those that fit no learnt language. Where nothing could be learnt all stay.

    Rows that repeat are judged alike; ties go to the first language; an empty table stays empty; long texts count whole.
    """
    net = language_id.fit(docs)
    if net is None:
        return docs
    labelled = language_id.label_documents(_packed(docs, "text"), net)
    kept = labelled.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= MIN_LANGUAGE_SCORE))
    return _unpacked(kept, docs.columns, "text")


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes lines out that 10 or more documents share; n_chars follows the text. Every row stays.

    A null text, one empty line, stays null; rows that repeat an id count once for a line, all without an id as one
    document; an empty table stays empty.
    """
    kept = line_dedup.drop_frequent_lines(_packed(docs, "doc_id", "text"), min_docs=10, min_length=1)
    changed = {"n_chars": F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("_row.n_chars"))} if "n_chars" in docs.columns else {}
    return _unpacked(kept, docs.columns, "doc_id", "text", **changed)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of the Jaccard join one row stays, by least id (null last), then text hash; texts without words are no duplicates.

    Rows are known by a hash of id and text, so ids may be null or repeated; rows equal in both are one, whatever their
    other columns. An empty table stays empty.
    """
    key = F.xxhash64(F.col("doc_id").isNull(), "doc_id", F.col("text").isNull(), "text").alias("_key")
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), key, F.col("doc_id").alias("_id"), F.col("text").alias("_text"))
    found = jaccard_join.similar_documents(keyed.select("_key", "_text"), percent=75, size=5, id_col="_key", text_col="_text")
    ranked = keyed.select("_key", F.struct(F.col("_id").isNull(), "_id", F.xxhash64("_text"), "_key").alias("_rank")).distinct()
    winners = found.select("_key", "component_id").distinct().join(ranked, "_key").groupBy("component_id").agg(F.min_by("_key", "_rank").alias("_key"))
    kept = keyed.select("_row", "_key").join(winners.select("_key"), "_key", "left_semi").dropDuplicates(["_key"])
    return _unpacked(kept, docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item within the error budget go; null and empty ones hold none. Rows that repeat share their fate; without documents or items nothing goes."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    clean = decontamination.find_leaks(_packed(docs, "text"), benchmark).where(F.size("leaks") == 0)
    return _unpacked(clean, docs.columns, "text")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and the hash of the bytes that they decode to; null and empty texts have none. Every row stays, an empty table stays empty."""
    return bpe.encode_documents(docs.select("doc_id", "lang", "source", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"), ("n_tokens", "ids", "ids_sha256", "decoded_sha256"))


STAGES = [
    ("language ID", identify_language),
    ("line dedup", dedup_lines),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("byte-level BPE", encode),
]

#: SQL can express neither the network nor the merges; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, each result written and read again."""
    docs, former = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "pipeline")
        if former is not None:
            discard(former)  # no later stage reads it
        former = docs
    return STAGES[-1][1](spark, docs, sf_dir)
