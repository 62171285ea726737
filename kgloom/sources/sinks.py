"""Sinks: result tables, triple files, index files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgloom.functions.text import triple_line


def save_results(df: DataFrame, path: str, by: tuple[str, ...] = ()) -> None:
    """Overwrites a result table; with by only the partitions that df has."""
    writer = df.write.mode("overwrite")
    (writer.option("partitionOverwriteMode", "dynamic").partitionBy(*by) if by else writer).parquet(path)


def save_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def save_triples(triples: DataFrame, path: str, order: str | None = None, parts: int | None = None) -> int:
    """One line for each distinct triple; returns how many there are. With order, a numeric column, the lines are in the order of their first occurrence: the files' names are, and within them the lines, by ranges of the least number."""
    line = triple_line(F.col("head"), F.col("relation"), F.col("tail")).alias("value")
    spark = triples.sparkSession
    if order is None:
        lines = triples.select(line).distinct()
    else:
        first = triples.select(line, F.col(order).alias("_at")).groupBy("value").agg(F.min("_at").alias("_at"))
        ranged = first.repartitionByRange(parts, "_at", "value") if parts else first.repartitionByRange("_at", "value")
        lines = ranged.sortWithinPartitions("_at", "value").select("value")
    lines.write.mode("overwrite").text(path)
    return spark.read.text(path).count()


def save_mask(triples: DataFrame, entities: DataFrame, relations: DataFrame, folder: str, tag: str, order: str | None = None) -> None:
    """Three text files; the triples in the order of their first occurrence where order names a column of theirs."""
    save_triples(triples, f"{folder}/relevant_triples_{tag}", order)
    entities.select(F.col(entities.columns[0]).alias("value")).write.mode("overwrite").text(f"{folder}/relevant_entities_{tag}")
    relations.select(F.col(relations.columns[0]).alias("value")).write.mode("overwrite").text(f"{folder}/relevant_relations_{tag}")


def save_index(index: DataFrame, path: str) -> None:
    """id and name, parted by tabs."""
    index.select("id", "name").write.mode("overwrite").csv(path, sep="\t")
