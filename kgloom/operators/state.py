"""State of runs: what is missing, what must be filled in, how results combine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def last_iteration(done: DataFrame) -> int:
    """The greatest iteration done; -1 before the first."""
    value = done.agg(F.max("iteration")).first()[0]
    return -1 if value is None else value


def missing(all_iterations: DataFrame, done: DataFrame, evaluators: DataFrame | None = None, start: int = 0, legacy_union: bool = False) -> DataFrame:
    """Iterations from start on that each evaluator hasn't done; with legacy_union an iteration that any has done is done for all."""
    wanted = all_iterations.where(F.col("iteration") >= start).select("iteration").distinct()
    if legacy_union:
        return wanted.join(done.select("iteration").distinct(), "iteration", "left_anti")
    names = (done if evaluators is None else evaluators).select("evaluator").distinct()
    every = wanted.join(F.broadcast(names))  # evaluators are a handful of configured names
    return every.join(done.select("iteration", "evaluator").distinct(), ["iteration", "evaluator"], "left_anti")


def backfill(records: DataFrame, fresh: DataFrame, columns: list[str]) -> DataFrame:
    """Records of which a column is null take all of these columns from fresh (by iteration and evaluator); others stay."""
    key = ["iteration", "evaluator"]
    lacking = F.lit(False)
    for c in columns:
        lacking = lacking | F.col(c).isNull()
    new = fresh.select(*key, *[F.col(c).alias(f"_new_{c}") for c in columns])
    joined = records.withColumn("_lacking", lacking).join(new, key, "left")
    return joined.select(*[F.when(F.col("_lacking"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in columns else c for c in records.columns])


def combined(generated: DataFrame, evaluations: DataFrame, order: list[str]) -> DataFrame:
    """Generated records with a map from evaluator to its first result for the iteration; evaluators without one have null."""
    names = evaluations.select("evaluator").distinct()
    first = evaluations.withColumn("_r", F.row_number().over(W.partitionBy("iteration", "evaluator").orderBy(*order))).where("_r = 1").drop("_r")
    value = F.struct(*[c for c in evaluations.columns if c not in ("iteration", "evaluator")])
    slots = generated.select("iteration").distinct().join(F.broadcast(names))
    filled = slots.join(first.select("iteration", "evaluator", value.alias("value")), ["iteration", "evaluator"], "left")
    maps = filled.groupBy("iteration").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("evaluator", "value")))).alias("evaluations"))
    return generated.join(maps, "iteration", "left")


def with_default(df: DataFrame, other: DataFrame, column: str) -> DataFrame:
    """df with an array column of other by iteration, empty where other has none."""
    joined = df.join(other.select("iteration", column), "iteration", "left")
    return joined.withColumn(column, F.coalesce(column, F.array().cast(dict(other.dtypes)[column])))


def runs(spark, root: str) -> DataFrame:
    """Model and evaluator of the result folders below root, which is partitioned by dataset, run_id and evaluator."""
    return spark.read.parquet(root).select("dataset", "run_id", "evaluator").distinct()


def from_start(all_iterations: DataFrame, done: DataFrame, start: int = 0) -> DataFrame:
    """Iterations from start on, or where that is 0 from the one after the last done, but those that are done."""
    first = start or last_iteration(done) + 1
    return all_iterations.where(F.col("iteration") >= first).join(done.select("iteration").distinct(), "iteration", "left_anti")
