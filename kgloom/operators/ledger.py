"""What models were asked: answers, dead letters, which iterations used a prompt, calls of a day. A prompt that was answered is never asked again."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgloom.operators.judge import Judge, replies
from kgloom.sources.readers import results_or_empty

ANSWERS = "key string, answer string, attempts int, seconds double, run long, step string"
LETTERS = "key string, prompt string, attempts int, error string, seconds double, run long, step string"
USES = "iteration long, key string, run long, step string"
CALLS = "day string, source string, calls long"


@dataclass
class Ledger:
    """Tables below folder, appended to only, so a run that breaks off loses no answer that was written.

    per_day: of each source (the part of a step before the first colon) at most so many calls a day; prompts beyond stay
    unasked, as dead letters of 0 attempts, for another day.
    """

    spark: SparkSession
    folder: str
    keep: Callable[[DataFrame, str], DataFrame]
    per_day: int | None = None
    today: Callable[[], str] = lambda: time.strftime("%Y-%m-%d", time.gmtime())

    def _read(self, name: str, schema: str) -> DataFrame:
        kind = self.spark.createDataFrame([], schema).schema
        return results_or_empty(self.spark, f"{self.folder}/{name}", kind)

    def _append(self, df: DataFrame, name: str, schema: str) -> None:
        by = ["step"] if "step" in df.columns else []
        columns = [c.split()[0] for c in schema.split(", ")]
        df.select(*columns).write.mode("append").partitionBy(*by).parquet(f"{self.folder}/{name}")

    def answers(self, step: str | None = None) -> DataFrame:
        found = self._read("answers", ANSWERS)
        return found if step is None else found.where(F.col("step") == step)

    def letters(self) -> DataFrame:
        """Every failure, each run's apart."""
        return self._read("letters", LETTERS)

    def uses(self) -> DataFrame:
        return self._read("uses", USES)

    def ask(self, step: str, judge: Judge, df: DataFrame, owners: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
        """(df with answer, iterations of which a prompt has no answer). owners: from rows of df, with a column _key, to iteration and _key.

        Rows of one prompt are asked once, and not at all where the step's prompt was answered before. A judge's prompt
        is its attribute of that name, else all columns of df.
        """
        prompt = getattr(judge, "prompt", None)
        prompt = F.to_json(F.struct(*df.columns)) if prompt is None else prompt
        run = time.time_ns()
        text = F.coalesce(prompt, F.lit(""))
        keyed = self.keep(df.withColumn("_key", F.sha2(text, 256)).withColumn("_prompt", text), "prompts")
        known = self.answers(step).select(F.col("key").alias("_key"))
        todo = keyed.join(known, "_key", "left_anti").dropDuplicates(["_key"])
        asked = self.keep(self._within_day(step, todo, judge), "replies").withColumns({"step": F.lit(step), "run": F.lit(run), "key": F.col("_key"), "prompt": F.col("_prompt")})
        self._append(asked.where(F.col("answer").isNotNull()), "answers", ANSWERS)
        self._append(asked.where(F.col("answer").isNull()), "letters", LETTERS)
        used = owners(keyed.drop("_prompt")).select(F.col("iteration").cast("long").alias("iteration"), F.col("_key").alias("key")).distinct()
        used = self.keep(used.withColumns({"step": F.lit(step), "run": F.lit(run)}), "uses")
        self._append(used, "uses", USES)
        now = self.answers(step).select(F.col("key").alias("_key"), "answer")
        lacking = used.join(now.withColumnRenamed("_key", "key"), "key", "left_anti").select("iteration").distinct()
        return keyed.drop("_prompt").join(now, "_key", "left").drop("_key"), lacking

    def _within_day(self, step: str, todo: DataFrame, judge: Judge) -> DataFrame:
        if self.per_day is None:
            return replies(judge, todo)
        source, day = step.split(":")[0], self.today()
        made = self._read("calls", CALLS).where((F.col("source") == source) & (F.col("day") == day)).agg(F.sum("calls")).first()[0] or 0
        room = max(0, self.per_day - made) // getattr(judge, "retries", 1)  # should each prompt need all its attempts
        todo = self.keep(todo, "todo-today")
        first = todo.select("_key").orderBy("_key").limit(room)
        asked = self.keep(replies(judge, todo.join(first, "_key", "left_semi")), "replies-today")
        calls = asked.agg(F.coalesce(F.sum("attempts"), F.lit(0)).cast("long").alias("calls"))
        self._append(calls.withColumns({"day": F.lit(day), "source": F.lit(source)}), "calls", CALLS)
        rest = todo.join(first, "_key", "left_anti")
        return asked.unionByName(rest.withColumns({"answer": F.lit(None).cast("string"), "attempts": F.lit(0), "error": F.lit("the day's calls are used up"), "seconds": F.lit(0.0)}))

    def dead(self, done: DataFrame) -> DataFrame:
        """step, iteration, key, prompt, attempts, error (the last one): prompts without an answer that iterations, but for those done (step, iteration), wait for. A step's iterations are done by the part of its name before the last colon."""
        lost = self.letters().join(self.answers().select("step", "key"), ["step", "key"], "left_anti")
        lost = lost.groupBy("step", "key").agg(F.first("prompt").alias("prompt"), F.sum("attempts").alias("attempts"), F.max_by("error", "run").alias("error"))
        waiting = self.uses().groupBy("step", "key", "iteration").agg(F.max("run").alias("run"))
        latest = self.uses().groupBy("step", "iteration").agg(F.max("run").alias("run"))  # prompts of earlier runs may have been replaced
        waiting = waiting.join(latest, ["step", "iteration", "run"], "left_semi").withColumn("_stage", F.regexp_replace("step", ":[^:]*$", ""))
        open_ = waiting.join(done.select(F.col("step").alias("_stage"), "iteration"), ["_stage", "iteration"], "left_anti")
        return open_.join(lost, ["step", "key"]).select("step", "iteration", "key", "prompt", "attempts", "error")

    def timing(self) -> DataFrame:
        """step, iteration, n_prompts, attempts, seconds: what the prompts that an iteration used took, inside the clients' tasks; a prompt that several iterations use counts in each."""
        spent = self.answers().select("step", "key", "attempts", "seconds").unionByName(self.letters().select("step", "key", "attempts", "seconds"))
        spent = spent.groupBy("step", "key").agg(F.sum("attempts").alias("attempts"), F.sum("seconds").alias("seconds"))
        used = self.uses().select("step", "iteration", "key").distinct()
        return used.join(spent, ["step", "key"]).groupBy("step", "iteration").agg(F.count(F.lit(1)).alias("n_prompts"), F.sum("attempts").alias("attempts"), F.sum("seconds").alias("seconds"))


def work_table(spark: SparkSession, folder: str) -> Callable[[DataFrame, str], DataFrame]:
    """A keep function: a table of its own below folder, read back."""

    def keep(df: DataFrame, name: str) -> DataFrame:
        path = f"{folder}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    return keep
