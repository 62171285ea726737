"""Judges: whatever answers a prompt. Operators see a DataFrame with an answer column and never which judge gave it."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Judge(Protocol):
    def __call__(self, df: DataFrame) -> DataFrame:
        """df with a nullable string column answer; null where none came."""
        ...


#: What a judge may tell beside the answer, and what counts where it doesn't.
REPLY = {"answer": "string", "attempts": "int", "error": "string", "seconds": "double"}


def replies(judge: Judge, df: DataFrame) -> DataFrame:
    """df with answer, attempts, error and seconds; a missing answer without an error gets one."""
    out = judge(df)
    for name, kind in REPLY.items():
        if name not in out.columns:
            out = out.withColumn(name, F.lit({"attempts": 1, "seconds": 0.0}.get(name)).cast(kind))
    return out.withColumn("error", F.when(F.col("answer").isNull(), F.coalesce("error", F.lit("no answer"))))


class ExpressionJudge:
    """Answers by an expression over df's columns: TRUE or FALSE for a boolean one."""

    def __init__(self, expression: Column | str):
        self.expression = F.expr(expression) if isinstance(expression, str) else expression

    def __call__(self, df: DataFrame) -> DataFrame:
        answer = df.select(self.expression.alias("a"))
        said = F.when(self.expression, "TRUE").otherwise("FALSE") if dict(answer.dtypes)["a"] == "boolean" else self.expression
        return df.withColumn("answer", said)


class ReplayJudge:
    """Recorded answers by the hash of the prompt: columns prompt_key, answer. Prompts without a record get null."""

    def __init__(self, answers: DataFrame, prompt: Column):
        self.answers, self.prompt = answers, prompt

    @staticmethod
    def key(prompt: Column) -> Column:
        return F.sha2(prompt, 256)

    def __call__(self, df: DataFrame) -> DataFrame:
        keyed = df.withColumn("prompt_key", self.key(self.prompt))
        return keyed.join(self.answers.select("prompt_key", "answer").dropDuplicates(["prompt_key"]), "prompt_key", "left").drop("prompt_key")


class ClientJudge:
    """Asks a client: make() runs once a task and returns a function from prompt to answer.

    A call that raises, or whose answer is blank, is tried again, retries times in all, after a pause of delay seconds
    that grows by the factor growth up to longest; then the answer is null and error tells why. A task has in_flight
    calls under way at most. With per_second the prompts go to so many tasks, each of which starts a call every
    tasks / per_second seconds, so all together stay under the rate however many cores there are.
    """

    def __init__(self, make: Callable[[], Callable[[str], str]], prompt: Column, retries: int = 3, delay: float = 0.0, growth: float = 2.0, longest: float = 60.0, in_flight: int = 1, per_second: float | None = None, tasks: int = 4):
        if retries < 1 or in_flight < 1 or tasks < 1 or per_second is not None and per_second <= 0:
            raise ValueError("retries, in_flight, tasks and per_second are positive")
        self.make, self.prompt, self.retries, self.tasks, self.per_second = make, prompt, retries, tasks, per_second
        self.pauses = [min(longest, delay * growth**i) for i in range(retries - 1)]
        self.in_flight, self.gap = in_flight, 0.0 if per_second is None else tasks / per_second

    def __call__(self, df: DataFrame) -> DataFrame:
        from pyspark.sql.functions import pandas_udf
        from pyspark.sql.pandas.functions import PandasUDFType

        ask = _asker(self.make, self.pauses, self.in_flight, self.gap)
        schema = ", ".join(f"{n} {t}" for n, t in REPLY.items())
        asking = pandas_udf(ask, schema, PandasUDFType.SCALAR_ITER).asNondeterministic()  # so a filter doesn't ask twice
        spread = df if self.per_second is None else df.repartition(self.tasks)
        return spread.withColumn("_reply", asking(self.prompt)).select(*df.columns, "_reply.*")


def _asker(make, pauses: list[float], in_flight: int, gap: float):
    def ask(series: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        from concurrent.futures import ThreadPoolExecutor
        from threading import Lock

        client, turn, due = make(), Lock(), [0.0]

        def wait() -> None:
            if gap:
                with turn:  # calls of a task start a gap apart
                    now = time.monotonic()
                    start = max(now, due[0])
                    due[0] = start + gap
                time.sleep(start - now)

        def one(prompt: str) -> tuple[str | None, int, str | None, float]:
            seconds, error = 0.0, None
            for attempt, pause in enumerate([*pauses, None], 1):
                wait()
                began = time.monotonic()
                try:
                    answer = client(prompt)
                    error = "blank answer" if not (answer or "").strip() else None
                except Exception as e:  # noqa: BLE001  a client may fail in any way
                    error = f"{type(e).__name__}: {e}"[:500]
                seconds += time.monotonic() - began
                if error is None:
                    return answer, attempt, None, seconds
                if pause:
                    time.sleep(pause)
            return None, len(pauses) + 1, error, seconds

        with ThreadPoolExecutor(in_flight) as pool:
            for s in series:
                yield pd.DataFrame(list(pool.map(one, s)), columns=list(REPLY)).astype({"answer": object, "attempts": "int32", "error": object, "seconds": "float64"})

    return ask


#: Backends by family name; each makes a judge from a prompt column.
BACKENDS: dict[str, Callable[..., Judge]] = {"replay": ReplayJudge, "client": ClientJudge, "expression": ExpressionJudge}


def backend(name: str) -> Callable[..., Judge]:
    family = name.split("-")[0]
    if family not in BACKENDS:
        raise ValueError(f"no backend {name!r}; there are {', '.join(BACKENDS)}")
    return BACKENDS[family]
