"""Article search by id batches: searches give ids, ids are read in batches, ids that fail go to a table of their own and can be read again."""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from kgloom.functions import text
from kgloom.sources.readers import results_or_empty

#: Fixed value: how many more ids than articles a search asks for, as some can't be read.
OVER_FETCH = 1.5

FOUND = "iteration long, database string, place int, article_id string, error string"
ARTICLES = "database string, article_id string, title string, keywords string, abstract string, body string"
FAILED = "database string, article_id string, attempts int, error string, run long"


class Pace:
    """Calls of a task at least gap seconds apart, tried again after a growing pause."""

    def __init__(self, gap: float, retries: int, delay: float):
        self.gap, self.retries, self.delay, self.due = gap, retries, delay, 0.0

    def call(self, f: Callable, *args):
        """(result, None, attempts) or (None, error, attempts)."""
        for attempt in range(1, self.retries + 1):
            now = time.monotonic()
            if now < self.due:
                time.sleep(self.due - now)
            self.due = max(now, self.due) + self.gap
            try:
                return f(*args), None, attempt
            except Exception as e:  # noqa: BLE001  a client may fail in any way
                error = f"{type(e).__name__}: {e}"[:500]
            if attempt < self.retries and self.delay:
                time.sleep(self.delay * 2 ** (attempt - 1))
        return None, error, self.retries


@dataclass
class ArticleStore:
    """Searches and reads articles by a client, and keeps what it read below folder.

    make() runs once a task and returns an object with search(query, database, limit), which gives ids, best first, and
    fetch(ids, database), which gives a dict from id to a record (title, keywords, abstract, body; what lacks is empty).
    An id that fetch leaves out, or whose batch still fails when it is read alone, has failed. tasks tasks call the
    client side by side, per_second calls a second in all.
    """

    spark: SparkSession
    folder: str
    make: Callable[[], object]
    databases: tuple[str, ...]
    retmax: int = 10
    batch: int = 20
    tasks: int = 4
    per_second: float | None = None
    retries: int = 3
    delay: float = 0.0

    def _read(self, name: str, schema: str) -> DataFrame:
        return results_or_empty(self.spark, f"{self.folder}/{name}", self.spark.createDataFrame([], schema).schema)

    def articles(self) -> DataFrame:
        return self._read("articles", ARTICLES)

    def found(self) -> DataFrame:
        """Ids of each search by place, and a row with an error for each search that failed."""
        return self._read("found", FOUND)

    def failed(self) -> DataFrame:
        """database, article_id, attempts, error (the last one) of ids that were never read."""
        lost = self._read("failed", FAILED).join(self.articles(), ["database", "article_id"], "left_anti")
        return lost.groupBy("database", "article_id").agg(F.sum("attempts").alias("attempts"), F.max_by("error", "run").alias("error"))

    def _pace(self) -> Pace:
        return Pace(self.tasks / self.per_second if self.per_second else 0.0, self.retries, self.delay)

    def search(self, keywords: DataFrame) -> None:
        """Searches of the iterations (iteration, keywords) that no search has answered, in each database, then reads the new ids."""
        make, pace, limit = self.make, self._pace(), math.ceil(OVER_FETCH * self.retmax)

        def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            client = make()
            for frame in frames:
                for r in frame.itertuples():
                    ids, error, _ = pace.call(client.search, r.query, r.database, limit)
                    rows = [(r.iteration, r.database, i, str(x), None) for i, x in enumerate(ids[:limit])] if error is None else [(r.iteration, r.database, -1, None, error)]
                    yield pd.DataFrame(rows or [(r.iteration, r.database, -1, None, None)], columns=["iteration", "database", "place", "article_id", "error"]).astype({"iteration": "int64", "place": "int32", "article_id": object, "error": object})

        asked = keywords.select(F.col("iteration").cast("long").alias("iteration"), F.array_join("keywords", " AND ").alias("query"), F.explode(F.array(*map(F.lit, self.databases))).alias("database"))
        answered = self.found().where("error is null").select("iteration", "database").distinct()
        todo = asked.join(answered, ["iteration", "database"], "left_anti").repartition(self.tasks)
        todo.mapInPandas(ask, FOUND).write.mode("append").parquet(f"{self.folder}/found")
        known = self.articles().select("database", "article_id").union(self._read("failed", FAILED).select("database", "article_id"))
        ids = self.found().where("article_id is not null").select("database", "article_id").distinct()
        self._fetch(ids.join(known.distinct(), ["database", "article_id"], "left_anti"))

    def refetch(self) -> None:
        """Reads the failed ids again."""
        self._fetch(self.failed().select("database", "article_id"))

    def _fetch(self, ids: DataFrame) -> None:
        make, pace, batch = self.make, self._pace(), self.batch
        fields = ["title", "keywords", "abstract", "body"]

        def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            client = make()

            def get(database: str, some: list[str]) -> Iterator[tuple]:
                records, error, attempts = pace.call(client.fetch, some, database)
                if error is not None and len(some) > 1:  # one bad id may spoil its batch
                    for x in some:
                        yield from get(database, [x])
                    return
                for x in some:
                    record = (records or {}).get(x)
                    if record is None:
                        yield (database, x, None, None, None, None, attempts, error or "no record")
                    else:
                        yield (database, x, *[record.get(f) or "" for f in fields], attempts, None)

            for frame in frames:
                for database, some in frame.groupby("database")["article_id"]:
                    some = list(some)
                    for lo in range(0, len(some), batch):
                        rows = list(get(database, some[lo : lo + batch]))
                        yield pd.DataFrame(rows, columns=["database", "article_id", *fields, "attempts", "error"]).astype({"attempts": "int32", "error": object} | dict.fromkeys(fields, object))

        run = time.time_ns()
        got = ids.repartition(self.tasks, "database", "article_id").mapInPandas(read, f"{ARTICLES}, attempts int, error string")
        path = f"{self.folder}/read/run={run}"
        got.write.parquet(path)  # so each id is asked for once
        stored = self.spark.read.schema(got.schema).parquet(path)
        stored.where("error is null").select(*[c.split()[0] for c in ARTICLES.split(", ")]).write.mode("append").parquet(f"{self.folder}/articles")
        stored.where("error is not null").select("database", "article_id", "attempts", "error", F.lit(run).alias("run")).write.mode("append").parquet(f"{self.folder}/failed")

    def results(self, keywords: DataFrame) -> DataFrame:
        """The retmax first articles of each iteration and database that could be read, as records: iteration, place, ArticleID, Title, Keywords, Abstract, Database, SearchKeywords, KeywordsMatch, body."""
        read = self.found().where("article_id is not null").join(self.articles(), ["database", "article_id"])
        read = read.withColumn("_r", F.row_number().over(W.partitionBy("iteration", "database").orderBy("place"))).where(F.col("_r") <= self.retmax).drop("_r")
        asked = keywords.select(F.col("iteration").cast("long").alias("iteration"), F.col("keywords").alias("_asked"))
        match = text.any_keyword_in(F.col("_asked"), F.col("keywords"))
        return read.join(asked, "iteration").select(
            "iteration", "place", F.col("article_id").alias("ArticleID"), F.col("title").alias("Title"), F.col("keywords").alias("Keywords"), F.col("abstract").alias("Abstract"),
            F.col("database").alias("Database"), text.keyword_query(F.col("_asked")).alias("SearchKeywords"), match.alias("KeywordsMatch"), text.body(F.col("body"), F.col("abstract")).alias("body"),
        )
