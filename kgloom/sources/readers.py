"""Sources: graph files, keyword files, article files, result folders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.errors import AnalysisException

from kgloom.functions import parse, text
from kgloom.functions.search import sets_within

ARTICLE = T.StructType([T.StructField(n, T.StringType()) for n in ("ArticleID", "Title", "Keywords", "Abstract", "Database", "SearchKeywords")] + [T.StructField("KeywordsMatch", T.BooleanType()), T.StructField("body", T.StringType())])
TRIPLE = T.StructType([T.StructField(n, T.StringType()) for n in ("head", "relation", "tail")])


def text_or_empty(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a text file; none where it is missing."""
    try:
        return spark.read.text(path)
    except AnalysisException:
        return spark.createDataFrame([], "value string")


def raw_triples(lines: DataFrame) -> DataFrame:
    """Non-blank lines with quotes deleted, stripped, and their parts where there are three."""
    clean = lines.select(text.strip(F.regexp_replace("value", "['\"]", "")).alias("line")).where("line <> ''")
    parts = F.split(F.translate("line", "<>", ""), ", ")
    return clean.select("line", *[F.when(F.size(parts) == 3, text.strip(parts[i])).alias(n) for i, n in enumerate(("head", "relation", "tail"))])


def quoted_triples(lines: DataFrame) -> DataFrame:
    return lines.select(F.inline(parse.file_triples(F.col("value"))))


def whole_keywords(lines: DataFrame) -> DataFrame:
    """Each distinct whole line, stripped, as a keyword; a blank line is the empty keyword."""
    return lines.select(text.strip(F.col("value")).alias("keyword")).distinct()


def load_keywords(spark: SparkSession, path: str) -> DataFrame:
    return whole_keywords(spark.read.text(path))


def joined_lines(df: DataFrame, line: str, by: list[str], order: str) -> DataFrame:
    """Each group's lines in order, joined by a comma and a space."""
    ordered = F.array_sort(F.collect_list(F.struct(order, line)))
    return df.groupBy(*by).agg(F.array_join(F.transform(ordered, lambda x: x[line]), ", ").alias("joined"))


def keyword_lines(lines: DataFrame, order: str = "line_no") -> DataFrame:
    """Non-blank stripped lines with their number, from 0, and the number of all lines."""
    clean = lines.select(order, text.strip(F.col("value")).alias("line")).where("line <> ''")
    return dense_index(clean, order, "index")


def dense_index(df: DataFrame, order: str, name: str, rows_per_bucket: int = 1_000_000) -> DataFrame:
    """Adds 0-based places in the order of a numeric column, without a window over all rows: rows are numbered within value ranges, whose sizes are summed before them."""
    lo, hi, n = df.agg(F.min(order), F.max(order), F.count(F.lit(1))).first()
    if not n:
        return df.withColumn(name, F.lit(0).cast("long"))
    width = max(1, (int(hi) - int(lo) + 1) * rows_per_bucket // n)
    bucketed = df.withColumn("_bucket", F.floor((F.col(order) - F.lit(lo)) / width))
    sizes = bucketed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    starts = sizes.withColumn("_start", F.sum("_n").over(W.orderBy("_bucket").rowsBetween(W.unboundedPreceding, 0)) - F.col("_n")).select("_bucket", "_start")
    place = F.row_number().over(W.partitionBy("_bucket").orderBy(order)) - 1
    return bucketed.withColumn("_place", place).join(starts, "_bucket").withColumn(name, (F.col("_start") + F.col("_place")).cast("long")).drop("_bucket", "_place", "_start")


def indexed_keywords(lines: DataFrame, iterations: DataFrame, order: str = "line_no") -> DataFrame:
    """Keywords of each iteration: those of line iteration modulo the number of lines."""
    numbered = keyword_lines(lines, order)
    n = numbered.agg(F.count(F.lit(1)).alias("_n"))
    wanted = iterations.select("iteration").join(F.broadcast(n)).withColumn("index", F.pmod("iteration", "_n").cast("long"))  # one row
    return wanted.join(numbered, "index").select("iteration", text.keyword_line(F.col("line")).alias("keywords"))


def random_line(lines: DataFrame, seed: int = 42) -> DataFrame:
    return lines.orderBy(F.rand(seed)).limit(1)


def relation_types(spark: SparkSession, path: str) -> DataFrame:
    """Non-blank stripped lines; a missing file is an error."""
    return spark.read.text(path).select(text.strip(F.col("value")).alias("relation")).where("relation <> ''")


def articles(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ARTICLE).json(path, multiLine=True)


def sample_articles(df: DataFrame, k: int = 1, seed: int = 42) -> DataFrame:
    return df.orderBy(F.rand(seed)).limit(k)


def fetch(documents: DataFrame, keywords: DataFrame, retmax: int, database: str = "source", block_rows: int = 2000) -> DataFrame:
    """Articles that hold all keywords of an iteration, at most retmax of each database, lowest ids first.

    The keyword sets are a query set: blocks of them, of bounded size, meet all documents where these are read, in one
    pass over each text, and only hits are shuffled.
    """
    wanted = keywords.select("iteration", "keywords")
    hits = held(documents, "text", wanted, F.col("keywords"), block_rows)
    ranked = hits.withColumn("_rank", F.row_number().over(W.partitionBy("iteration", database).orderBy("doc_id")))
    return ranked.where(F.col("_rank") <= retmax).drop("_rank")


def held(texts: DataFrame, column: str, sets: DataFrame, words: Column, block_rows: int) -> DataFrame:
    """texts with each row of sets whose words (an array) the column holds all; sets come in blocks of bounded size."""
    found = texts.join(sets, F.lit(False))
    listed = sets.withColumn("_words", words)
    for block in local_blocks(listed, block_rows):
        rows = [tuple(r) for r in block.collect()]
        numbered = texts.sparkSession.createDataFrame([(i, *r[:-1]) for i, r in enumerate(rows)], T.StructType([T.StructField("_set", T.IntegerType()), *sets.schema.fields]))
        within = sets_within(texts.sparkSession, [r[-1] for r in rows])
        marked = texts.withColumn("_sets", within(F.col(column))).where(F.size("_sets") > 0).withColumn("_set", F.explode("_sets")).drop("_sets")
        found = found.union(marked.join(F.broadcast(numbered), "_set").drop("_set"))
    return found


def local_blocks(df: DataFrame, rows: int):
    """df as local tables of at most so many rows, streamed to the driver a partition at a time."""
    block = []
    for row in df.toLocalIterator():
        block.append(row)
        if len(block) >= rows:
            yield df.sparkSession.createDataFrame(block, df.schema)
            block = []
    if block:
        yield df.sparkSession.createDataFrame(block, df.schema)


def results_or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A result table; without rows where it was never written."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def triple_csv(spark: SparkSession, path: str, trim: bool = False) -> DataFrame:
    return spark.read.schema(TRIPLE).csv(path, header=False, ignoreLeadingWhiteSpace=trim, ignoreTrailingWhiteSpace=trim)


def whole_file(spark: SparkSession, path: str) -> str:
    """A small configuration file's text."""
    row = spark.read.text(path, wholetext=True).first()
    return row[0] if row else ""


class ArticleSource(DataSource):
    """A stand-in for remote article search: spark.read.format("kgloom_articles").option("client", "module:function"). The function takes keywords and a database and returns records."""

    @classmethod
    def name(cls) -> str:
        return "kgloom_articles"

    def schema(self) -> T.StructType:
        return ARTICLE

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _ArticleReader(self.options)


class _Search(InputPartition):
    def __init__(self, database: str):
        self.database = database


class _ArticleReader(DataSourceReader):
    def __init__(self, options):
        self.options = dict(options)

    def partitions(self):
        return [_Search(d) for d in self.options.get("databases", "local").split(",")]

    def read(self, partition):
        import importlib
        import math

        module, _, function = self.options["client"].partition(":")
        keywords = self.options.get("keywords", "").split(", ")
        retmax = int(self.options.get("retmax", "10"))
        records = getattr(importlib.import_module(module), function)(" AND ".join(keywords), partition.database, math.ceil(1.5 * retmax))
        for r in records[:retmax]:
            listed = r.get("Keywords") or ""
            match = any(k.lower() in listed.lower() for k in keywords)
            yield (r.get("ArticleID"), r.get("Title"), listed, r.get("Abstract"), partition.database, ", ".join(keywords), match, r.get("body"))
