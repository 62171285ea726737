"""Articles as a stream: each micro-batch is chunked and written to its own partition, so a batch that runs again replaces itself."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from kgloom.operators.retrieve import sentence_chunks


def chunk_stream(spark: SparkSession, source: str, schema: StructType, target: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] = sentence_chunks, files_per_batch: int = 100) -> StreamingQuery:
    """Starts a query that turns new Parquet files of articles to chunks under target/batch=N, and stops when it has read what is there."""

    def write(batch: DataFrame, n: int) -> None:
        transform(batch).withColumn("batch", F.lit(n)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(target)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
