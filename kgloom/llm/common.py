"""Helpers of the training-data operators: shared scratch tables, names, ASCII lower case, the split by crc32."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII letters as lower-casing maps them, and ASCII white space.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANKS = " \t\n\x0b\f\r"

try:
    _libc = ctypes.CDLL("libc.so.6")
except OSError:  # another C library keeps its own ways
    _libc = None

_own: list[str] = []
_written: list[tuple[SparkSession, str]] = []


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """The shared folder that the cluster names; one of our own only where none is set and all run on this machine (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not folder and not _own:
        _own.append(f"file://{tempfile.mkdtemp(prefix='kgloom-')}")
    return (folder or _own[0]).rstrip("/")


@contextmanager
def _swept(spark: SparkSession):
    """Shuffle files of what runs here go when it ends, not when the driver's garbage collector finds them unused."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def stored(df: DataFrame, label: str, codec: str = "snappy") -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends there, and a lost executor costs no recomputation beyond it."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/{label}-{uuid.uuid4().hex}"
    with _swept(spark):
        df.write.parquet(path, compression=codec)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def stored_by(df: DataFrame, column: str, values: tuple, label: str, codec: str = "snappy") -> dict:
    """As stored, with a table for each value of an int column, which they lack; each can be discarded alone."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/{label}-{uuid.uuid4().hex}"
    with _swept(spark):
        df.write.partitionBy(column).parquet(path, compression=codec)
    schema, out = df.drop(column).schema, {}
    for v in values:
        at = f"{path}/{column}={v}"
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(target)
        _written.append((spark, at))
        out[v] = spark.read.schema(schema).parquet(at)
        out[v]._stored_at = at
    _written.append((spark, path))
    return out


def release() -> None:
    """Gives a Python worker's freed memory back, since the worker lives on for the tasks of later steps."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def discard(df: DataFrame) -> None:
    """Deletes a stored table that nothing reads any more."""
    path = df._stored_at
    _written.remove((df.sparkSession, path))
    _delete(df.sparkSession, path)


@atexit.register
def _remove() -> None:
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  the session has ended; the folder's owner clears it
            return


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like those given that df doesn't have, in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(n))
