"""Helpers shared by the operators: tables, scratch tables in the shared folder, batches."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeline.session import ensure_checkpoint_dir, ship

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the given tables; the package is sent to the workers on first use."""
    ship(spark)
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


class Scratch:
    """Tables written once to the shared folder of ``spark.checkpoint.dir``.

    A written table cuts the lineage and survives lost executors. ``add`` appends to a table,
    so that a loop over blocks keeps only one block's shuffle on disk: shuffle files go
    when their write ends (a lost one is made again by Spark's stage retry). ``drop``
    removes a table no plan needs any more; tables the returned frame reads stay.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        ship(spark)
        self.spark = spark
        self.root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def add(self, df: DataFrame, name: str, batch_rows: int | None = None, **options: str) -> None:
        """Append ``df``; ``batch_rows`` bounds the Arrow batches of a plan whose rows are large."""
        conf = {_CLEANUP: "true"} | ({_BATCH_ROWS: str(batch_rows)} if batch_rows else {})
        before = {key: self.spark.conf.get(key, None) for key in conf}
        for key, value in conf.items():
            self.spark.conf.set(key, value)
        try:
            writer = df.write.mode("append").option("compression", "zstd")
            for key, value in options.items():
                writer = writer.option(key.replace("__", "."), value)
            writer.parquet(self.path(name))
        finally:
            for key, value in before.items():
                if value is None:
                    self.spark.conf.unset(key)
                else:
                    self.spark.conf.set(key, value)

    def read(self, name: str, schema) -> DataFrame:
        return self.spark.read.schema(schema).parquet(self.path(name))

    def settle(self, df: DataFrame, name: str, batch_rows: int | None = None, **options: str) -> DataFrame:
        self.add(df, name, batch_rows, **options)
        return self.read(name, df.schema)

    def drop(self, name: str) -> None:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path(name))
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def release() -> None:
    """Give a worker's freed memory back to the system: workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library: it keeps what it keeps


def tidy(function: Callable) -> Callable:
    """A function over batches that gives its memory back when a task ends."""

    def run(batches):
        try:
            yield from function(batches)
        finally:
            release()

    return run


def shuffle_width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def only(df: DataFrame, *columns: str) -> DataFrame:
    """The named columns alone: others, whatever their names, never reach an operator."""
    return df.select(*[F.col(f"`{c}`") for c in columns])


def texts_of(column: pa.ChunkedArray | pa.Array) -> Iterator[str]:
    """Texts of a column one by one, null as empty."""
    for value in column:
        yield value.as_py() or ""


def bytes_of(column: pa.Array) -> Iterator[bytes]:
    """UTF-8 bytes of a text or binary column one by one, null as empty."""
    cast = column.cast(pa.large_binary())
    for value in cast:
        yield value.as_py() or b""
