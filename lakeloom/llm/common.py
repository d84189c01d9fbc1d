"""Helpers shared by the training-data operators: the shared folder, Arrow glue."""

from __future__ import annotations

import ctypes
import sys
import tempfile
import types
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes in an Arrow batch handed to Python, a row at least; bounds a worker's memory with long texts.
BATCH_BYTES = 4 << 20

_own_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir).

    Only where that setting is absent and Spark runs on one machine, as in
    tests, a temporary folder takes its place.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_folders:
        _own_folders[app] = "file://" + tempfile.mkdtemp(prefix="lakeloom-")
    return _own_folders[app]


def _path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, deleted when the application ends."""
    path = f"{shared_folder(spark)}/lakeloom/{name}-{uuid.uuid4().hex}"
    at, fs = _path(spark, path)
    fs.deleteOnExit(at)
    return path


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete a table that nothing reads any more."""
    at, fs = _path(spark, path)
    fs.delete(at, True)


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends at files that survive executors."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bound_batches(spark: SparkSession) -> None:
    """Bound the session's Arrow batches in bytes, if they aren't: Spark reads that setting when a query runs.

    Results don't depend on it.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key)) > BATCH_BYTES:
        spark.conf.set(key, f"{BATCH_BYTES}b")


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, after which the worker gives freed memory back; workers live on and would keep their peak."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
                libc.malloc_trim(0)

    return wrapped


def map_texts(df: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """Apply work to each Arrow batch of df."""
    bound_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield work(batch)

    return df.mapInArrow(trimmed(run), schema)


def text_of(column: str = "text") -> Column:
    """The text column with null read as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit("")).alias("text")


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, letters in either case."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def pieces_by_size(batch: pa.RecordBatch, column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Slices of batch with about limit bytes of column each (one row at least)."""
    sizes = pa.compute.binary_length(batch.column(column)).to_pylist()
    start = total = 0
    for i, size in enumerate(sizes):
        if total and total + (size or 0) > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += size or 0
    if start < batch.num_rows:
        yield batch.slice(start)


class OncePerTask:
    """A value that is built on first use where it is needed and never pickled."""

    def __init__(self, build: Callable[[], object]):
        self.build = build

    def __call__(self):
        if "value" not in self.__dict__:
            self.value = self.build()
        return self.value

    def __getstate__(self) -> dict:
        return {"build": self.build}


class OncePerWorker(OncePerTask):
    """A value that a worker builds on first use and keeps for later tasks, which need it under the same name.

    Functions are pickled by value, so what outlives a task lives in a module
    made for it. The value must not change what tasks give, only save time.
    """

    def __init__(self, name: str, build: Callable[[], object]):
        self.name, self.build = name, build

    def __call__(self):
        kept = sys.modules.setdefault("_kept_by_worker", types.ModuleType("_kept_by_worker")).__dict__
        if self.name not in kept:
            kept[self.name] = self.build()
        return kept[self.name]

    def __getstate__(self) -> dict:
        return {"name": self.name, "build": self.build}
