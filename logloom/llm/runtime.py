"""Helpers of the operators: shared tables, and memory of Python workers."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ..session import ship  # noqa: F401

#: Rows of about so many bytes are worked on at a time.
BATCH = 4 << 20


#: Folders that ``saved`` has written and nobody has deleted yet.
_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all machines share: spark.checkpoint.dir, or on one machine one of our own where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        found = Path(tempfile.gettempdir(), "logloom-checkpoints").as_uri()
    return found.rstrip("/")


@contextlib.contextmanager
def freeing_shuffles(spark: SparkSession) -> Iterator[None]:
    """What runs here deletes its shuffle files at its end instead of when the driver next collects garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def saved(df: DataFrame, name: str) -> DataFrame:
    """The rows, written once to the shared folder and read from there, so that lost executors cost no more than a read.
    The caller discards the table, or whoever clears the folder."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/logloom/{name}-{uuid.uuid4().hex}"
    with freeing_shuffles(spark):
        df.write.parquet(path)
    _made.append(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def discard(df: DataFrame | None) -> None:
    """Deletes a table that ``saved`` wrote and nothing reads any more."""
    if df is None:
        return
    with contextlib.suppress(Exception):
        for file in df.inputFiles()[:1]:
            folder = file.rpartition("/")[0]
            _delete(df.sparkSession, folder)
            _made[:] = [p for p in _made if p.rpartition("/")[2] != folder.rpartition("/")[2]]


def tables_made() -> int:
    """How many tables there are now, for ``discard_since``."""
    return len(_made)


def discard_since(spark: SparkSession, before: int) -> None:
    """Deletes all tables but the last that were written since, when the last is all that is still read."""
    for folder in _made[before:-1]:
        _delete(spark, folder)
    del _made[before:-1]


#: What this worker has loaded, and the function whose task ran here last.
_loaded: list = []
_last = ""


def loaded(size: int) -> Callable:
    """``lru_cache`` for what tasks load (vocabularies, remembered words): a worker keeps it between tasks of one
    function and drops it when another's begins, as workers outlive stages."""

    def wrap(make: Callable) -> Callable:
        cache = lru_cache(maxsize=size)(make)
        _loaded.append(cache)
        return cache

    return wrap


def begin(function: str) -> None:
    """A task of ``function`` begins in this worker."""
    global _last
    if function != _last:
        for cache in _loaded:
            cache.cache_clear()
        _last = function


def in_parts(batches: Iterator, size: int = BATCH) -> Iterator:
    """Record batches cut into slices of about ``size`` bytes, a row at least."""
    for batch in batches:
        rows = max(1, int(batch.num_rows * size / max(batch.nbytes, 1)))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """The function over small batches, giving memory back to the system when a task ends, as Python workers live on."""

    function = f"{run.__module__}.{run.__qualname__}"

    def wrapped(batches: Iterator) -> Iterator:
        begin(function)
        try:
            yield from run(in_parts(batches))
        finally:
            import ctypes
            import gc

            import pyarrow as pa

            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(AttributeError, OSError):
                ctypes.CDLL(None).malloc_trim(0)

    return wrapped
