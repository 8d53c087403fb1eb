"""Helpers shared by the operators: shipping the package to Python workers and reading tables."""

from __future__ import annotations

import contextlib
import ctypes
import io
import os
import zipfile
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from squall.llm import words
from squall.session import cut_lineage, shared_dir

_PACKAGE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def ship(spark: SparkSession) -> None:
    """Give every Python worker this package, once per session: as an archive in the shared folder
    that Spark hands to the executors (no fixed path on them is needed)."""
    sc = spark.sparkContext
    if getattr(sc, "_squall_shipped", False):
        return
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(_PACKAGE):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, os.path.dirname(_PACKAGE)))
    path = shared_dir(spark, "squall-package") + ".zip"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(sc._jsc.hadoopConfiguration()).create(target)
    stream.write(out.getvalue())
    stream.close()
    sc.addPyFile(path)
    sc._squall_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a data folder, through Spark's reader only."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_kept: list = []


def kept(function):
    """Keep the last two results of ``function`` in a worker, which Spark uses again for later jobs,
    until another job asks for room with ``alone``."""
    cached = lru_cache(maxsize=2)(function)
    _kept.append(cached)
    return cached


def alone(*needed) -> None:
    """Drop what the functions under ``kept`` left in this worker, but for those ``needed``."""
    for cached in _kept:
        if cached not in needed:
            cached.cache_clear()
    give_back()


def give_back() -> None:
    """Return the memory that finished arrays have left with the allocators of this worker, which
    Spark uses again for the next job's tasks."""
    words.forget()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):      # where the C library has no such call
        ctypes.CDLL(None).malloc_trim(0)


def map_arrow(df: DataFrame, function, schema: str) -> DataFrame:
    """``mapInArrow`` with the package shipped; each task gives its memory back."""
    ship(df.sparkSession)

    def run(batches):
        yield from function(batches)
        give_back()

    return df.mapInArrow(run, schema)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def pinned(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: the result no longer depends on executors that
    computed it."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def arrow_function(function, kind: str):
    """A column function on whole Arrow arrays; its one argument and its result are arrays."""
    def call(values: pa.Array) -> pa.Array:
        result = function(values)
        give_back()
        return result

    return F.arrow_udf(call, kind)


class Scratch:
    """Tables written to the shared folder for one job, removed with ``drop``."""

    def __init__(self, spark: SparkSession):
        self._spark, self._paths = spark, []

    def pin(self, df: DataFrame, name: str) -> DataFrame:
        path = shared_dir(self._spark, name)
        self._paths.append(path)
        df.write.parquet(path)
        return self._spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        """Remove the tables; nothing that is still to be computed may read them."""
        jvm, conf = self._spark._jvm, self._spark.sparkContext._jsc.hadoopConfiguration()
        while self._paths:
            path = jvm.org.apache.hadoop.fs.Path(self._paths.pop())
            path.getFileSystem(conf).delete(path, True)


def packed(df: DataFrame, **columns) -> DataFrame:
    """``df`` with all its columns in one, ``row``, beside the given ones, so that no name of an
    operator's own can clash with one of the table's."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *[c.alias(n) for n, c in columns.items()])


def unpacked(df: DataFrame) -> DataFrame:
    return df.select("row.*")


def crc_of(name: str):
    """crc32 of a value written as text; null for null."""
    return F.crc32(F.col(name).cast("string"))


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name), F.lit(""))


__all__ = ["ship", "table", "map_arrow", "column", "pinned", "Scratch", "cut_lineage", "shared_dir", "text_or_empty"]
