"""Intermediate tables in the folder that all executors share.

A written table cuts lineage: when an executor is lost, later stages read the
files again instead of recomputing what led to them.
"""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a side that may be broadcast; a larger one is joined by shuffle.
BROADCAST_BYTES = 32 << 20

_test_folder: list[str] = []
_written: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where that is unset, a temporary folder on a
    local master (tests) and an error on a cluster, whose machines would not share it."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    if not _test_folder:
        _test_folder.append(tempfile.mkdtemp(prefix="lodestone-"))
    return _test_folder[0]


def write(df: DataFrame, name: str) -> DataFrame:
    """Writes the table to the shared folder and returns it reread."""
    path = _new(df.sparkSession, name)
    with _shuffles_once(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def _shuffles_once(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is executed meanwhile go when it has been executed,
    not when the driver happens to collect garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def write_parts(df: DataFrame, name: str, by: str, *values: str) -> list[DataFrame]:
    """Writes the table and returns the parts that have these values in a text
    column, without that column; each can be dropped on its own."""
    spark, path = df.sparkSession, _new(df.sparkSession, name)
    with _shuffles_once(spark):
        df.write.partitionBy(by).parquet(path)
    schema, out = df.drop(by).schema, []
    for v in values:
        system, where = _files(spark, f"{path}/{by}={v}")
        out.append(spark.read.schema(schema).parquet(f"{path}/{by}={v}") if system.exists(where) else spark.createDataFrame([], schema))
    return out


def _new(spark: SparkSession, name: str) -> str:
    path = f"{shared_folder(spark)}/lodestone/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    system, where = _files(spark, path)
    system.deleteOnExit(where)  # when the application ends
    return path


def clear(spark: SparkSession) -> None:
    """Deletes all tables that this process has written; results that still read
    them have to be written out before."""
    while _written:
        system, path = _files(spark, _written.pop())
        system.delete(path, True)


def drop(*tables: DataFrame) -> None:
    """Deletes *written* tables, or parts, that nothing will read again,
    and lets the JVM clear the shuffles that only they had needed."""
    for df in tables:
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            system, where = _files(df.sparkSession, folder)
            system.delete(where, True)
    tidy(tables[0].sparkSession)


def tidy(spark: SparkSession) -> None:
    """Lets the JVM clear the shuffles of plans that nothing holds any more."""
    gc.collect()
    spark._jvm.System.gc()


def _files(spark: SparkSession, path: str):
    """The path and its file system, as the JVM's objects."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def broadcast_if_small(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Marks a *written* table for broadcast when its rows at ``row_bytes`` each,
    and the texts in its columns, stay under ``limit``; beyond it the join shuffles."""
    texts = [F.coalesce(F.octet_length(f"`{c}`"), F.lit(0)) for c, kind in df.dtypes if kind in ("string", "binary")]
    size = F.sum(sum(texts, F.lit(row_bytes)).cast("long"))
    return F.broadcast(df) if (df.agg(size).first()[0] or 0) <= limit else df


def unused(name: str, columns: list[str]) -> str:
    """The name, lengthened until no column has it."""
    while name.lower() in {c.lower() for c in columns}:
        name += "_"
    return name
