"""Tables that several plans read: written once, so that what made them runs once and lost executors lose nothing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_scoped: ContextVar[list[str] | None] = ContextVar("scoped", default=None)


def shared(spark: SparkSession) -> str:
    """This application's folder in spark.checkpoint.dir; a local master may do without the setting."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spanveil-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/spanveil-{spark.sparkContext.applicationId}"


def settled(df: DataFrame) -> DataFrame:
    """df written as Parquet to the shared folder, and read again; it stays to the end of scope(), else as long as the folder does."""
    path = f"{shared(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if (own := _scoped.get()) is not None:
        own.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Tables that operators write inside, original values among them, are deleted at the end; results must have been written by then."""
    token = _scoped.set([])
    try:
        yield
    finally:
        own = _scoped.get()
        _scoped.reset(token)
        for path in own:
            delete(spark, path)


def _at(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def delete(spark: SparkSession, path: str) -> None:
    files, place = _at(spark, path)
    files.delete(place, True)


def exists(spark: SparkSession, path: str) -> bool:
    files, place = _at(spark, path)
    return files.exists(place)


def listed(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if it isn't there."""
    files, place = _at(spark, path)
    return [x.getPath().getName() for x in files.listStatus(place)] if files.exists(place) else []
