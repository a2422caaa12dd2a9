"""Where intermediate tables go, and small helpers that all operators share."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where it is unset (tests), a folder of this machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spanveil-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/spanveil-{spark.sparkContext.applicationId}"


_scratch: ContextVar[list[str] | None] = ContextVar("scratch", default=None)


def write(df: DataFrame) -> tuple[DataFrame, str]:
    """df written to the shared folder and read again, and where it lies."""
    path = f"{shared_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def materialize(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it again: it cuts the lineage and survives lost executors.

    The table stays for as long as the folder does, or to the end of scratch().
    """
    out, path = write(df)
    if (own := _scratch.get()) is not None:
        own.append(path)
    return out


def bucketed(df: DataFrame, key: str, n: int) -> DataFrame:
    """df written to the shared folder in n buckets of a key and read again: what groups by the key reads it without a shuffle."""
    spark = df.sparkSession
    name = f"spanveil_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    df.write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(n, key).saveAsTable(name)
    if (own := _scratch.get()) is not None:
        own.append(path)
    out = spark.table(name)
    out.schema  # noqa: B018  resolved before the catalog forgets it; the files stay
    spark.sql(f"DROP TABLE {name}")
    return out


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are materialized inside are deleted at the end; what was made from them must have been written by then."""
    token = _scratch.set([])
    try:
        yield
    finally:
        own = _scratch.get()
        _scratch.reset(token)
        for path in own:
            delete(spark, path)


def delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def parts(spark: SparkSession, df: DataFrame | None = None, each: int = 32 << 20) -> int:
    """Shuffle partitions: what the session asks for, or more where df would give each more than `each` bytes.

    The size is the planner's estimate, which for files is that of the files; one without bound is left out.
    """
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) if df is not None else 0
    return max(n, -(-size // each)) if size < 1 << 50 else n


@functools.cache
def _libc():
    try:
        return ctypes.CDLL("libc.so.6")
    except OSError:
        return None


def trim() -> None:
    """Give freed memory back to the system: a Python worker serves all later stages, and what it keeps adds up."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    if _libc() is not None:
        _libc().malloc_trim(0)


def trimmed(run):
    """A function of batches that gives memory back when its task ends."""

    @functools.wraps(run)
    def whole(batches):
        try:
            yield from run(batches)
        finally:
            trim()

    return whole


def in_fold(mod: int, value: int, name: str = "doc_id"):
    """crc32 of the id as text, by remainder; a null id falls outside the fold."""
    return F.coalesce(F.pmod(F.crc32(F.col(name).cast("string").cast("binary")), F.lit(mod)) == value, F.lit(False))
