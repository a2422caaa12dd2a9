"""Growing conversations: roots over segment hashes, and the part that a new snapshot adds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def segment_hash(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def roots(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, text) -> SHA-256 over the concatenated hashes of the segments, in order."""
    listed = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", segment_hash(F.col("text")).alias("h")))).alias("s"))
    return listed.select("conv_id", F.size("s").cast("long").alias("segments"), F.sha2(F.unhex(F.array_join(F.transform("s", lambda x: x["h"]), "")), 256).alias("root"))


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the longest prefix that two arrays of hashes share."""
    differ = F.filter(F.sequence(F.lit(1), F.greatest(F.least(F.size(a), F.size(b)), F.lit(1))), lambda i: ~F.coalesce(F.try_element_at(a, i) == F.try_element_at(b, i), F.lit(False)))
    return F.when(F.size(differ) > 0, F.element_at(differ, 1) - 1).otherwise(F.least(F.size(a), F.size(b)))


def incremental(snapshots: DataFrame, ttl_seconds: float | None = None) -> DataFrame:
    """(conv_id, version, hashes[, at]) -> reused: segments that the snapshot before has at the same places; scanned: the rest.

    With ttl and at, a snapshot that comes later than ttl after the one before finds nothing to reuse; each use renews.
    """
    order = Window.partitionBy("conv_id").orderBy("version")
    before = F.lag("hashes").over(order)
    out = snapshots.withColumn("before", before)
    if ttl_seconds is not None:
        out = out.withColumn("before", F.when(F.unix_micros(F.col("at").cast("timestamp")) - F.unix_micros(F.lag("at").over(order).cast("timestamp")) <= int(ttl_seconds * 1e6), F.col("before")))
    reused = F.coalesce(common_prefix(F.col("before"), F.col("hashes")), F.lit(0))
    return out.withColumn("reused", reused.cast("long")).withColumn("scanned", (F.size("hashes") - reused).cast("long")).drop("before")
