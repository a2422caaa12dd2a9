"""A detection cache that outlives a run, and growing conversations compared by trees of hashes."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanveil.operators.detect import add_entities
from spanveil.operators.spans import ENTITY
from spanveil.operators.tables import delete, exists, listed, settled

HOUR = 3_600_000_000  # microseconds


def text_hash(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def micros(now: Column | str) -> Column:
    return F.unix_micros((F.lit(now) if isinstance(now, str) else now).cast("timestamp"))


class DetectionCache:
    """What texts of conversations hold, kept in a folder that all executors share, by version, conversation and text.

    An entry is good for ttl seconds from when it was put; looking it up doesn't renew it. Entries lie by version and by the
    hour in which they expire, so a run reads neither those of other versions nor those long expired. A new version of the
    rules or dictionaries is a cache of its own: nothing of the old one is found again. Runs append a batch each; one writer
    at a time.
    """

    SCHEMA = f"conversation string, hash string, entities array<{ENTITY}>, expires_at long, version string, hour long"

    def __init__(self, spark: SparkSession, path: str, ttl_seconds: int = 1800):
        self.spark, self.path, self.ttl = spark, path.rstrip("/"), ttl_seconds * 1_000_000

    def _generation(self) -> int:
        done = [int(n.removeprefix("generation=")) for n in listed(self.spark, self.path) if n.startswith("generation=") and exists(self.spark, f"{self.path}/{n}/_SUCCESS")]
        return max(done, default=0)

    def _folder(self) -> str:
        return f"{self.path}/generation={self._generation()}"

    def entries(self, version: str | None = None, now: Column | str | None = None) -> DataFrame:
        """What is kept, of one version, and good at that time; of several puts of a text the one that lasts longest."""
        folder = self._folder()
        if not exists(self.spark, folder):
            return self.spark.createDataFrame([], self.SCHEMA)
        kept = self.spark.read.schema(self.SCHEMA).parquet(folder)
        if version is not None:
            kept = kept.where(F.col("version") == str(version))
        if now is not None:
            kept = kept.where((F.col("hour") >= F.floor(micros(now) / HOUR)) & (F.col("expires_at") > micros(now)))
        return kept

    def _append(self, rows: DataFrame, folder: str) -> None:
        rows.select("conversation", "hash", "entities", "expires_at", "version", "hour").write.mode("append").partitionBy("version", "hour").option("compression", "zstd").parquet(folder)

    def detect(self, requests: DataFrame, now: Column | str, version: str = "0", conversation: str = "conversation_id", text: str = "text", **options) -> DataFrame:
        """requests with entities and cached: only texts that their conversation has no good entry of are looked at, once each.

        A null conversation is one of its own; a null text counts as empty. Repeated rows repeat: all rows of a text that
        had to be looked at say that it wasn't cached.
        """
        row = "__row"
        keyed = settled(requests.withColumn(row, F.monotonically_increasing_id()).withColumn("__hash", text_hash(F.col(text))))
        asked = keyed.select(F.col(conversation).cast("string").alias("conversation"), F.col("__hash").alias("hash"), row)
        keys = asked.groupBy("conversation", "hash").agg(F.min(row).alias(row))
        good = self.entries(version, now).groupBy("conversation", "hash").agg(F.max_by("entities", "expires_at").alias("entities"))
        same = lambda a, b: (F.col(f"{a}.hash") == F.col(f"{b}.hash")) & F.col(f"{a}.conversation").eqNullSafe(F.col(f"{b}.conversation"))
        k, g = keys.alias("k"), good.alias("g")
        missing = k.join(g, same("k", "g"), "left_anti")
        texts = missing.join(keyed.select(row, text), row)
        fresh = settled(add_entities(texts.select("conversation", "hash", F.col(text).alias("__text")), "__text", **options).select("conversation", "hash", "entities"))
        known = settled(k.join(g, same("k", "g")).select("k.conversation", "k.hash", "g.entities"))
        until = micros(now) + F.lit(self.ttl)
        self._append(fresh.withColumn("expires_at", until).withColumn("version", F.lit(str(version))).withColumn("hour", F.floor(until / HOUR)), self._folder())
        every = known.withColumn("cached", F.lit(True)).unionByName(fresh.withColumn("cached", F.lit(False))).alias("e")
        found = asked.alias("a").join(every, same("a", "e")).select(row, "e.entities", "e.cached")
        return keyed.join(found, row).drop(row, "__hash")

    def _rewrite(self, kept: DataFrame) -> None:
        old, before = self._generation(), self._folder()
        after = f"{self.path}/generation={old + 1}"
        kept.withColumn("hour", F.floor(F.col("expires_at") / HOUR)).write.mode("overwrite").partitionBy("version", "hour").option("compression", "zstd").parquet(after)
        delete(self.spark, before)

    def compact(self, now: Column | str) -> None:
        """Expired entries and repeated puts go, and the batches of many runs become few files."""
        kept = self.entries(now=now).groupBy("version", "conversation", "hash").agg(F.max_by("entities", "expires_at").alias("entities"), F.max("expires_at").alias("expires_at"))
        self._rewrite(kept.repartition("version", F.floor(F.col("expires_at") / HOUR), F.pmod(F.xxhash64("hash"), F.lit(16))))

    def invalidate(self, conversations: DataFrame, conversation: str = "conversation_id") -> None:
        """The entries of conversations go, whatever their version."""
        gone = conversations.select(F.col(conversation).cast("string").alias("__gone")).distinct()
        self._rewrite(self.entries().join(gone, F.col("conversation").eqNullSafe(F.col("__gone")), "left_anti"))

    def clear(self) -> None:
        delete(self.spark, self.path)

    def size(self, now: Column | str) -> int:
        return self.entries(now=now).select("version", "conversation", "hash").distinct().count()


# Trees of hashes


def hash_tree(segments: DataFrame, key: list[str]) -> DataFrame:
    """(key.., place long from 0 on without gaps, hash binary) -> (key.., level, place, hash): nodes over 2^level segments.

    A node is there only if all its segments are: of a growing list, nodes stay as they are. A row holds one hash,
    however many segments a key has; a level costs a pass over the level below.
    """
    level = settled(segments.select(*key, F.lit(0).alias("level"), "place", "hash"))
    levels = [level]
    while True:
        pairs = levels[-1].groupBy(*key, F.shiftright("place", 1).alias("place")).agg(F.count("*").alias("n"), F.min_by("hash", "place").alias("a"), F.max_by("hash", "place").alias("b"))
        above = settled(pairs.where("n = 2").select(*key, F.lit(len(levels)).alias("level"), "place", F.unhex(F.sha2(F.concat("a", "b"), 256)).alias("hash")))
        if above.isEmpty():
            return reduce(DataFrame.unionByName, levels)
        levels.append(above)


def common_lengths(pairs: DataFrame, left: DataFrame, right: DataFrame, key: str = "left", other: str = "right") -> DataFrame:
    """pairs (left, right) with common: how many first segments two lists share, by descending their trees (key, level, place, hash).

    From the highest level down, a pair looks at one node a level: where it is the same on both sides, the common part is
    that much longer. What is joined at a level is the pairs and that level's nodes.
    """
    top = min((x.agg(F.max("level")).head()[0] if not x.isEmpty() else -1) for x in (left, right))
    at = settled(pairs.select(key, other).withColumn("common", F.lit(0).cast("long")))
    for level in range(top, -1, -1):
        side = lambda nodes, name, into: nodes.where(F.col("level") == level).select(F.col("key").alias(name), "place", F.col("hash").alias(into))  # noqa: B023, E731
        asked = at.withColumn("place", F.shiftright("common", level))
        found = asked.join(side(left, key, "a"), [key, "place"], "left").join(side(right, other, "b"), [other, "place"], "left")
        at = found.select(key, other, (F.col("common") + F.when(F.col("a") == F.col("b"), F.lit(1 << level)).otherwise(0)).alias("common"))
        if level % 8 == 0:
            at = settled(at)
    return at


def detect_growing(segments: DataFrame, ttl_seconds: float | None = None, **options) -> DataFrame:
    """(conv_id, version, place, text[, at]) -> with entities and reused: what the version before has up to there is taken over, the rest is looked at.

    The version before is that of the next smaller number. Segments are ordered by place; of equal places by text. Two
    versions are compared by trees of hashes, so that no row holds more than one hash. With ttl and at, a version that
    comes ttl or more after the one before finds nothing to take over; each use renews. Rows without conv_id are one
    conversation; a null version is the first.
    """
    row, name = "__row", "__key"
    key = F.to_json(F.struct(F.col("conv_id").cast("string").alias("c"), F.col("version").cast("long").alias("v")))
    order = Window.partitionBy(name).orderBy("place", "text", row)
    rows = segments.withColumn(row, F.monotonically_increasing_id()).withColumn(name, key)
    rows = settled(rows.withColumn("__place", (F.row_number().over(order) - 1).cast("long")).withColumn("__hash", text_hash(F.col("text"))))
    tree = settled(hash_tree(rows.select(F.col(name).alias("key"), F.col("__place").alias("place"), F.unhex("__hash").alias("hash")), ["key"]))
    stamp = F.min(F.unix_micros(F.col("at").cast("timestamp"))) if ttl_seconds is not None else F.lit(0)
    versions = rows.groupBy("conv_id", "version", name).agg(stamp.alias("__at"))
    in_turn = Window.partitionBy("conv_id").orderBy(F.col("version").asc_nulls_first())
    versions = versions.withColumn("right", F.lag(name).over(in_turn)).withColumn("__turn", F.row_number().over(in_turn))
    if ttl_seconds is not None:
        versions = versions.withColumn("right", F.when(F.col("__at") - F.lag("__at").over(in_turn) < int(ttl_seconds * 1e6), F.col("right")))
    versions = settled(versions.select(F.col(name).alias("left"), "right", "__turn"))
    common = common_lengths(versions.where("right IS NOT NULL"), tree, tree)
    marked = rows.join(versions.select(F.col("left").alias(name), "__turn"), name).join(common.select(F.col("left").alias(name), "common"), name, "left")
    marked = settled(marked.withColumn("reused", F.col("__place") < F.coalesce("common", F.lit(0))))
    looked = add_entities(marked.where("NOT reused").select(row, "text"), "text", **options).select(row, "entities")
    own = marked.join(settled(looked), row, "left")
    # a segment that is taken over was looked at in the last version that had to
    before = Window.partitionBy("conv_id", "__place").orderBy("__turn").rowsBetween(Window.unboundedPreceding, 0)
    out = own.withColumn("entities", F.coalesce("entities", F.last("entities", ignorenulls=True).over(before)))
    return out.select(*segments.columns, "entities", "reused")


def folder_of(spark: SparkSession) -> str:
    """A folder for a cache of this run's own, beside the tables that operators write."""
    from spanveil.operators.tables import shared

    return f"{shared(spark)}/{uuid.uuid4().hex}"
