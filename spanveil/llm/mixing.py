"""Mixing sources to target weights by a low-discrepancy schedule (DataFrame functions only).

Slots 0, 1, 2, ... carry the golden-ratio points frac(s * phi); the cumulative weights of the sources cut the unit
interval, so a source gets its share of any run of slots. Slots are ranked within their source; rank r takes block
r mod blocks of that source in pass r div blocks. A block is an equal number of words of the source's documents in a
hashed order. Ranks and block offsets are prefix sums over segments (of slots) and buckets (of hashes), so that no
source, however large, is sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanveil.llm.runtime import materialize

PASSES = 3
WEIGHTS = (1.0, 2.0, 3.0)
# 2^64 over the golden ratio, cut to the high 31 bits, so that products stay exact in 64-bit integers.
STEP, RING = 1327217885, 1 << 31


def word_count(text: Column) -> Column:
    """Runs of bytes other than 0x20 and 0x09 to 0x0D; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, passes: int = PASSES, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size) -> plus weight, target: shares of the whole by weight, none above passes times its size.

    Sources stand in code-point order, null last, and weights repeat over them. The excess over a limit is shared anew
    by weight. That is water filling: in order of limit per weight, the sources that stop at their limit come first,
    and the level of the rest follows from two running sums.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(order) - 1) % len(weights) + 1)
    ranked = sizes.withColumn("weight", weight).withColumn("limit", F.col("source_size") * F.lit(passes).cast("double"))
    by_ratio = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").isNull(), F.col("source").cast("binary"))
    whole = Window.partitionBy()
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(whole) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    levelled = ranked.withColumn("level", level).withColumn("open", F.col("limit") >= F.col("level") * F.col("weight"))
    # The first open source sets the level of all that follow.
    final = F.min(F.when(F.col("open"), F.struct(F.col("limit") / F.col("weight"), "level"))).over(whole)["level"]
    return levelled.withColumn("target", F.coalesce(F.least("limit", F.col("weight") * final), F.col("limit"))).select("source", "source_size", "weight", "target")


BLOCKS = (16, 4096)  # words of a block, least and most
SHARES = 256  # blocks at least that a source's words and target are cut into, where it has as many words


def block_words(total: int) -> int:
    """Words of a block: a power of two between BLOCKS, near a 65536th of the whole."""
    size = BLOCKS[0]
    while size < BLOCKS[1] and size * 65536 < total:
        size *= 2
    return size


def cut(goals: DataFrame, block: int, passes: int = PASSES) -> DataFrame:
    """Adds words (of the source's blocks), blocks, and slots: how many blocks make up the target.

    A source that a block is large for has smaller ones, so that it too comes near its target. All of a source's blocks
    are equal but the last; whole passes take each once.
    """
    words = F.greatest(F.lit(1), F.least(F.lit(block), F.floor(F.least("target", "source_size") / SHARES))).cast("long")
    out = goals.withColumn("words", words).withColumn("blocks", F.ceil(F.col("source_size") / F.col("words")).cast("long"))
    whole = F.floor(F.col("target") / F.col("source_size"))
    rest = F.least("blocks", F.floor((F.col("target") - whole * F.col("source_size")) / F.col("words") + 0.5))
    return out.where("source_size > 0").withColumn("slots", F.least(F.col("blocks") * passes, whole * F.col("blocks") + rest).cast("long"))


def schedule(goals: DataFrame, segment: int = 4096) -> DataFrame:
    """(source, blocks, slots) -> (source, slot, rank, pass, block): which block of which source each slot takes.

    The sequence runs for as many slots as all sources have; each source takes as many as are its own, those it got too
    few of (a handful, by the points' low discrepancy) stand at the end. Sources are few rows against the slots.
    """
    spark = goals.sparkSession
    near = F.sum("slots").over(Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary")))
    whole = F.sum("slots").over(Window.partitionBy())
    ring = lambda x: F.floor(x / F.col("whole") * RING)
    own = goals.where("slots > 0").select("source", "blocks", "slots", near.alias("near"), whole.alias("whole"))
    own = materialize(own.select("source", "blocks", "slots", "whole", ring(F.col("near") - F.col("slots")).alias("lo"), ring(F.col("near")).alias("hi")))
    total = own.agg(F.max("whole")).head()[0] or 0
    # Coarse cells of the ring make the interval join an equality join; a source lies in few cells, a cell in few sources.
    cells = 1024
    width = RING // cells
    spread = own.where("hi > lo").withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor((F.col("hi") - 1) / width)))).select("source", "blocks", "slots", "lo", "hi", "cell")
    point = F.pmod(F.col("slot") % RING * STEP, F.lit(RING))
    line = spark.range(total).select(F.col("id").alias("slot")).withColumn("point", point).withColumn("cell", F.floor(F.col("point") / width))
    placed = line.join(spread, "cell").where("point >= lo and point < hi").withColumn("segment", F.floor(F.col("slot") / segment))
    placed = materialize(placed.select("source", "blocks", "slots", "slot", "segment"))
    counts = placed.groupBy("source", "segment").agg(F.count("*").alias("n"))
    ahead = counts.withColumn("ahead", F.sum("n").over(Window.partitionBy("source").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)))
    ahead = ahead.select(F.col("source").alias("s"), F.col("segment").alias("g"), F.coalesce("ahead", F.lit(0)).alias("ahead"))
    within = F.row_number().over(Window.partitionBy("source", "segment").orderBy("slot")) - 1
    ranked = placed.withColumn("within", within).join(ahead, F.col("source").eqNullSafe(F.col("s")) & (F.col("segment") == F.col("g")))
    ranked = ranked.select("source", "blocks", "slot", (F.col("within") + F.col("ahead")).alias("rank"), "slots").where("rank < slots").drop("slots")
    got = counts.groupBy(F.col("source").alias("s")).agg(F.sum("n").alias("got"))
    late = own.join(got, F.col("source").eqNullSafe(F.col("s")), "left").withColumn("got", F.coalesce("got", F.lit(0))).where("got < slots")
    late = late.select("source", "blocks", F.col("whole").alias("slot"), F.explode(F.sequence("got", F.col("slots") - 1)).alias("rank"))
    every = ranked.unionByName(late)
    return every.select("source", "slot", "rank", F.floor(F.col("rank") / F.col("blocks")).alias("pass"), (F.col("rank") % F.col("blocks")).alias("block"))


def shuffled(seed: int) -> Column:
    """A digest that orders the documents of a source."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("size").cast("string"), F.col("copy").cast("string")).cast("binary"))


def block_pieces(docs: DataFrame, goals: DataFrame, buckets: int, seed: int = 0) -> DataFrame:
    """(doc_id, source, size, copy) -> with block and inside: the blocks that a document's words lie in, and how many of them.

    Buckets follow the digest's order, so prefix sums over buckets and inside them place each document in its source.
    """
    bucket = F.floor(F.conv(F.substring("h", 1, 8), 16, 10).cast("long") * buckets / (1 << 32))
    hashed = docs.where("size > 0").withColumn("h", shuffled(seed)).withColumn("bucket", bucket)
    sums = hashed.groupBy("source", "bucket").agg(F.sum("size").alias("n"))
    ahead = sums.select(F.col("source").alias("s"), F.col("bucket").alias("g"), F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    order = Window.partitionBy("source", "bucket").orderBy("h").rowsBetween(Window.unboundedPreceding, -1)
    placed = hashed.withColumn("within", F.coalesce(F.sum("size").over(order), F.lit(0))).join(ahead, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("g")))
    placed = placed.withColumn("start", F.col("within") + F.col("ahead")).withColumn("stop", F.col("start") + F.col("size")).drop("s", "g")
    own = goals.select(F.col("source").alias("s"), "words")
    placed = placed.join(own, F.col("source").eqNullSafe(F.col("s")))
    words = F.col("words")
    spread = placed.withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / words), F.floor((F.col("stop") - 1) / words))))
    inside = F.least("stop", (F.col("block") + 1) * words) - F.greatest("start", F.col("block") * words)
    return spread.select("doc_id", "source", "size", "copy", "block", inside.alias("inside"))


def _ledger(docs: DataFrame, passes: int, weights: tuple[float, ...], seed: int) -> DataFrame:
    """(doc_id, source, size, copy, source_size, target, taken). Rows that agree in id, source and size are told apart by number alone."""
    sized = docs.groupBy("doc_id", "source", word_count(F.col("text")).alias("size")).agg(F.count("*").alias("copies"))
    sized = materialize(sized.select("doc_id", "source", "size", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")))
    goals = materialize(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), passes, weights))
    facts = sized.agg(F.sum("size"), F.count("*")).head()
    blocks = materialize(cut(goals, block_words(facts[0] or 0), passes))
    times = schedule(blocks).groupBy(F.col("source").alias("s"), F.col("block").alias("b")).agg(F.count("*").alias("times"))
    pieces = block_pieces(sized, blocks, max(1, facts[1] // 2048), seed)
    got = pieces.join(times, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b"))).groupBy("doc_id", "source", "size", "copy").agg(F.sum(F.col("inside") * F.col("times")).alias("taken"))
    got = got.select(*[F.col(k).alias(f"g_{k}") for k in KEYS], "taken")
    goals = goals.select(F.col("source").alias("s"), "source_size", "target")
    out = sized.join(goals, F.col("source").eqNullSafe(F.col("s"))).join(got, _same("g_"), "left")
    return out.select("doc_id", "source", "size", "copy", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


KEYS = ("doc_id", "source", "size", "copy")


def _same(prefix: str) -> Column:
    out = F.lit(True)
    for k in KEYS:
        out = out & F.col(k).eqNullSafe(F.col(f"{prefix}{k}"))
    return out


def mix(docs: DataFrame, passes: int = PASSES, weights: tuple[float, ...] = WEIGHTS, seed: int = 0) -> DataFrame:
    """Rows of docs (doc_id, text, source) with size, source_size, target and taken.

    Null text has size 0 and is never taken; a null source is a source, the last. Repeated rows are documents of their
    own. An empty table gives no rows. Columns other than these three are left out. Each source takes its target to half
    a block, a 256th of its words or target at most. The windows over all sources hold a row a source.
    """
    return _ledger(docs.select("doc_id", "source", "text"), passes, weights, seed).select("doc_id", "source", "size", "source_size", "target", "taken")


def mixed(docs: DataFrame, passes: int = PASSES, weights: tuple[float, ...] = WEIGHTS, seed: int = 0) -> DataFrame:
    """The rows of docs that the mix takes words of, all columns as they are, and taken: how many, repeats counted.

    A column of docs named taken is replaced. Of rows that agree in id, source and size, the first by text are the first.
    """
    docs = docs.drop("taken")
    ledger = _ledger(docs.select("doc_id", "source", "text"), passes, weights, seed).where("taken > 0").select(*[F.col(k).alias(f"__mix_{k}") for k in KEYS], F.col("taken").alias("__mix_taken"))
    rows = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "source", "text", word_count(F.col("text")).alias("size"))
    rows = rows.withColumn("copy", F.row_number().over(Window.partitionBy("doc_id", "source", "size").orderBy("text")))
    return rows.join(ledger, _same("__mix_")).select("row.*", F.col("__mix_taken").alias("taken"))
