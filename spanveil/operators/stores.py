"""Mapping store, detection cache and traffic as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanveil.operators.ordered import carried, first_after, ranked, reached
from spanveil.operators.tables import settled

# Fixed value: the mark before a sealed body, by which the format is known.
MARK = "LMGV"


def first_writers(puts: DataFrame, ttl_seconds: int = 1800, tie: str | None = None) -> DataFrame:
    """(request_id, created_at, ...) -> the puts that take effect: one is refused while an unexpired table of its id exists.

    Each accepted put opens a window of ttl seconds, and the next accepted one is the first after it: every put has one
    successor, and the walk from an id's first put meets those that are accepted. Of puts of an id at one instant the one
    of the least `tie` counts, without that column the one whose row is least as JSON; puts without request_id or
    created_at are refused. An id of many puts is looked up and walked over many tasks; those of few, FEW at most, are
    folded one id at a time, which gives the same.
    """
    stamp = F.unix_micros(F.col("created_at").cast("timestamp"))
    keyed = puts.withColumn("__t", stamp).where("request_id IS NOT NULL AND __t IS NOT NULL")
    times = settled(keyed.select(F.col("request_id").alias("key"), F.col("__t").alias("at")).distinct())
    ttl = ttl_seconds * 1_000_000
    hot = settled(times.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > FEW).select("key"))
    if hot.isEmpty():
        accepted = _folded(times, ttl)
    else:
        walked = settled(times.join(hot, "key", "left_semi"))
        jumps = first_after(walked.withColumn("q", F.col("at") + ttl), walked.withColumnRenamed("at", "v")).select("key", "at", F.col("v").alias("to"))
        accepted = _folded(times.join(hot, "key", "left_anti"), ttl).unionByName(reached(walked.groupBy("key").agg(F.min("at").alias("at")), jumps))
    own = keyed.join(accepted.select(F.col("key").alias("request_id"), F.col("at").alias("__t")), ["request_id", "__t"])
    first = F.min_by(F.struct(*[F.col(f"`{c}`") for c in puts.columns]), F.col(tie) if tie else F.to_json(F.struct(*[F.col(f"`{c}`") for c in puts.columns])))
    return own.groupBy("request_id", "__t").agg(first.alias("__put")).select("__put.*", F.timestamp_micros(F.col("__t") + ttl).alias("expires_at"))


FEW = 4096  # instants of an id that one row may hold


def _folded(times: DataFrame, ttl: int) -> DataFrame:
    """(key, at) that are accepted, of keys with few instants."""
    step = lambda acc, t: F.when((F.size(acc) == 0) | (t > F.try_element_at(acc, F.lit(-1)) + ttl), F.concat(acc, F.array(t))).otherwise(acc)
    taken = F.aggregate(F.array_sort(F.collect_list("at")), F.expr("cast(array() as array<bigint>)"), step)
    return times.groupBy("key").agg(taken.alias("at")).select("key", F.explode("at").alias("at"))


def live(tables: DataFrame, now: Column) -> DataFrame:
    """What a sweep leaves: tables not past their expiry."""
    return tables.where(now <= F.col("expires_at"))


def lookup(tables: DataFrame, request_ids: DataFrame, now: Column) -> DataFrame:
    """The tables alive of the ids asked for; an id without one gives no row."""
    return live(tables, now).join(request_ids.select("request_id").distinct(), "request_id", "left_semi")


def forget(tables: DataFrame, keys: DataFrame, key: str = "request_id") -> DataFrame:
    """Tables, or cached conversations, without those named."""
    return tables.join(keys.select(key).distinct(), key, "left_anti")


def size(tables: DataFrame, now: Column) -> DataFrame:
    """How many are alive."""
    return live(tables, now).agg(F.count("*").alias("size"))


def renewed(uses: DataFrame, ttl_seconds: int = 1800, key: str = "conv_id") -> DataFrame:
    """(key, at) uses of cached entries -> the entries with the expiry that their last use gives."""
    return uses.groupBy(key).agg(F.max("at").alias("used_at")).withColumn("expires_at", F.timestamp_micros(F.unix_micros(F.col("used_at").cast("timestamp")) + ttl_seconds * 1_000_000))


def restorable(tables: DataFrame, now: Column, origin: str = "control") -> DataFrame:
    """Tables that the control interface may restore: its own, and not expired; all others look as if they didn't exist."""
    return live(tables, now).where(F.col("origin") == origin)


def seal(body: Column, key: Column) -> Column:
    """AES-GCM under the caller's key, with the store's mark before it."""
    return F.concat(F.lit(MARK).cast("binary"), F.aes_encrypt(body.cast("binary"), key, F.lit("GCM")))


def unseal(blob: Column, key: Column) -> Column:
    """The body, or null where the mark is missing; a wrong key fails."""
    return F.when(F.substring(blob, 1, len(MARK)) == F.lit(MARK).cast("binary"), F.aes_decrypt(F.substring(blob, len(MARK) + 1, 2_000_000_000), key, F.lit("GCM")).cast("string"))


def cache_stats(requests: DataFrame, conversation: str = "conv_id", text: str = "text") -> DataFrame:
    """Hits, misses and size of a detection cache keyed by conversation and text hash that evicts nothing."""
    key = F.struct(F.col(conversation), F.sha2(F.col(text).cast("binary"), 256))
    keyed = requests.select(key.alias("k")).groupBy("k").agg(F.count("*").alias("n"))
    return keyed.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("hits"), F.count("*").alias("misses"), F.count("*").alias("size"))


def merge_traffic(events: DataFrame, fields: list[str], keep: int = 200) -> DataFrame:
    """(request_id, at, fields...) -> one row an id, of each field the last value that isn't empty; the newest ids by first sight."""
    last = [F.max_by(F.col(f), F.when(F.col(f).isNotNull() & (F.col(f).cast("string") != ""), F.struct("at", F.col(f)))).alias(f) for f in fields]
    merged = events.groupBy("request_id").agg(F.min("at").alias("first_seen"), F.max("at").alias("last_seen"), *last)
    return merged.orderBy(F.desc("first_seen"), F.desc("request_id")).limit(keep)


def recent(events: DataFrame, n: int | None = None, at: str = "at", tie: str = "event_id") -> DataFrame:
    """Newest first; 50 by default, 200 at most."""
    n = 50 if not n or n < 0 else n
    return events.orderBy(F.desc(at), F.desc(tie)).limit(min(n, 200))


CALLS = 1024  # calls of a stream that one row may hold


def breaker(calls: DataFrame, failures: int = 5, cooldown_seconds: float = 10.0) -> DataFrame:
    """(stream, at, call_id, ok) in order of at, then call_id -> with allowed and state before the call.

    After `failures` failures in a row the breaker opens for the cooldown; the next call is a probe, which closes it or
    opens it again. Calls refused don't count. Streams of few calls are folded one by one. Of longer ones, every call has
    one successor: the probe that would follow if it were a probe; the walk over these from the first time that the
    breaker opens meets the calls that are probes, and what lies between two of them follows from the first. Rows
    without a stream are one stream; at and ok are not null.
    """
    cool = int(cooldown_seconds * 1_000_000)
    rows = calls.select("stream", F.to_json(F.struct("stream")).alias("key"), F.unix_micros(F.col("at").cast("timestamp")).alias("t"), "call_id", "ok")
    hot = settled(rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > CALLS).select("key"))
    if hot.isEmpty():
        return _breaker_folded(rows, failures, cool)
    long = settled(rows.join(hot, "key", "left_semi"))
    return _breaker_folded(rows.join(hot, "key", "left_anti"), failures, cool).unionByName(_breaker_walked(long, failures, cool))


def _breaker_folded(rows: DataFrame, failures: int, cool: int) -> DataFrame:
    fold = rows.groupBy("stream").agg(F.array_sort(F.collect_list(F.struct("t", "call_id", "ok"))).alias("calls"))
    empty = F.struct(F.lit(0).alias("bad"), F.lit(None).cast("bigint").alias("opened"), F.expr("cast(array() as array<struct<call_id:bigint,state:string,allowed:boolean>>)").alias("out"))

    def step(acc: Column, c: Column) -> Column:
        state = F.when(acc["opened"].isNull(), "closed").when(c["t"] - acc["opened"] < cool, "open").otherwise("half_open")
        allowed = state != "open"
        bad = F.when(~allowed, acc["bad"]).when(c["ok"], 0).otherwise(acc["bad"] + 1)
        opened = F.when(~allowed, acc["opened"]).when(c["ok"], F.lit(None).cast("bigint")).when((state == "half_open") | (bad >= failures), c["t"]).otherwise(acc["opened"])
        return F.struct(bad.cast("int").alias("bad"), opened.alias("opened"), F.concat(acc["out"], F.array(F.struct(c["call_id"].alias("call_id"), state.alias("state"), allowed.alias("allowed")))).alias("out"))

    return fold.select("stream", F.explode(F.aggregate("calls", empty, step)["out"]).alias("x")).select("stream", "x.*")


def _breaker_walked(rows: DataFrame, failures: int, cool: int) -> DataFrame:
    placed = settled(ranked(rows, ["t", "call_id", "ok"]))
    good = carried(placed.select("key", "i", "t", "ok", F.when(F.col("ok"), F.col("i")).alias("good")), "good")
    # the calls at which a breaker that was closed since `since` opens: so many failures in a row, the first not before it
    trips = settled(good.where(F.col("i") - F.coalesce("good", F.lit(-1)) >= failures).select("key", (F.col("i") - failures + 1).alias("v"), F.col("i").alias("trip")))
    first_at = placed.groupBy("key", "t").agg(F.min("i").alias("probe"))
    times = first_at.select("key", F.col("t").alias("v"))
    after = first_after(placed.where("NOT ok").select("key", "i", (F.col("t") + cool - 1).alias("q")), times).select("key", "i", F.col("v").alias("t"))
    after = settled(after.join(first_at, ["key", "t"], "left").select("key", F.col("i").alias("trip"), "probe"))  # a failure that opens, and the call that probes
    closed = placed.where("ok").select("key", "i", F.col("i").alias("q")).unionByName(placed.where("i = 0").select("key", F.lit(-1).cast("long").alias("i"), F.lit(-1).cast("long").alias("q")))
    opens = first_after(closed, trips.select("key", "v")).select("key", "i", (F.col("v") + failures - 1).alias("trip"))
    opens = settled(opens.join(after, ["key", "trip"], "left").select("key", "i", "trip", "probe"))  # -1: from the start
    jumps = opens.where("i >= 0").select("key", F.col("i").alias("at"), F.col("probe").alias("to")).unionByName(after.select("key", F.col("trip").alias("at"), F.col("probe").alias("to")))
    probes = reached(opens.where("i = -1 AND probe IS NOT NULL").select("key", F.col("probe").alias("at")), jumps)
    marks = probes.select("key", F.col("at").alias("i"), F.lit(True).alias("probed")).join(placed.select("key", "i", "ok"), ["key", "i"])
    marks = marks.join(opens.select("key", "i", "trip"), ["key", "i"], "left").select("key", "i", F.struct(F.col("i").alias("p"), F.col("ok").alias("closes"), "trip").alias("mark"))
    start = opens.where("i = -1").select("key", F.col("trip").alias("first"))
    out = carried(placed.join(marks, ["key", "i"], "left"), "mark").join(start, "key")
    still = lambda trip: F.col(trip).isNull() | (F.col("i") <= F.col(trip))
    state = F.when(F.col("mark").isNull(), F.when(still("first"), "closed").otherwise("open")).when(F.col("mark.p") == F.col("i"), "half_open").when(F.col("mark.closes") & still("mark.trip"), "closed").otherwise("open")
    return out.select("stream", F.col("call_id").cast("long").alias("call_id"), state.alias("state"), (state != "open").alias("allowed"))
