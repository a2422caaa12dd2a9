"""Caches that outlive a run, and conversations compared by trees of hashes, against plain versions."""

import random

from pyspark.sql import functions as F

from spanveil.operators import caches, tables

RULES = {"rules": ["email"]}


def found(rows):
    return sorted((r.conversation_id or "", r.text or "", r.cached, [e.value for e in r.entities]) for r in rows.collect())


def test_a_later_run_looks_only_at_what_is_new(spark):
    cache = caches.DetectionCache(spark, caches.folder_of(spark), 1800)
    rows = lambda *x: spark.createDataFrame(list(x), "conversation_id string, text string")
    first = rows(("a", "to x@y.org"), ("a", "to x@y.org"), ("b", "to x@y.org"), (None, None), (None, ""))
    assert [x[2] for x in found(cache.detect(first, "2024-01-01 00:00:00", **RULES))] == [False] * 5
    more = rows(("a", "to x@y.org"), ("a", "new z@y.org"), (None, ""), ("", ""))
    assert found(cache.detect(more, "2024-01-01 00:10:00", **RULES)) == [("", "", False, []), ("", "", True, []), ("a", "new z@y.org", False, ["z@y.org"]), ("a", "to x@y.org", True, ["x@y.org"])]
    assert not any(x[2] for x in found(cache.detect(more, "2024-01-01 00:11:00", "2", **RULES)))  # a new version
    at_end = {(c, t): cached for c, t, cached, _ in found(cache.detect(rows(("a", "to x@y.org"), ("a", "new z@y.org")), "2024-01-01 00:30:00", **RULES))}
    assert at_end == {("a", "to x@y.org"): False, ("a", "new z@y.org"): True}  # thirty minutes later
    assert cache.size("2024-01-01 00:30:00") == 7 and cache.detect(more.limit(0), "2024-01-01 00:30:00", **RULES).count() == 0
    cache.compact("2024-01-01 00:31:00")
    again = found(cache.detect(more, "2024-01-01 00:31:00", **RULES))
    assert [x[2] for x in again] == [False, True, True, True] and len(tables.listed(spark, cache.path)) == 1
    cache.invalidate(rows((None, "")))
    assert sorted((x[0], x[2]) for x in found(cache.detect(more, "2024-01-01 00:32:00", **RULES))) == [("", False), ("", True), ("a", True), ("a", True)]
    cache.clear()
    assert cache.size("2024-01-01 00:32:00") == 0


def plain_growing(rows, ttl=None):
    out, by = [], {}
    for c, v, p, t, at in rows:
        by.setdefault(c, {}).setdefault(v, []).append((p, t, at))
    for c, versions in by.items():
        before, last = [], None
        for v in sorted(versions):
            own = sorted(versions[v], key=lambda x: (x[0], x[1] or ""))
            texts, at = [x[1] or "" for x in own], min(x[2] for x in own)
            same = next((i for i, (a, b) in enumerate(zip(before, texts)) if a != b), min(len(before), len(texts)))
            if ttl is not None and last is not None and at - last >= ttl:
                same = 0
            out += [(c or "", v, p, t or "", i < same) for i, (p, t, _) in enumerate(own)]
            before, last = texts, at
    return sorted(out)


def test_growing_conversations(spark):
    rng = random.Random(3)
    rows = []
    for c in ("a", "b", None, ""):
        texts = [f"t{k} {k}@x.org" for k in range(rng.randint(1, 40))]
        for v in range(6):
            rows += [(c, v, p, t, v * 100 + (1000 if v > 3 else 0)) for p, t in enumerate(texts)]
            texts = texts + [f"v{v} more"] if rng.random() < 0.5 else [t if k != rng.randrange(len(texts)) else f"changed in {v}" for k, t in enumerate(texts)][: rng.randint(1, len(texts))]
    rows += [("gaps", 1, 5, None, 0), ("gaps", 1, 9, "x", 0), ("gaps", 2, 5, "", 1), ("gaps", 2, 9, "x", 1)]
    df = spark.createDataFrame(rows, "conv_id string, version int, place int, text string, at long").withColumn("at", F.timestamp_seconds("at"))
    for ttl in (None, 500):
        got = caches.detect_growing(df, ttl, **RULES).collect()
        assert sorted((r.conv_id or "", r.version, r.place, r.text or "", r.reused) for r in got) == plain_growing(rows, ttl)
        assert all([e.value for e in r.entities] == ([r.text.split()[1]] if "@" in (r.text or "") else []) for r in got)
    assert caches.detect_growing(df.limit(0), **RULES).count() == 0


def test_a_long_conversation_in_small_rows(spark):
    n = 10_000
    turns = spark.range(n).select(F.lit("c").alias("conv_id"), F.col("id").alias("place"), F.concat(F.lit("turn "), F.col("id").cast("string")).alias("text"))
    both = turns.withColumn("version", F.lit(1)).unionByName(turns.withColumn("version", F.lit(2)).withColumn("text", F.when(F.col("place") == 7_777, "new").otherwise(F.col("text"))))
    tree = caches.hash_tree(both.select(F.col("version").alias("key"), "place", F.unhex(caches.text_hash(F.col("text"))).alias("hash")), ["key"])
    assert tree.agg(F.max("level")).head()[0] == 13 and tree.agg(F.max(F.octet_length("hash"))).head()[0] == 32 and tree.count() < 4 * n
    common = caches.common_lengths(spark.createDataFrame([(1, 2), (1, 1)], "left int, right int"), tree, tree)
    assert {r.right: r.common for r in common.collect()} == {2: 7_777, 1: 10_000}
