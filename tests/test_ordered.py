"""Look-ups along an order, walks over jumps, and what stands on them, against plain versions."""

import bisect
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from spanveil.operators import ordered, stores

START = datetime(2024, 1, 1)


def test_first_after_is_a_plain_search(spark):
    rng = random.Random(1)
    targets = {k: sorted(rng.sample(range(-n * 3, n * 30), n)) for k, n in (("a", 1), ("b", 2), ("c", 200), ("d", 37))}
    targets["far"] = [-(10**15), 5, 10**15]
    asked = [(k, q) for k, v in targets.items() for q in [*v, *(x + rng.choice([-1, 1, 7]) for x in v), v[0] - 100, v[-1] + 100]] + [("none", 3)]
    got = ordered.first_after(spark.createDataFrame(asked, "key string, q long"), spark.createDataFrame([(k, v) for k, vs in targets.items() for v in vs], "key string, v long"))
    want = []
    for k, q in asked:
        at = bisect.bisect_right(targets.get(k, []), q)
        want.append((k, q, targets[k][at] if at < len(targets.get(k, [])) else None))
    assert sorted((r.key, r.q, r.v is None, r.v or 0) for r in got.collect()) == sorted((k, q, v is None, v or 0) for k, q, v in want)


def test_reached_walks_any_length(spark):
    jumps = [("a", i, i + 3) for i in range(100)] + [("b", 0, 5), ("b", 5, None), ("c", 1, 2)]
    got = ordered.reached(spark.createDataFrame([("a", 1), ("b", 0), ("d", 9)], "key string, at long"), spark.createDataFrame(jumps, "key string, at long, to long"))
    assert sorted((r.key, r["at"]) for r in got.collect()) == sorted([("a", i) for i in range(1, 103, 3)] + [("b", 0), ("b", 5), ("d", 9)])


def plain_writers(puts, ttl):
    out, until = [], {}
    for i, t, name in sorted((p for p in puts if p[0] is not None and p[1] is not None), key=lambda p: (p[1], p[2])):
        if i not in until or t > until[i]:
            until[i] = t + timedelta(seconds=ttl)
            out.append((i, t, name))
    return sorted(out)


@pytest.mark.parametrize("few", [4096, 10**9, 0])
def test_first_writers_with_ties_nulls_and_a_hot_id(spark, monkeypatch, few):
    monkeypatch.setattr(stores, "FEW", few)  # hot ids are walked, all are folded, all are walked
    rng = random.Random(2)
    puts = [("hot", START + timedelta(seconds=rng.randrange(200_000)), f"p{k:05}") for k in range(20_000)]
    puts += [("edge", START + timedelta(seconds=s), f"e{s}") for s in (0, 1800, 1801, 3601, 3602)] + [("tie", START, "b"), ("tie", START, "a"), ("tie", START, "a"), (None, START, "x"), ("no time", None, "y")]
    df = spark.createDataFrame(puts, "request_id string, created_at timestamp, name string").repartition(8)
    for tie in ("name", None) if few else ("name",):
        got = stores.first_writers(df, 1800, tie).collect()
        assert sorted((r.request_id, r.created_at, r.name) for r in got) == plain_writers(puts, 1800)
        assert all(r.expires_at == r.created_at + timedelta(seconds=1800) for r in got)
    assert stores.first_writers(df.limit(0)).count() == 0 and df.where(F.col("request_id").isNull()).count() == 1


def plain_breaker(calls, failures, cool):
    out, state = {}, {}
    for stream, at, call_id, ok in sorted(calls, key=lambda c: (c[1], c[2], c[3])):
        bad, opened = state.get(stream, (0, None))
        name = "closed" if opened is None else "open" if (at - opened).total_seconds() < cool else "half_open"
        out[stream, call_id] = (name, name != "open")
        if name != "open":
            bad = 0 if ok else bad + 1
            opened = None if ok else at if name == "half_open" or bad >= failures else opened
        state[stream] = bad, opened
    return out


@pytest.mark.parametrize(("share", "failures", "cool"), [(0.5, 3, 60), (0.05, 5, 600), (1.0, 2, 100), (0.7, 1, 7), (0.0, 3, 10)])
def test_a_long_stream_of_calls_is_a_plain_machine(spark, monkeypatch, share, failures, cool):
    monkeypatch.setattr(stores, "CALLS", 100)
    rng = random.Random(int(share * 10))
    at, calls = START, []
    for k in range(3000):
        at += timedelta(seconds=rng.choice([0, 0, 1, 1, 5, 90 if rng.random() < 0.05 else 2]))
        calls.append(("hot" if k % 3 else None, at, k, rng.random() >= share))
    calls += [("short", START + timedelta(seconds=k), k, False) for k in range(9)] + [("good", START, k, True) for k in range(150)]
    df = spark.createDataFrame(calls, "stream string, at timestamp, call_id long, ok boolean").repartition(6)
    got = {(r.stream, r.call_id): (r.state, r.allowed) for r in stores.breaker(df, failures, cool).collect()}
    assert got == plain_breaker(calls, failures, cool)


def test_places_and_carried_values(spark):
    rng = random.Random(4)
    rows = [(k, rng.randrange(50), n) for k, m in (("a", 300), ("b", 1), ("c", 40)) for n in range(m)]
    placed = ordered.ranked(spark.createDataFrame(rows, "key string, t long, n int"), ["t", "n"])
    assert sorted((r.key, r.i, r.t, r.n) for r in placed.collect()) == sorted((k, i, t, n) for k in "abc" for i, (t, n) in enumerate(sorted((t, n) for kk, t, n in rows if kk == k)))
    given = placed.select("key", "i", F.when(F.col("i") % 7 == 3, F.col("i")).alias("v"))
    assert all(r.v == (None if r.i < 3 else r.i - (r.i - 3) % 7) for r in ordered.carried(given, "v", cell=10).collect())
