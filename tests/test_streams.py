"""Restoring in streams: any cut gives what whole texts give, nothing held is lost, and each stream has its own mapping."""

import json
import random
import time

import pytest
from pyspark.sql import functions as F

from spanveil.operators.replace import restore_with
from spanveil.streaming import restore as S

PAIRS = {"<<email_1>>": "a@b.org", "<<email_12>>": "<<email_1>>", "<<email": "half", "王五": "李", "x": "é"}


def plain(text, pairs):
    out, at = [], 0
    while at < len(text):
        key = max((k for k in pairs if text.startswith(k, at)), key=len, default=None)
        out.append(pairs[key] if key else text[at])
        at += len(key) if key else 1
    return "".join(out)


def test_any_cut_gives_what_the_whole_text_gives(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice([*PAIRS, "<", "<<", "<<email_", "1", ">>", "王", " ", "<<url_3>>"]) for _ in range(rng.randint(0, 12))) for _ in range(300)]
    for text in texts:
        for size in (1, 2, 3, 7, 100):
            r = S.ChunkRestorer(PAIRS)
            parts = [text[i : i + size] for i in range(0, len(text), size)] or [""]
            assert "".join(r.feed(p, k == len(parts) - 1) for k, p in enumerate(parts)) == plain(text, PAIRS)
            assert not r.held
    pairs = F.create_map(*[F.lit(x) for kv in PAIRS.items() for x in kv])
    got = spark.createDataFrame([(t,) for t in texts[:50]], "t string").select("t", restore_with(F.col("t"), pairs).alias("r")).collect()
    assert all(r.r == plain(r.t, PAIRS) for r in got)


def test_orphans_are_counted_in_any_cut():
    text = "a <<url_1>> <<email_1>> <<url_22>> <<email_"
    for size in range(1, len(text) + 1):
        r = S.ChunkRestorer({"<<email_1>>": "e"})
        parts = [text[i : i + size] for i in range(0, len(text), size)]
        assert "".join(r.feed(p, k == len(parts) - 1) for k, p in enumerate(parts)) == "a <<url_1>> e <<url_22>> <<email_"
        assert r.orphans == 3  # two signs without a value, one beginning of a key


def test_time_doesnt_follow_the_number_of_keys():
    text = "<<email_7>> and " * 3000
    took = []
    for n in (10, 50_000):
        keys = S.Matcher({f"<<email_{k}>>": str(k) for k in range(n)})
        began = time.perf_counter()
        S.ChunkRestorer(keys).feed(text, True)
        took.append(time.perf_counter() - began)
    assert took[1] < 10 * took[0] + 0.05


def event(text, **more):
    return "data: " + json.dumps({"choices": [{"index": 0, "delta": {"content": text}}], **more}, ensure_ascii=False, separators=(",", ":"))


def test_events_lose_nothing_and_keep_what_doesnt_change():
    pairs = {"<<a_1>>": "Bob"}
    e = S.Events(pairs)
    odd = 'data:{"x": 1.7e9,  "y":0.1000000000000000055511, "text":"\\u00e9 plain"}'
    assert e.feed(odd, False) == (odd, 0)
    assert e.feed('data: {"n":1.7e9,"text":"to <<a_1>>"}', False) == ('data: {"n":1.7e9,"text":"to Bob"}', 0)
    assert e.feed(event("if a <"), False) == (event("if a "), 0)
    assert e.feed("data: [DONE]", True) == (f"{event('<')}\n\ndata: [DONE]", 1)
    one = S.Events(pairs)
    first = one.feed('event: d\ndata: {"delta":"x <<a_","text":"t"}', False)
    assert first == ('event: d\ndata: {"delta":"x ","text":"t"}', 0)
    two = S.Events(pairs, one.state())
    assert two.feed('data: {"text":"end"}', True) == ('data: {"text":"end"}\n\nevent: d\ndata: {"delta":"<<a_","text":""}', 1)
    assert S.Events(pairs).feed("event: ping\n: note\ndata: [DONE]", True) == ("event: ping\n: note\ndata: [DONE]", 0)
    assert S.Events(pairs).feed("data: {broken <<a_1>>", True) == ("data: {broken <<a_1>>", 0)


def test_places_have_buffers_of_their_own():
    e = S.Events({"<<a_1>>": "Bob"})
    both = lambda i, t: 'data: {"choices":[{"index":%d,"delta":{"content":"%s"}}]}' % (i, t)
    assert [e.feed(both(0, "<<a_"), False)[0], e.feed(both(1, "<<"), False)[0], e.feed(both(0, "1>>"), False)[0], e.feed(both(1, "a_1>>"), False)[0]] == [both(0, ""), both(1, ""), both(0, "Bob"), both(1, "Bob")]


@pytest.mark.parametrize("end", [b"\n\n", b"\r\n\r\n"])
def test_bytes_cut_anywhere(end):
    pairs = {"<<a_1>>": "Böb", "<<a_12>>": "😀"}
    frames = [event("é <<a_"), "event: x\n" + event("1>> 😀 <<a_12>>", id=1.50), ": note", event("<<a"), "data: [DONE]"]
    whole = b"".join(f.encode() + end for f in frames) + b"tail \xff <<a_1>>"
    want = S.Bytes(pairs).feed(whole, True)
    assert "Böb".encode() in want[0] and want[0].endswith(b"tail \xff <<a_1>>") and want[1] == 1
    for size in range(1, len(whole)):
        b, out, orphans = S.Bytes(pairs), [], 0
        for i in range(0, len(whole), size):
            done, n = b.feed(whole[i : i + size], i + size >= len(whole))
            out.append(done)
            orphans += n
            b = S.Bytes(pairs, b.events.state(), bytes(b.pending))  # as kept between batches
        assert (b"".join(out), orphans) == want


def test_batch_forms_with_null_and_odd_streams(spark):
    pairs = spark.createDataFrame([("s", "<<a_1>>", "Bob"), (None, "<<a_1>>", "Eve"), ("unused", "<<a_1>>", "x")], "stream_id string, shown string, original string")
    chunks = spark.createDataFrame([(s, k, c) for s in ("s", None, "bare") for k, c in enumerate(["hi <<a", "_1>>", None, "<<a"])], "stream_id string, seq int, chunk string")
    got = {r.stream_id: (r.restored, r.orphans) for r in S.joined(S.restore_chunks(chunks, pairs)).collect()}
    assert got == {"s": ("hi Bob<<a", 1), None: ("hi Eve<<a", 1), "bare": ("hi <<a_1>><<a", 1)}
    raw = chunks.select("stream_id", "seq", F.encode(F.concat(F.lit('data: {"text":"'), F.coalesce("chunk", F.lit("")), F.lit('"}\n\n')), "UTF-8").alias("bytes"))
    out = S.restore_bytes(raw, pairs).where("stream_id = 's'").orderBy("seq").collect()
    assert b"".join(bytes(r.restored) for r in out) == b'data: {"text":"hi "}\n\ndata: {"text":"Bob"}\n\ndata: {"text":""}\n\ndata: {"text":""}\n\ndata: {"text":"<<a"}\n\n'
    assert S.restore_chunks(chunks.limit(0), pairs.limit(0)).count() == 0


def run(stream, name, folder, until, spark):
    query = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(folder)).trigger(processingTime="0 seconds").start()
    try:
        for _ in range(240):
            rows = spark.table(name).collect()
            if until(rows) or query.exception():
                break
            time.sleep(0.5)
    finally:
        query.stop()
    return rows


def test_streams_are_restored_under_their_own_mappings(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = [{"stream_id": s, "seq": k, "chunk": c, "last": k == 8} for s in ("s", "t") for k, c in enumerate("a<<x_1>>b")]
    rows += [{"stream_id": "later", "shown": "<<x_1>>", "original": "Dan"}, {"stream_id": "later", "seq": 0, "chunk": "<<x_1>> <", "last": False}]
    (tmp_path / "in" / "0.json").write_text("\n".join(map(json.dumps, rows)))
    given = spark.readStream.schema("stream_id string, seq long, chunk string, last boolean, shown string, original string").json(str(tmp_path / "in"))
    known = spark.createDataFrame([("s", "<<x_1>>", "Bob"), ("t", "<<x_1>>", "Eve")], "stream_id string, shown string, original string")
    out = run(S.restoring(given, known, timeout_ms=3000), "restored_chunks", tmp_path / "c", lambda got: any(r.seq == -1 for r in got), spark)
    text = lambda s: "".join(r.restored for r in sorted(out, key=lambda r: (r.seq < 0, r.seq)) if r.stream_id == s)
    assert (text("s"), text("t"), text("later")) == ("aBobb", "aEveb", "Dan <")
    assert [r.restored for r in out if r.seq == -1] == ["<"]  # what the timeout lets go


def test_stream_of_events_lets_go_what_it_holds(spark, tmp_path):
    (tmp_path / "in").mkdir()
    frames = [event("x <<a_"), event("1>>! <<"), "data: [DONE]"]
    (tmp_path / "in" / "0.json").write_text("\n".join(json.dumps({"stream_id": s, "seq": k, "frame": x, "last": s == "s" and k == 2}) for s in ("s", "cut") for k, x in enumerate(frames[: 3 if s == "s" else 2])))
    given = spark.readStream.schema("stream_id string, seq long, frame string, last boolean").json(str(tmp_path / "in"))
    known = spark.createDataFrame([("s", "<<a_1>>", "Bob"), ("cut", "<<a_1>>", "Eve")], "stream_id string, shown string, original string")
    out = run(S.restoring(given, known, "frame", 3000), "restored_events", tmp_path / "c", lambda got: any(r.seq == -1 for r in got), spark)
    got = {(r.stream_id, r.seq): (r.restored, r.orphans) for r in out}
    assert got == {("s", 0): (event("x "), 0), ("s", 1): (event("Bob! "), 0), ("s", 2): (f"{event('<<')}\n\ndata: [DONE]", 1), ("cut", 0): (event("x "), 0), ("cut", 1): (event("Eve! "), 0), ("cut", -1): (event("<<"), 1)}


def test_breaker_over_batches(spark, tmp_path):
    from datetime import datetime, timedelta

    from spanveil.operators import stores
    from spanveil.streaming import breaker

    (tmp_path / "in").mkdir()
    rng = random.Random(5)
    start = datetime(2024, 1, 1)
    calls = [{"stream": "ab"[k % 2], "at": (start + timedelta(seconds=k)).isoformat(), "call_id": k, "ok": rng.random() < 0.5} for k in range(60)]
    for n in range(3):
        (tmp_path / "in" / f"{n}.json").write_text("\n".join(map(json.dumps, calls[20 * n : 20 * n + 20])))
        time.sleep(0.05)  # files are read in order of their times
    schema = "stream string, at timestamp, call_id long, ok boolean"
    given = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    out = run(breaker.breaking(given, 2, 7), "breaker_out", tmp_path / "c", lambda got: len({r.call_id for r in got if r.call_id >= 0}) == 60, spark)
    want = {r.call_id: (r.state, r.allowed) for r in stores.breaker(spark.read.schema(schema).json(str(tmp_path / "in")), 2, 7).collect()}
    assert {r.call_id: (r.state, r.allowed) for r in out if r.call_id >= 0} == want and {s for s, _ in want.values()} == {"closed", "open", "half_open"}
