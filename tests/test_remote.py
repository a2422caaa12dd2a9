"""Services that answer, stall or say too much; the hub's inbox; audit files by size; greedy matching against the plain fold."""

import json
import random
import tempfile
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from spanveil.operators import backends, reports
from spanveil.sources import io, remote


@pytest.fixture(scope="module")
def service():
    class Answers(BaseHTTPRequestHandler):
        def do_POST(self):
            items = json.loads(self.rfile.read(int(self.headers["Content-Length"])))["items"]
            texts = [x["text"] for x in items]
            if any("stall" in t for t in texts):
                time.sleep(30)
            found = [{"entities": [{"type": "email", "value": "x@y", "start": t.index("x@y"), "end": t.index("x@y") + 3, "score": 0.9}]} if "x@y" in t else None for t in texts]
            body = json.dumps(found).encode() + b" " * (3_000_000 if any("large" in t for t in texts) else 0)
            self.send_response(200)
            self.end_headers()
            try:
                self.wfile.write(body)
            except OSError:
                pass

        def log_message(self, *_):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Answers)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_a_service_that_stalls_is_a_timeout(spark, service):
    rows = lambda *t: spark.createDataFrame([(x,) for x in t], "text string").coalesce(1)
    got = remote.detect_remote(rows("to x@y now", "none", None), service, 5.0, batch_bytes=12).collect()
    assert [[(e.value, e.start) for e in r.entities] for r in got] == [[("x@y", 3)], [], []]
    began = time.monotonic()
    with pytest.raises(Exception, match="(?i)timed? ?out"):
        remote.detect_remote(rows("please stall"), service, 1.0).collect()
    assert time.monotonic() - began < 20
    with pytest.raises(Exception, match="over 1000000 bytes"):
        remote.detect_remote(rows("a large one"), service, 5.0, 1_000_000).collect()


def test_batches_are_bounded():
    texts = ["é" * 3, "b" * 20, "", "c", "d", "e"]
    assert list(backends.in_batches(texts, 3, 10)) == [["ééé"], ["b" * 20], ["", "c", "d"], ["e"]]
    with pytest.raises(TimeoutError):
        backends.within(lambda: time.sleep(5), 0.1)()


def test_a_full_inbox_drops_and_counts(spark, tmp_path):
    said = tempfile.mktemp(suffix=".jsonl")
    events = remote.events_for_hub(spark, spark.range(200).coalesce(1))
    events.write.format("event_hub").mode("append").option("connect", "tests.subscriber:slow").option("said", said).option("inbox", "4").option("patience", "10").save()
    lines = [json.loads(x) for x in open(said)]
    counts = lines[-1]["counts"]
    assert counts["sent"] == len(lines) - 1 and counts["sent"] + counts["dropped"] == 200 and counts["dropped"] > 100
    fast = remote.Inbox(lambda _: None, 1000, 5)
    for k in range(500):
        fast.offer(str(k))
    assert fast.close() == remote.Sent(500, 0)


def test_audit_files_are_cut_by_size(spark, tmp_path):
    rng = random.Random(1)
    rows = [(rng.randrange(10**6) if k % 50 else None, "x" * rng.randrange(300), k) for k in range(2000)]
    events = spark.createDataFrame(rows, "t long, text string, n int").withColumn("timestamp", F.timestamp_seconds("t")).repartition(5)
    got = sorted(io.rotated(events, "timestamp", 4000).collect(), key=lambda r: r.place)
    at, sizes = 0, {}
    for r in got:  # places are what has been written before
        assert r.place == at and r.file == at // 4000
        at += len(r.line.encode()) + 1
        sizes[r.file] = sizes.get(r.file, 0) + len(r.line.encode()) + 1
    longest = max(len(r.line.encode()) + 1 for r in got)
    assert len(got) == 2000 and max(sizes.values()) < 4000 + longest and [r.at is None for r in got] == [True] * 40 + [False] * 1960
    assert [r["at"] for r in got if r["at"] is not None] == sorted(r["at"] for r in got if r["at"] is not None)
    io.write_rotated(events, str(tmp_path / "audit"), limit=4000)
    files = sorted((tmp_path / "audit").glob("file=*/part-*"))
    assert len(files) == 3 and [f.parent.name for f in files] == [f"file={k}" for k in sorted(sizes)[-3:]]
    assert [x for f in files for x in f.read_text().splitlines()] == [r.line for r in got if r.file in sorted(sizes)[-3:]]
    assert io.rotated(events.limit(0), "timestamp", 10).count() == 0


def fold(labels, found):
    used, out = set(), []
    for w in labels:
        hit = next((i for i, e in enumerate(found) if i not in used and e["type"] == w["type"] and e["start"] < w["end"] and w["start"] < e["end"]), -1)
        used.add(hit)
        out.append(hit)
    return out


def test_matching_is_the_plain_fold():
    rng = random.Random(2)

    def some(n, wide, shuffled):
        out = [{"type": rng.choice("ab"), "start": (s := rng.randrange(60)), "end": s + rng.randint(0, wide)} for _ in range(n)]
        return out if shuffled else sorted(out, key=lambda e: e["start"])

    for k in range(600):
        labels, found = some(rng.randint(0, 12), 8, k % 2), some(rng.randint(0, 12), rng.choice([3, 40]), k % 3 == 0)
        assert reports.matched(labels, found) == fold(labels, found)
    many = [{"type": "a", "start": 10 * k, "end": 10 * k + 9} for k in range(20_000)]
    began = time.perf_counter()
    assert reports.matched(many, many[::-1][::-1]) == list(range(20_000)) and time.perf_counter() - began < 5
    assert reports.matched(None, many) is None and reports.matched(many[:2], None) == [-1, -1]


def test_a_run_follows_its_settings(spark):
    from spanveil.functions.config import Settings
    from spanveil.operators import policy

    rows = spark.createDataFrame([("r", 0, "a@b.org and c@d.org, 10.0.0.1, see https://x.org/y"), (None, 1, "Bob"), ("r", 2, None)], "request_id string, seq int, text string")
    settings = Settings(strategy="simulate", overrides={"ip_address": "mask"}, forced=["url"], dictionary={"Bob": "plate"}, fakes={"email": {"a@b.org": "x@y.net"}}, ttl_seconds=60)
    out, mapping = policy.process(rows, settings, F.lit("2024-01-01 00:00:00"))
    assert {r.seq: r.replaced for r in out.collect()} == {0: "x@y.net and <<email_2>>, ****.0.1, see [REDACTED]", 1: "<<plate_1>>", 2: None}
    assert all((r.expires_at - r.created_at).total_seconds() == 60 for r in mapping.collect())

    def service(texts):
        if any("Bob" in t for t in texts):
            raise OSError("down")
        return [[{"type": "zh_person_name", "value": "and", "start": 8, "end": 11, "score": 0.9}] if "and" in t else [] for t in texts]

    calm = Settings(fail_closed=False, allowed=["email"])
    got = {r.seq: [e.value for e in r.entities] for r in policy.process(rows.coalesce(3).repartition(3), calm, F.lit("2024-01-01"), lambda ts: service(ts))[0].collect()}
    assert got[1] == [] and got[0][0] == "a@b.org"
    with pytest.raises(Exception, match="down"):
        policy.process(rows.where("seq = 1"), Settings(), F.lit("2024-01-01"), service)[0].collect()
