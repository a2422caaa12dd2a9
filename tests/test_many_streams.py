"""Many streams in one task: each is restored under its own mapping, rows in their order, whatever else comes with it."""

import random

from spanveil.streaming import restore as S


def _tables(spark):
    chunks = [(k, s, c) for k in (3, 1, None) for s, c in enumerate(["a <<x", "_1>> <", "<x_2>>", "<<x_1"])] + [(2, 0, "<<x_1>>"), (5, 1, None), (5, 0, "<<x_1>>")]
    random.Random(1).shuffle(chunks)
    pairs = [(k, f"<<x_{i}>>", f"v{k}{i}") for k in (1, 3, 9) for i in (1, 2)] + [(None, "<<x_1>>", "none")]
    return spark.createDataFrame(chunks, "stream_id long, seq long, chunk string"), spark.createDataFrame(pairs, "stream_id long, shown string, original string")


def test_whole_streams_are_their_rows_joined(spark):
    chunks, pairs = _tables(spark)
    whole = {r.stream_id: (r.restored, r.orphans) for r in S.restore_chunks(chunks, pairs, whole=True).collect()}
    assert whole == {1: ("a v11 v12<<x_1", 1), 3: ("a v31 v32<<x_1", 1), None: ("a none <<x_2>><<x_1", 2), 2: ("<<x_1>>", 1), 5: ("<<x_1>>", 1)}
    rows = S.restore_chunks(chunks, pairs).collect()
    assert len(rows) == chunks.count()
    assert {r.stream_id: (r.restored, r.orphans) for r in S.joined(spark.createDataFrame(rows, "stream_id long, seq long, restored string, orphans long")).collect()} == whole


def test_streams_are_not_called_one_by_one(spark):
    chunks, pairs = _tables(spark)
    for made in (S.restore_chunks(chunks, pairs), S.restore_events(chunks.withColumnRenamed("chunk", "frame"), pairs, whole=True)):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" in plan and "CoGroups" not in plan


def test_held_text_is_walked_once():
    keys = {"<<x_1>>": "one", "<<x_12>>": "two", "<x": "three"}
    text = "<<x_1>><<x_12>> <<x_ <<x_1 <x<<x_1"
    whole = S.ChunkRestorer(keys)
    want = whole.feed(text, True), whole.orphans
    for n in range(1, 9):
        r = S.ChunkRestorer(keys)
        parts = [text[i : i + n] for i in range(0, len(text), n)]
        got = "".join(r.feed(c, i == len(parts) - 1) for i, c in enumerate(parts))
        assert (got, r.orphans) == want
        assert not r.held
