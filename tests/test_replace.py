from pyspark.sql import functions as F

from spanveil.operators import replace as R
from spanveil.operators.spans import ENTITY
from spanveil.streaming.restore import ChunkRestorer, Events, restore_chunks


def entities(text, *parts):
    out = []
    for kind, value in parts:
        at = len(text[: text.index(value)].encode())
        while any(e[2] == at for e in out):
            cut = text.encode()[at + 1 :].decode(errors="ignore")
            at = at + 1 + len(text.encode()[at + 1 :]) - len(cut.encode()) + len(cut[: cut.index(value)].encode())
        out.append((kind, value, at, at + len(value.encode()), 0.9))
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, f"request_id string, seq int, text string, entities array<{ENTITY}>")


def test_numbers_repeat_values_and_restore(spark):
    a, b = "张三给张三打电话", "卡号6222021234567890123 与 key sk-1 和 李四"
    rows = frame(spark, [("r", 0, a, entities(a, ("zh_person_name", "张三"), ("zh_person_name", "张三"))), ("r", 1, b, entities(b, ("zh_bank_card", "6222021234567890123"), ("api_key", "sk-1"), ("zh_person_name", "李四")))])
    out, mapping = R.replace(rows)
    got = {r.seq: r.replaced for r in out.collect()}
    assert got == {0: "<<zh_person_name_1>>给<<zh_person_name_1>>打电话", 1: "卡号***************0123 与 key [REDACTED] 和 <<zh_person_name_2>>"}
    back = R.restore(out.select("request_id", "seq", F.col("replaced").alias("text")), mapping)
    assert {r.seq: r.restored for r in back.collect()} == {0: a, 1: "卡号***************0123 与 key [REDACTED] 和 李四"}


def test_restored_values_are_not_restored_again(spark):
    row = spark.createDataFrame([("<<a_1>><<a_10>>",)], "t string").select(R.restore_with(F.col("t"), F.create_map(F.lit("<<a_1>>"), F.lit("<<a_10>>"), F.lit("<<a_10>>"), F.lit("x"))).alias("r")).head()
    assert row.r == "<<a_10>>x"


def test_overlaps_and_out_of_range_are_dropped(spark):
    t = "abcdef"
    out, _ = R.replace(frame(spark, [("r", 0, t, [("email", "abc", 0, 3, 0.9), ("email", "bcd", 1, 4, 0.9), ("email", "zz", 5, 9, 0.9)])]))
    assert out.head().replaced == "<<email_1>>def"


def test_chunks_byte_by_byte_and_in_any_cut():
    pairs = {"<<a_1>>": "one", "<<a_12>>": "two", "<<b>>": "<<a_1>>"}
    text = "x<<a_1>>y<<a_12>><<b>><<a_1"
    for step in range(1, len(text)):
        r = ChunkRestorer(pairs)
        parts = [text[i : i + step] for i in range(0, len(text), step)]
        assert "".join(r.feed(p, i == len(parts) - 1) for i, p in enumerate(parts)) == "xoneytwo<<a_1>><<a_1"


def test_chunk_tables_and_events(spark):
    chunks = spark.createDataFrame([("s", i, c) for i, c in enumerate("hi <<a_1>>!")], "stream_id string, seq int, chunk string")
    pairs = spark.createDataFrame([("s", "<<a_1>>", "Bob")], "stream_id string, shown string, original string")
    assert "".join(r.restored for r in restore_chunks(chunks, pairs).orderBy("seq").collect()) == "hi Bob!"
    events = Events({"<<a_1>>": "Bob"})
    first = events.feed('data: {"choices":[{"index":0,"delta":{"content":"a <<a_"}}]}', False)[0]
    second = events.feed('event: x\ndata: {"choices":[{"index":0,"delta":{"content":"1>>"}}]}', False)[0]
    assert '"a "' in first and '"Bob"' in second and second.startswith("event: x\n")


def test_null_and_repeated_keys_leave_no_value(spark):
    t = "mail a@b.org"
    rows = frame(spark, [(r, q, t, entities(t, ("email", "a@b.org"))) for r, q in ((None, 0), ("r", None), (None, None), ("r", 1), ("r", 1), ("s", 1))] + [("r", 1, "no mail", None), ("r", 1, None, None)])
    for strategy in ("placeholder", "simulate"):
        out, mapping = R.replace(rows, strategy)
        assert sorted(x.replaced or "" for x in out.collect()) == ["", *["mail <<email_1>>"] * 6, "no mail"] and out.columns == [*rows.columns, "replaced"]
        assert sorted((m.request_id or "", m.original) for m in mapping.collect()) == [("", "a@b.org"), ("r", "a@b.org"), ("s", "a@b.org")]
        back = R.restore(out.select("request_id", F.col("replaced").alias("text"), F.col("text").alias("was")), mapping)
        assert all(x.restored == x.was for x in back.collect())
