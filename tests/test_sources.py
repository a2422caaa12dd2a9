from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from spanveil.functions import fixed
from spanveil.operators import reports, simulate, stores
from spanveil.operators.spans import ENTITY
from spanveil.sources import io


def test_labelled_lines(spark, tmp_path):
    p = tmp_path / "cases.jsonl"
    p.write_text('# c\n\n{"name":"a","descriptor":{"command":"ls"},"want":"benign"}\n')
    assert [(r.name, r.descriptor.command, r.want) for r in io.read_command_cases(spark, str(p)).collect()] == [("a", "ls", "benign")]
    p.write_text("# only\n")
    with pytest.raises(ValueError):
        io.read_command_cases(spark, str(p))


def test_dictionary_faults(spark):
    rows = [("email", "ok value"), ("nope", "xx"), ("email", " x"), ("email", "y"), ("email", "Two"), ("plate", "tWO"), ("email", None)]
    got = {(r.type, r.value): r.reason for r in io.check_dictionary(spark.createDataFrame(rows, "type string, value string"), fixed.ENTITY_TYPES).collect()}
    assert got == {("nope", "xx"): "unknown type", ("email", " x"): "blank edges", ("email", "y"): "too short", ("email", "Two"): "several types", ("plate", "tWO"): "several types", ("email", None): "blank"}
    fakes = [("email", "a", "b"), ("email", "c", "b"), ("token", "a", "z"), ("email", " ", "q"), ("email", "u", "v")]
    assert sorted(r.reason for r in io.check_fakes(spark.createDataFrame(fakes, "type string, real string, fake string"), fixed.SIMULATABLE).collect()) == ["blank", "fake is shared", "fake is shared", "type has no fakes"]


def test_audit_appends(spark, tmp_path):
    df = spark.createDataFrame([("r1",), ("r2",)], "request_id string")
    io.write_audit(df, str(tmp_path / "audit"))
    io.write_audit(df, str(tmp_path / "audit"), 1)
    got = spark.read.json(str(tmp_path / "audit"))
    assert got.count() == 4 and got.where("schema_version = '1'").count() == 4


def test_breaker_against_a_plain_machine(spark):
    t0 = datetime(2024, 1, 1)
    oks = [1, 0, 0, 0, 1, 0, 0, 0, 0, 1, 1, 0, 0, 0, 0, 0, 1]
    calls = [("s", t0 + timedelta(seconds=4 * i), i, bool(o)) for i, o in enumerate(oks)]
    got = {r.call_id: (r.state, r.allowed) for r in stores.breaker(spark.createDataFrame(calls, "stream string, at timestamp, call_id long, ok boolean"), 3, 10).collect()}
    bad, opened, want = 0, None, {}
    for _, at, i, ok in calls:
        state = "closed" if opened is None else "open" if (at - opened).total_seconds() < 10 else "half_open"
        want[i] = (state, state != "open")
        if state == "open":
            continue
        bad = 0 if ok else bad + 1
        opened = None if ok else at if state == "half_open" or bad >= 3 else opened
    assert got == want


def test_quality_counts_each_entity_once(spark):
    e = lambda k, a, b: (k, "", a, b, 1.0)
    rows = [([e("email", 0, 5), e("email", 3, 9), e("url", 0, 2)], [e("email", 4, 6), e("date", 0, 1)])]
    df = spark.createDataFrame(rows, f"expect array<{ENTITY}>, found array<{ENTITY}>")
    got = {r.type: (r.tp, r.fp, r.fn) for r in reports.detector_quality(df, "type").collect()}
    assert got == {"email": (1, 0, 1), "url": (0, 0, 1), "date": (0, 1, 0)}
    assert [(r.tp, r.fp, r.fn) for r in reports.detector_quality(df).collect()] == [(1, 1, 2)]


def test_seal_needs_its_mark(spark):
    key = F.lit("0123456789abcdef").cast("binary")
    row = spark.range(1).select(stores.unseal(stores.seal(F.lit("body"), key), key).alias("a"), stores.unseal(F.lit("XXXXbody").cast("binary"), key).alias("b")).head()
    assert (row.a, row.b) == ("body", None)


def test_fakes_repeat_and_keep_their_form(spark):
    row = spark.range(1).select(*[simulate.fake(k, F.lit(v), "k").alias(k) for k, v in (("email", "a_b.c@x.org"), ("date", "2024/1/05"), ("ip_address", "172.16.0.1"), ("zh_person_name", "张三"), ("zh_address", "x"))], simulate.fake("api_key", F.lit("x"), "k").alias("none")).head()
    import re

    assert re.fullmatch(r"[a-z]+_[a-z]+\.[a-z]+\d{3}@x\.org", row.email) and re.fullmatch(r"\d{4}/\d{1,2}/\d{2}", row.date) and re.match(r"172\.(1[6-9]|2\d|3[01])\.", row.ip_address) and len(row.zh_person_name) == 2 and row.none is None
