"""Folds over long arrays, whole bodies, dictionaries, events and engines, against plain versions."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from spanveil.functions import config, jsontext
from spanveil.functions import validators as V
from spanveil.operators import backends, bodies, reports, shapes, simulate, spans, stores
from spanveil.operators import replace as R
from spanveil.operators.detect import add_entities, detect, dictionary_table
from spanveil.operators.spans import ENTITY
from spanveil.operators.tables import settled
from spanveil.sources import io


def test_matches_of_texts_with_many(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice(["12", "é", " ", "a1b", "7"]) for _ in range(n)) for n in (0, 1, 63, 64, 65, 700)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    got = {r.id: [(m.value, m.start, m.end, m.before, m.after) for m in r.m] for r in rows.select("id", spans.matches(F.col("t"), "[0-9]{2}").alias("m")).collect()}
    for i, t in enumerate(texts):
        want = [(m[0], len(t[: m.start()].encode()), len(t[: m.end()].encode()), t[: m.start()][-1:], t[m.end() :][:1]) for m in re.finditer("[0-9]{2}", t)]
        assert got[i] == want


def test_overlap_rules_on_long_arrays(spark):
    rng = random.Random(2)
    cases = [[("email", str(k), (s := rng.randrange(600)), s + rng.randint(1, 9), rng.choice([0.4, 0.6, 0.7, 0.9])) for k in range(n)] for n in (0, 1, 2, 64, 200)]
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], f"id int, e array<{ENTITY}>")
    got = {r.id: (r.a, r.b) for r in rows.select("id", spans.resolve(F.col("e")).alias("a"), spans.first_wins(F.col("e")).alias("b")).collect()}
    for i, case in enumerate(cases):
        best, first = [], []
        for e in sorted((e for e in case if e[4] >= 0.5), key=lambda e: (e[2], e[3])):
            if best and e[2] < best[-1][3]:
                best[-1] = e if e[4] > best[-1][4] else best[-1]
            else:
                best.append(e)
        for e in sorted(case, key=lambda e: (e[2], -e[3])):
            if not first or e[2] >= first[-1][3]:
                first.append(e)
        assert [tuple(e) for e in got[i][0]] == best and [tuple(e) for e in got[i][1]] == first


def test_second_look_adds_to_what_the_rules_find(spark):
    docs = [f"{a}138-0013-{k:04}{b} and 4111 1111 1111 1111, mail u{k}@x.org" for k, (a, b) in enumerate([("", ""), ("é ", "。"), ("+86 ", ""), ("9", "")])]
    rows = spark.createDataFrame(list(enumerate(docs)), "id int, text string")
    plain = {r.id: [(e.start, e.end) for e in r.e] for r in rows.select("id", detect(F.col("text")).alias("e")).collect()}
    both = {r.id: [(e.type, e.start, e.end) for e in r.entities] for r in add_entities(rows).collect()}
    for i, t in enumerate(docs):
        assert sorted((s, e) for _, s, e in both[i]) == sorted(plain[i] + [(s, e) for _, _, s, e, _ in shapes.look_again(t, list(plain[i]))])


def test_dictionary_as_a_table_in_any_blocks(spark):
    entries = spark.createDataFrame([("Bob", "zh_person_name"), ("bob smith", "zh_address"), ("smith", "plate"), ("É", "url"), ("", "url")], "value string, type string")
    rows = spark.createDataFrame([(0, "é BOB smith, smith bob É"), (1, None), (2, "")], "id int, text string")
    for block in (100, 1):
        got = {r.id: [(e.type, e.value, e.start, e.end) for e in r.entities] for r in dictionary_table(rows, entries, block=block).collect()}
        assert got == {0: [("zh_address", "BOB smith", 3, 12), ("plate", "smith", 14, 19), ("zh_person_name", "bob", 20, 23), ("url", "É", 24, 26)], 1: [], 2: []}
    assert [len(r.entities) for r in dictionary_table(rows, entries.limit(0)).collect()] == [0, 0, 0]


def test_texts_are_looked_at_once_however_long_the_dictionary_is(spark, monkeypatch):
    values = [f"{a}{'x' * (k % 4)}{k}" for k, a in enumerate("abcé" * 15)]
    entries = spark.createDataFrame([(v, "plate") for v in values], "value string, type string")
    rows = spark.createDataFrame([(k, f"É {v.upper()}, {v}") for k, v in enumerate(values)], "id int, text string")
    written = []
    monkeypatch.setattr("spanveil.operators.detect.settled", lambda df: written.append(df) or settled(df))
    pattern = re.compile("|".join(sorted(map(re.escape, values), key=len, reverse=True)), re.IGNORECASE | re.ASCII)
    want = {r.id: [(len(r.text[: m.start()].encode()), m.group()) for m in pattern.finditer(r.text)] for r in rows.collect()}
    for block in (1000, 7, 2):
        written.clear()
        assert {r.id: [(e.start, e.value) for e in r.entities] for r in dictionary_table(rows, entries, block=block).collect()} == want
        assert len(written) <= 3


def test_bodies_gate_redact_and_restore(spark):
    deep = "[" * 100_000 + '"a@b.org"' + "]" * 100_000
    given = {"j": '{"k@x.org":"to a@b.org and a@b.org","n":1.50,"arguments":"{\\"c\\":\\"c@d.org\\"}","data":"z@z.org","file_path":"/h/p@q.org"}', "t": "plain a@b.org", "d": deep, "e": '{"a":[]}'}
    rows = spark.createDataFrame(list(given.items()), "request_id string, body string")
    out, mapping = bodies.redact(rows, rules=["email"], block_types=["email"], preserve=("file_path",))
    got = {r.request_id: r for r in out.collect()}
    assert got["j"].rewritten == '{"k@x.org":"to <<email_1>> and <<email_1>>","n":1.50,"arguments":"{\\"c\\":\\"<<email_2>>\\"}","data":"z@z.org","file_path":"/h/p@q.org"}'
    assert got["t"].rewritten == "plain <<email_1>>" and got["e"].rewritten == '{"a":[]}' and not got["e"].has_pii and got["j"].tool_arguments == 1
    assert got["d"].rewritten == deep.replace("a@b.org", "<<email_1>>") and got["j"].blocked and not got["e"].blocked and all(e.value is None for e in got["j"].entities)
    back = {r.request_id: r.restored for r in bodies.restore_bodies(out.select("request_id", F.col("rewritten").alias("body")), mapping).collect()}
    assert back == given
    shown, none = bodies.redact(rows.where("request_id = 't'"), gate_only=True, include_values=True, rules=["email"])
    row = shown.head()
    assert none is None and row.rewritten == given["t"] and not row.changed and [e.value for e in row.entities] == ["a@b.org"]


def test_bodies_come_back_byte_for_byte(spark):
    odd = ['{ "a" : 1.7e9 ,\n"a":0.1000000000000000055511, "t":"\\u00e9 \\ud800 x" , "arguments" : "{ \\"n\\" : 1.50, \\"deep\\" : \\"y\\" }" }', '[1e400,-0,"\\/"]  ', '""', "null", "not {json", "", '{"text":"x","type":"reasoning"}']
    rows = spark.createDataFrame(list(enumerate(odd)), "request_id int, body string")
    out, _ = bodies.redact(rows, rules=["email"])
    assert {r.request_id: (r.rewritten, r.changed) for r in out.collect()} == {k: (b, False) for k, b in enumerate(odd)}
    mixed = '{"keep":"\\u00e9","arguments":"{\\"q\\" : \\"to a@b.org\\", \\"n\\":1.50}","n":1.0}'
    out, _ = bodies.redact(spark.createDataFrame([(1, mixed)], "request_id int, body string"), rules=["email"])
    assert out.head().rewritten == mixed.replace("a@b.org", "<<email_1>>")


def test_json_reader_agrees_with_a_plain_one():
    rng = random.Random(4)

    def made(depth):
        r = rng.random()
        if depth > 4 or r < 0.4:
            return rng.choice([1, -2.5e10, True, None, 'a"b\n\u00e9', "", 0])
        return [made(depth + 1) for _ in range(rng.randint(0, 3))] if r < 0.7 else {rng.choice("abc\n"): made(depth + 1) for _ in range(rng.randint(0, 3))}

    for _ in range(3000):
        text = json.dumps(made(0), indent=rng.choice([None, 1]), ensure_ascii=rng.random() < 0.5)
        if rng.random() < 0.6:
            k = rng.randrange(len(text) + 1)
            text = text[:k] + rng.choice(['"', ",", "]", "}", "{", "[", ":", "1", "e", ".", "-", "\\", "\t", "\x01", "tru"]) + text[k + rng.randint(0, 1) :]
        try:
            json.loads(text, parse_constant=lambda _: 1 / 0)
            fine = True
        except (ValueError, ZeroDivisionError):
            fine = False
        try:
            assert jsontext.Tape(text).splice([]) == text and fine
        except ValueError:
            assert not fine


@pytest.mark.parametrize("everything", [True, False])
def test_a_gate_stays_shut_for_null_and_repeated_ids(spark, everything):
    body = '{"messages":[{"content":"to %s@x.org"}]}'
    rows = spark.createDataFrame([(None, body % "a"), (None, body % "b"), ("r", body % "a"), ("r", body % "c"), ("s", None)], "request_id string, body string")
    out, mapping = bodies.redact(rows, rules=["email"], everything=everything)
    got = out.collect()
    assert len(got) == 5 and all(r.has_pii and r.blocked and r.changed and "@" not in r.rewritten for r in got if r.body)
    assert sorted((r.request_id or "", r.original) for r in mapping.collect()) == [("", "a@x.org"), ("", "b@x.org"), ("r", "a@x.org"), ("r", "c@x.org")]
    back = bodies.restore_bodies(out.select("request_id", F.col("rewritten").alias("body"), F.col("body").alias("was")), mapping)
    assert all(r.restored == r.was for r in back.collect())
    shut, _ = bodies.redact(rows, gate_only=True, rules=["email"], everything=everything)
    assert [r.blocked for r in shut.where("body IS NOT NULL").collect()] == [True] * 4


@pytest.mark.parametrize(("a", "b", "same"), [("1", "1.0", True), ("9007199254740992", "9007199254740993", False), ("1e2", "100", True), ("-0", "0", True), ("0.10", "1e-1", True), ("[" * 50_000 + "]" * 50_000, "[" * 50_000 + " ]" * 50_000, True), ('{"a":1,"a":2}', '{"a":2}', True), ('"\\u0061"', '"a"', True), ('{"a":1,"b":[2]}', '{"b":[2],"a":1}', True), ("[1,2]", "[2,1]", False), ("true", "1", False), ("null", "null", True), ("x", "x", False), ('{"a":null}', "{}", False), ("NaN", "NaN", False)])
def test_json_values(spark, a, b, same):
    assert bodies.json_equal.func(*map(lambda v: __import__("pandas").Series([v]), (a, b)))[0] == same


@pytest.mark.parametrize(("url", "local"), [("http://localhost:8/x", True), ("https://a.localhost", True), ("http://127.0.0.1", True), ("http://[::1]:9", True), ("http://10.1.2.3", True), ("http://172.31.0.1", True), ("http://172.32.0.1", False), ("http://8.8.8.8", False), ("http://example.org", False), ("ftp://10.0.0.1", False), ("10.0.0.1", False), ("http://0.0.0.0", True), ("http://169.254.1.1", True), ("http://[fd00::1]", True), ("http://x:99999999", False)])
def test_local_endpoints(url, local):
    assert V.local_endpoint(url) == local


def test_failing_backend_gives_null_and_spares_the_others(spark):
    def call(lines):
        if any("bad" in x for x in lines):
            raise RuntimeError("down")
        return ['{"category":"benign"}' for _ in lines]

    rows = spark.createDataFrame([("ok",), ("bad",), ("ok too",)], "line string").coalesce(1)
    assert {r.line: r.answer and r.answer.category for r in backends.judge_by(rows, call).collect()} == {"ok": "benign", "bad": None, "ok too": "benign"}


def test_engines_and_probes(spark):
    own = {"block": 0.9, "review": 0.5, "redact": 0.2}
    assert backends.engine_bands([{"name": "a", "kind": "http", "bands": own}, {"name": "b", "kind": "rules"}], {"block": 0.8, "review": 0.4, "redact": 0.1}) == {"a": own, "b": {"block": 0.8, "review": 0.4, "redact": 0.1}}
    for bad in ([], [{"name": "", "kind": "rules"}], [{"name": "a", "kind": "x"}], [{"name": "a", "kind": "rules"}] * 2, [{"name": "a", "kind": "rules", "bands": {"block": 0.5, "review": 0.5, "redact": 0.1}}]):
        with pytest.raises(ValueError):
            backends.engine_bands(bad)
    cases = spark.createDataFrame([("b", "exfil"), ("a", "benign"), ("c", "benign")], "name string, want string")
    assert [(r.name, r.kind) for r in backends.probes_of(cases, 2).collect()] == [("a", "benign"), ("b", "dangerous")]


def test_percentile_of_ties_and_many_values(spark):
    rng = random.Random(3)
    values = {"ties": [5.0] * 900 + [7.0] * 100, "spread": [rng.expovariate(1e-3) ** 3 for _ in range(5000)], "one": [-1.0], None: [float(k) for k in range(100)]}
    rows = spark.createDataFrame([(k, v) for k, vs in values.items() for v in vs] + [("ties", None)], "k string, v double")
    for q in (0.0, 0.5, 0.95, 1.0):
        got = {r.k: r.percentile for r in reports.percentile(rows, "v", ["k"], q).collect()}
        assert got == {k: sorted(vs)[int(q * (len(vs) - 1))] for k, vs in values.items()}


def test_identity_card_and_fakes(spark):
    card = spark.createDataFrame([("zh_phone", "13800138000"), ("email", "a@b.org"), ("url", "x"), ("date", " ")], "type string, real string")
    own = spark.createDataFrame([("email", "a@b.org", "mine@b.org")], "type string, real string, fake string")
    got = {r.type: r.fake for r in simulate.expand_identity(card, own).collect()}
    again = {r.type: r.fake for r in simulate.expand_identity(card, own).collect()}
    assert set(got) == {"zh_phone", "email"} and got["email"] == "mine@b.org" and got == again and got["zh_phone"] != "13800138000"
    row = spark.createDataFrame([("广东省深圳市南山区科技路1号",)], "v string").select(simulate.fake("zh_address", F.col("v"), "k").alias("f")).head()
    assert re.fullmatch("(.{2,4}[省市])(.{2,4}市)?.{2,4}区.{2,5}[路街道]{1,2}[0-9]{1,3}号", row.f)


def test_settings_of_a_file(spark, tmp_path):
    path = tmp_path / "settings.json"
    path.write_text(json.dumps({"strategy": "${MODE:-bypass}", "thresholds": {"email": 0.9}, "dictionary": {"Bob": "plate"}}))
    read = config.Settings.read(spark, str(path), {})
    assert read.strategy == "bypass" and read.thresholds == {"email": 0.9} and read.dictionary == {"Bob": "plate"}
    path.write_text('{"nope": 1}')
    with pytest.raises(ValueError):
        config.Settings.read(spark, str(path), {})


def test_request_and_dictionary_files(spark, tmp_path):
    (tmp_path / "r.json").write_text("\n".join(json.dumps(x) for x in ({"request_id": "a", "endpoint": "/v1/chat/completions?x=1", "body": '{"model":"m","stream":true}'}, {"request_id": "b", "endpoint": "rerank", "body": "no json"})))
    got = {r.request_id: (r.endpoint, r.known, r.model, r.stream) for r in io.read_requests(spark, str(tmp_path / "r.json")).collect()}
    assert got == {"a": ("chat/completions", True, "m", True), "b": ("rerank", False, None, False)}
    io.write_dictionary(spark.createDataFrame([("plate", " AB-1 "), ("plate", "AB-1")], "type string, value string"), str(tmp_path / "d"))
    assert [tuple(r) for r in io.read_dictionary(spark, str(tmp_path / "d"), ["plate"]).collect()] == [("plate", "AB-1")]
    with pytest.raises(ValueError):
        io.read_dictionary(spark, str(tmp_path / "d"), ["email"])


def test_restoring_needs_the_right_request(spark):
    mapping = spark.createDataFrame([("r", "<<email_1>>", "a@b.org", "reversible"), ("s", "<<email_1>>", "c@d.org", "reversible"), ("s", "fake@d.org", "e@f.org", "reversible"), ("s", "***", "secret", "mask")], "request_id string, shown string, original string, fate string")
    texts = spark.createDataFrame([("r", "<<email_1>> fake@d.org <<email_2>>"), ("s", "<<email_1>> fake@d.org ***"), ("t", "<<email_1>>"), ("r", None), ("r", "<<email_1>> fake@d.org <<email_2>>")], "request_id string, text string")
    got = sorted((r.request_id, r.restored or "") for r in R.restore(texts, mapping).collect())
    assert got == [("r", ""), ("r", "a@b.org fake@d.org <<email_2>>"), ("r", "a@b.org fake@d.org <<email_2>>"), ("s", "c@d.org e@f.org ***"), ("t", "<<email_1>>")]


def test_long_requests_are_numbered_by_stretches(spark, monkeypatch):
    monkeypatch.setattr(R, "STRETCH", 2)
    texts = [f"u{k % 9}@x.org and v{k}@y.org" for k in range(40)]
    rows = spark.createDataFrame([("r", k, t) for k, t in enumerate(texts)] + [(None, 0, "a@b.org")], "request_id string, seq int, text string").withColumn("entities", detect(F.col("text"), ["email"]))
    _, mapping = R.replace(rows)
    got = {(r.request_id, r.original): r.placeholder for r in mapping.collect()}
    order = list(dict.fromkeys(x for t in texts for x in re.findall(r"[a-z0-9]+@[a-z.]+", t)))
    assert got == {("r", x): f"<<email_{i}>>" for i, x in enumerate(order, 1)} | {(None, "a@b.org"): "<<email_1>>"}


def test_store_and_sinks(spark, tmp_path):
    tables = spark.sql("select * from values ('a', timestamp'2024-01-01 00:10:00'), ('b', timestamp'2024-01-01 00:30:00') as t(request_id, expires_at)")
    now = F.lit("2024-01-01 00:20:00").cast("timestamp")
    asked = spark.createDataFrame([("a",), ("b",), ("c",)], "request_id string")
    assert [r.request_id for r in stores.lookup(tables, asked, now).collect()] == ["b"] and stores.size(tables, now).head()["size"] == 1
    assert [r.request_id for r in stores.forget(tables, asked.where("request_id = 'b'")).collect()] == ["a"]
    uses = spark.sql("select * from values (1, timestamp'2024-01-01 00:00:00'), (1, timestamp'2024-01-01 00:05:00') as t(conv_id, at)")
    assert str(stores.renewed(uses, 60).head().expires_at) == "2024-01-01 00:06:00"
    out = tmp_path / "sent"
    out.mkdir()

    def connect(folder=str(out)):
        import uuid

        name = f"{folder}/{uuid.uuid4().hex}"
        return lambda line: open(name, "a").write(line + "\n")

    io.publish(asked, connect)
    assert sorted(json.loads(x)["request_id"] for f in out.iterdir() for x in f.read_text().splitlines()) == ["a", "b", "c"]
    io.write_metrics(reports.exposition(reports.counter(asked, "tool_calls_scanned")), str(tmp_path / "m"))
    assert [r.value for r in spark.read.text(str(tmp_path / "m")).collect()] == ["tool_calls_scanned 3"]
