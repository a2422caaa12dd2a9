import pytest
from pyspark.sql import functions as F

from spanveil.functions.config import Settings, expand
from spanveil.operators import backends, commands, reports
from spanveil.streaming.incremental import new_segments


def test_detector_outside(spark):
    def call(texts):
        return [[{"type": "email", "value": t[:2], "start": 0, "end": 2, "score": 0.9}] if t else [] for t in texts]

    rows = spark.createDataFrame([(1, "abc"), (2, None)], "id int, text string")
    assert {r.id: len(r.entities) for r in backends.detect_by(rows, call).collect()} == {1: 1, 2: 0}


@pytest.mark.parametrize(("text", "want"), [('```json\n{"category":"archive","severity":7,"reasons":["a","b","c","d","e"]}\n```', ("archive", 1.0, 1.0, 4)), ('I think {not} {"category":"benign","confidence":0.2}', ("benign", 0.0, 0.2, 0)), ('{"category":"nonsense"}', None), (None, None), ("", None)])
def test_answers_keep_a_contract(text, want):
    got = backends.read_answer(text)
    assert (got and (got["category"], got["severity"], got["confidence"], len(got["reasons"]))) == want


def test_probes_pass_the_rules(spark):
    rows = spark.createDataFrame(backends.PROBES, "kind string, line string")
    r = backends.probe_verdict(commands.judge(rows)).head()
    assert (r.total, r.errors, r.miss_rate, r.false_alarm_rate, r.healthy) == (20, 0, 0.0, 0.0, True)


def test_verdicts(spark):
    answer = "struct<category:string,severity:double,confidence:double>"
    rows = [("Bash", "x", None, ("archive", 0.9, 1.0)), ("Bash", "x", ("unknown", 0.0, 1.0), ("benign", 0.0, 1.0)), ("Bash", "x", ("exfil", 0.95, 0.3), None), ("Safe", "x", None, None), ("Bash", "https://a.trusted.org/p", None, None), ("Bash", "x", None, None)]
    df = spark.createDataFrame(rows, f"tool string, target string, a {answer}, b {answer}")
    v = backends.evaluate(F.col("tool"), F.col("target"), [F.col("a"), F.col("b")], ["Safe"], [".trusted.org"])
    got = [(r.v.action, r.v.category, r.v.degraded) for r in df.select(v.alias("v")).collect()]
    assert got == [("block", "archive", True), ("allow", "benign", True), ("review", "exfil", False), ("allow", "benign", False), ("allow", "benign", False), ("review", "unknown", True)]


def test_capabilities():
    a = {"categories": ["exfil"], "schema_modes": ["gbnf"], "gives_confidence": False, "max_input_bytes": 0, "deterministic": True}
    b = {"categories": ["benign"], "schema_modes": ["format"], "gives_confidence": True, "max_input_bytes": 9, "deterministic": False}
    assert backends.joint_capabilities([a, b]) == {"categories": ["benign", "exfil"], "schema_modes": ["gbnf", "format"], "gives_confidence": True, "max_input_bytes": 9, "deterministic": False}
    assert backends.best_schema_mode(["format", "gbnf"]) == "gbnf" and backends.best_schema_mode([]) == "prompt_only"


def test_scores_and_percentiles(spark):
    s = "id int, type string, value string, start int, end int"
    e = spark.createDataFrame([(1, "email", "a@b.c", 0, 5), (1, "url", "x", 7, 8)], s)
    f = spark.createDataFrame([(1, "email", "a@b", 0, 3), (1, "url", "x", 7, 8), (2, "url", "x", 7, 8)], s)
    assert tuple(reports.entity_scores(e, f).head()) == (1, 1, 2) and tuple(reports.entity_scores(e, f, strict=False).head()) == (2, 0, 1)
    v = spark.createDataFrame([("g", float(x)) for x in range(1, 6)], "k string, v double")
    assert reports.percentile(v, "v", ["k"], 0.95).head().percentile == 4.0
    assert [reports.percentile_nearest(v, "v", ["k"], p).head().percentile for p in (50, 95, 1)] == [2.0, 5.0, 1.0]


def test_settings_are_strict():
    s = Settings.load({"strategy": "${S:-simulate}", "dictionary": {"${WHO}": "zh_person_name"}}, {"WHO": "Bob"})
    assert s.strategy == "simulate" and s.dictionary == {"Bob": "zh_person_name"} and expand("a${X}b", {}) == "ab"
    for bad in ({"nope": 1}, {"strategy": "x"}, {"forced": ["x"]}, {"fakes": {"token": {"a": "b"}}}, {"fakes": {"email": {"a": "b", "c": "b"}}}, {"thresholds": {"email": 2}}):
        with pytest.raises(ValueError):
            Settings.load(bad)


def test_stream_of_snapshots(spark, tmp_path):
    schema = "conv_id string, version long, segments array<string>"
    rows = [("c", 1, ["a"]), ("c", 2, ["a", "b"]), ("c", 3, ["a", "x", "y"]), ("c", 4, ["a", "x", "y"])]
    spark.createDataFrame(rows, schema).coalesce(1).write.json(str(tmp_path / "in"))
    q = new_segments(spark.readStream.schema(schema).json(str(tmp_path / "in"))).writeStream.format("memory").queryName("fresh").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [(r.version, r.place, r.segment) for r in spark.table("fresh").orderBy("version", "place").collect()] == [(1, 0, "a"), (2, 1, "b"), (3, 1, "x"), (3, 2, "y")]
