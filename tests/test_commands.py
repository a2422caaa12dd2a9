import pytest

from spanveil.operators import bodies, commands
from spanveil.plans import catalog


@pytest.mark.parametrize(
    ("line", "want"),
    [
        ("a 'b c' \"d\\\"e\" f\\ g", [["a", "b c", 'd"e', "f g"]]),
        ("a&&b||c;d|e>>f", [["a"], ["b"], ["c"], ["d"], ["e"], ["f"]]),
        ("x 'open", [["x", "open"]]),
        ('y "open \\" z', [["y", 'open " z']]),
        ("", []),
        ("''", [[""]]),
    ],
)
def test_tokens(line, want):
    assert commands.split_commands(line) == want


def test_wrappers_are_peeled():
    assert commands.expand_commands("sudo -E env A=1 B=2 tar c . ; bash -c 'sh -c \"rm -rf x\"'") == [["tar", "c", "."], ["rm", "-rf", "x"]]


def test_judgement_of_known_commands(spark):
    rows = spark.createDataFrame([(i, c) for i, (c, _, _) in enumerate(catalog.COMMANDS)], "k int, line string")
    got = {r.k: (r.category, r.severity) for r in commands.judge(rows, ["trusted.example.com"]).collect()}
    for i, (line, category, severity) in enumerate(catalog.COMMANDS):
        assert got[i] == (category, severity), line


def test_chain_takes_the_first_that_knows(spark):
    from pyspark.sql import functions as F

    s = lambda c: F.struct(F.lit(c).alias("category"))
    row = spark.range(1).select(commands.chain(s("unknown"), s("archive")).alias("a"), commands.chain(s("unknown"), s("unknown")).alias("b")).head()
    assert (row.a.category, row.b.category) == ("archive", "unknown")


def test_bodies_keep_numbers_and_opaque_parts():
    body = '{"a":1.50,"content":"x","type":"message","image":{"type":"image","data":"y"},"arguments":"{\\"q\\":\\"z\\"}","summary":"no"}'
    texts = [t for _, t, _ in bodies.texts_in(body)]
    assert texts == ["x", "message", "z"]
    out = bodies.with_texts(body, [t.upper() for t in texts])
    assert '"a":1.50' in out and '"data":"y"' in out and '\\"q\\":\\"Z\\"' in out and '"summary":"no"' in out
    assert bodies.texts_in("not json") == [("", "not json", None)]
