"""Queries with SQL against it, the pipeline against its stages done plainly, and the guard of the entry module."""

import importlib
import os
import subprocess
import sys
from collections import Counter

import duckdb
import pytest

from spanveil.llm import queries
from rows import rows

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables here")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_says_what_its_sql_says(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    got, want = queries.queries()[name](spark, DIR).toPandas(), con.execute(queries.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def test_pipeline_stages_take_effect(spark):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    columns, before = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    from spanveil.llm.runtime import materialize

    for name, stage in P.STAGES[:4]:
        docs = materialize(stage(spark, docs, DIR))
        now = {r.doc_id: r.text for r in docs.collect()}
        assert docs.columns == columns and set(now) <= set(before), name
        if name == "ngram_jaccard_join":
            sets = {i: {tuple(t.lower().split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in now.items()}
            ids = sorted(sets)
            assert not any(sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) for a in ids for b in ids if a < b)
        if name == "benchmark_decontamination":
            items = [r.text for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
            assert not any(x in t for x in items for t in now.values())
        if name == "secret_scans":
            assert set(now) == set(before)
        before = now
    assert {r.n_chars == len(before[r.doc_id]) for r in docs.collect()} == {True}
    mixed = P.STAGES[4][1](spark, docs, DIR)
    assert mixed.columns == [*columns, "taken"]
    taken, size = Counter(), lambda t: len(t.split())
    for r in mixed.collect():
        assert r.text == before[r.doc_id] and 0 < r.taken <= 3 * size(r.text)
        taken[r.source] += r.taken
    assert abs(sum(taken.values()) - sum(map(size, before.values()))) <= 0.01 * sum(map(size, before.values())) + len(taken)


def test_pipeline_leaves_only_its_result(spark):
    import corpus_pipeline as P
    from spanveil.llm.runtime import shared_dir

    folder = shared_dir(spark)
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    out = P.run(spark, DIR)
    assert len(set(os.listdir(folder)) - before) == 1 and out.count() > 0 and "text" in out.columns


def test_pipeline_stages_on_odd_rows(spark):
    """Nulls, empty and repeated rows, ties, a long text, clashing columns, and no rows at all: each stage ends with a defined result."""
    import corpus_pipeline as P

    schema = "doc_id long, text string, lang string, source string, n_chars long, score string, predicted int, hits string, secrets int, taken string, size int, node string, part int, copy string, row string"
    text = "one two three four five six seven eight nine ten eleven"
    plain = [(1, text, "s"), (2, text, "s"), (2, text, "s"), (3, None, "s"), (4, "", None), (None, None, None), (None, "a b c", None), (5, "word " * 60_000, "t"), (6, "token=abcdef123456 é", "t"), (7, "x", "u")]
    docs = spark.createDataFrame([(i, t, None, s, len(t or ""), "c", 1, "c", 2, "c", 3, "c", 4, "c", "c") for i, t, s in plain], schema)
    want = {
        "toxicity": sorted((i or 0, t or "") for i, t, _ in plain),
        "ngram_jaccard_join": sorted([(0, ""), (0, "a b c"), (1, text), (3, ""), (4, ""), (5, "word " * 60_000), (6, "token=abcdef123456 é"), (7, "x")]),
        "benchmark_decontamination": sorted((i or 0, t or "") for i, t, _ in plain),
        "secret_scans": sorted((i or 0, "[SECRET] é" if i == 6 else t or "") for i, t, _ in plain),
    }
    for name, stage in P.STAGES:
        out = stage(spark, docs, DIR)
        if name == "source_mixing":
            assert sorted(out.columns) == sorted(docs.columns)
            assert {r.doc_id for r in out.collect()} >= {5} and all(0 < r.taken <= 3 * len(r.text.split()) for r in out.collect())
        else:
            assert out.columns == docs.columns and sorted((r.doc_id or 0, r.text or "") for r in out.collect()) == want[name], name
        assert stage(spark, docs.limit(0), DIR).count() == 0, name


def test_the_entry_module_works_without_these_operators(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    for x in ("spanveil", "__spark_entry__.py"):
        subprocess.run(["cp", "-r", f"{root}/{x}", tmp_path], check=True)
    subprocess.run(["rm", "-rf", tmp_path / "spanveil" / "llm"], check=True)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(sorted(e.queries()) == sorted(e.catalog.queries()), len(e.oracle_sql()) > 30)"], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert said.stdout.split() == ["True", "True"], said.stderr
    importlib.invalidate_caches()
