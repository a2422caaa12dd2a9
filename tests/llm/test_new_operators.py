"""SentencePiece by distinct words, the filter audit and periodic runs: against the library, a plain count and a brute-force search, and on odd rows."""

import hashlib
import os
import random
import zlib
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanveil.llm import interactions, queries, repeats, sentencepieces

DIR = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables here")


def sha(text):
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


# periodic runs


def brute_runs(w, least=24, times=3):
    n, out = len(w), []
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            size = j - i + q
            if size >= max(least, times * q) and not any(all(w[k] == w[k + p] for k in range(i, i + size - p)) for p in range(1, q)):
                out.append((i, size, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def odd_texts(rng, n):
    out = []
    for _ in range(n):
        words, size, k = [], rng.randint(0, 90), rng.choice([1, 2, 3, 8, 50])
        while len(words) < size:
            if rng.random() < 0.4:
                words += [rng.randrange(k) for _ in range(rng.randint(1, 9))] * rng.randint(1, 7)
            elif rng.random() < 0.3 and words:
                words += words[: rng.randint(1, 30)]
            else:
                words += [rng.randrange(k) for _ in range(rng.randint(1, 10))]
        out.append(np.array(words, np.int64))
    return out


@pytest.mark.parametrize("few", [0, 24])
def test_runs_are_those_of_a_plain_search(monkeypatch, few):
    monkeypatch.setattr(repeats, "FEW", few)  # whole arrays at a time, and one place at a time
    rng = random.Random(few)
    for _ in range(120):
        texts = odd_texts(rng, rng.randint(0, 5))
        for least, times in ((24, 3), (2, 2), (6, 2), (1, 3)):
            assert repeats.runs_of(texts, least, times) == [brute_runs(t.tolist(), least, times) for t in texts]


def test_runs_of_one_word_and_of_long_periods():
    assert repeats.runs_of([np.zeros(20_000, np.int64)]) == [[(0, 20_000, 1)]]
    assert repeats.runs_of([np.tile(np.arange(3000), 4), np.arange(9000)]) == [[(0, 12_000, 3000)], []]


def test_find_runs_on_odd_rows(spark):
    text = "start " + "one two " * 15 + "end"
    given = [(1, text, "x", 5), (1, text, "x", 5), (None, None, None, 6), (3, "", "y", 7), (4, " \t\n", "z", 8), (5, "ab " * 30_000, "w", 9), (6, "é ü é ü " * 10, "v", 1)]
    docs = spark.createDataFrame(given, "doc_id long, text string, runs string, `a``b` int").withColumn("collapsed", F.lit(1))
    out = repeats.find_runs(docs)
    assert out.columns == ["doc_id", "text", "a`b", "n_words", "runs", "collapsed"]
    got = {r["a`b"]: (r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in out.collect()}
    assert out.count() == 7 and got[5] == (32, [(1, 30, 2)], "start one two end")
    assert got[6] == got[7] == got[8] == (0, [], "") and got[9] == (30_000, [(0, 30_000, 1)], "ab") and got[1] == (40, [(0, 40, 2)], "é ü")
    assert repeats.find_runs(docs.limit(0)).count() == 0


@tables
def test_periodic_runs_query(spark):
    rows = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: tuple(r) for r in queries.op13(spark, DIR).collect()}
    assert len(got) == len(rows)
    for i, text in rows:
        w = (text or "").encode().split()
        n, h = len(w), zlib.crc32(str(i).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
        if n > 2500:
            continue
        runs = brute_runs(w)
        cut = {k for s, size, q in runs for k in range(s + q, s + size)}
        best = min(runs, key=lambda r: (-(10**12) * r[1] // r[2], r[0], r[2])) if runs else (None, None, None)
        milli = 1000 * best[1] // best[2] if runs else None
        assert got[i] == (i, len(runs), *best, milli, sha("".join(f"{s},{size},{q}\n" for s, size, q in runs)), sha(b" ".join(x for k, x in enumerate(w) if k not in cut)))


# SentencePiece


@pytest.fixture(scope="module")
def model():
    return pytest.importorskip("public_tokenizers").path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library(model):
    return pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=model)


def test_words_segment_and_decode_as_the_library_does(model, library):
    with open(model, "rb") as f:
        own = sentencepieces.Segmenter(f.read())
    rng = random.Random(5)
    alphabet = [*"aabbcdeth ▁\n\t\r  é中🙂\x00́", "<s>", "</s>", "<unk>", "<0x0A>", "the", "ing", " ", "   "]
    for _ in range(4000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30)))
        ids = library.encode(text)
        assert [i for w in own.words(text) for i in own.segment(w)] == ids and own.text(ids) == library.decode(ids)
        free = [rng.randrange(400) if rng.random() < 0.7 else rng.randrange(32_000) for _ in range(rng.randint(0, 12))]
        assert own.text(free) == library.decode(free)
    assert own.segment("ab" * 50_000) == library.encode("ab" * 50_000)


def test_encode_and_decode_on_odd_rows(spark, model, library, monkeypatch):
    texts = [("a", "Hello world\nHello  again "), ("a", "Hello world\nHello  again "), (None, None), ("b", ""), ("c", " "), ("d", "x" * 70_000), ("e", "the the the ▁the \n\n the"), (None, "tail")]
    docs = spark.createDataFrame([(i, t, 1, "c") for i, t in texts], "doc_id string, text string, ids int, places string").repartition(3)
    out = sentencepieces.decode(sentencepieces.encode(docs, model), model)
    assert out.columns == ["doc_id", "ids", "decoded"]
    got = sorted((r.doc_id or "", list(r.ids), r.decoded) for r in out.collect())
    assert got == sorted((i or "", library.encode(t or ""), library.decode(library.encode(t or ""))) for i, t in texts)
    assert sentencepieces.encode(docs.limit(0), model).count() == 0
    nulls = sentencepieces.decode(spark.createDataFrame([(None,), ([],)], "ids array<int>"), model, into="text").collect()
    assert [r.text for r in nulls] == [None, ""]


def test_slices_are_cut_by_size(spark, model, library, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(sentencepieces, "SLICE", 200)
    with open(model, "rb") as f:
        deal = sentencepieces._deal(f.read())
    texts = [f"word{k % 7} and {k}" * 5 for k in range(30)]
    batches = [pa.RecordBatch.from_pydict({"doc_id": [k], "text": [t]}) for k, t in enumerate(texts)]
    out = list(deal(iter(batches)))
    assert len({x for b in out for x in b.column("slice").to_pylist()}) > 5


def test_a_model_whose_pieces_cross_words_is_refused(monkeypatch):
    monkeypatch.setattr(sentencepieces, "read_model", lambda _: {"a▁b": 0.0})
    with pytest.raises(ValueError, match="crosses"):
        sentencepieces.Segmenter(b"")


@tables
def test_sentencepiece_query(spark, library):
    want = {}
    for i, text in spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").collect():
        ids = library.encode(text or "")
        want[i] = (i, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids)))
    assert {r.doc_id: tuple(r) for r in queries.op11(spark, DIR).collect()} == want


# filter audit


def plain_audit(rows, filters, marks):
    out, shapley = {}, {}
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        for order in permutations(range(len(filters))):
            left = own
            for step, k in enumerate(order):
                gone = [r for r in left if r[1][k]]
                left = [r for r in left if not r[1][k]]
                failing = sum(r[1][k] for r in own)
                out[part, "".join(filters[j] for j in order), step + 1] = [len(left), len(gone), failing - len(gone), sum(r[1][k] and sum(r[1]) == 1 for r in own), *(sum(r[2][m] for r in gone) for m in range(len(marks)))]
                shapley[part, k] = shapley.get((part, k), 0) + len(gone)
        for order in permutations(range(len(filters))):
            for step, k in enumerate(order):
                out[part, "".join(filters[j] for j in order), step + 1].append(shapley[part, k])
    return out


@pytest.mark.parametrize("filters", ["ABC", "Z", "ABCD"])
def test_audit_is_a_plain_run_of_every_order(spark, filters):
    rng = random.Random(len(filters))
    rows = [(rng.choice(["p", "q", ""]), tuple(rng.random() < 0.4 for _ in filters), (rng.random() < 0.5, rng.random() < 0.2)) for _ in range(300)] + [("clean", (False,) * len(filters), (True, True))]
    given = [(p or None, *f, *m) for p, f, m in rows]
    df = spark.createDataFrame(given, "part string, " + ", ".join(f"{x} boolean" for x in filters) + ", good boolean, toxic boolean")
    df = df.withColumn("good", F.when(F.col("good"), True)).withColumn("removed", F.lit("clash"))  # nulls count as false
    got = {(r.part, r.filter_order, r.step): list(r)[3:] for r in interactions.audit(df, list(filters), ["good", "toxic"]).collect()}
    assert got == plain_audit(rows, filters, ["good", "toxic"])
    assert interactions.audit(df.limit(0), list(filters), ["good"]).count() == 0


def test_failures_of_odd_texts(spark):
    long = " ".join(f"w{k}" for k in range(250))
    given = [(1, "Same", None), (2, "Same", "s"), (2, "Same", "s"), (None, "Same", "s"), (3, None, "s"), (4, "", "s"), (5, long, "s"), (6, "a " * 60_000, "t"), (7, long + " $", "t"), (8, "A" * 3 + "é" * 97 + " x", "t")]
    docs = spark.createDataFrame([(*r, "clash", 1) for r in given], "doc_id long, text string, source string, digest string, first int")
    got = sorted(((r.doc_id or 0), r.part, "".join(x for x in "ABCDE" if r[x])) for r in interactions.text_failures(docs).collect())
    assert got == sorted([(1, "", "AC"), (2, "s", "ACE"), (2, "s", "ACE"), (0, "s", "AC"), (3, "s", "A"), (4, "s", "AE"), (5, "s", ""), (6, "t", "B"), (7, "t", "D"), (8, "t", "AC")])
    assert interactions.text_failures(docs.limit(0)).count() == 0


# rows that earlier rounds lost


def test_null_and_empty_conversations_are_two(spark):
    from spanveil.llm import chat

    rows = [("", 0, "user", "of the empty id"), (None, 0, "user", "of none"), ("null", 0, "user", "of a word"), ("", 1, "assistant", "a" * 200_000), (None, None, None, None)]
    df = spark.createDataFrame(rows, "conv_id string, turn long, role string, text string").withColumn("tree", F.lit("clash")).withColumn("id", F.lit(1))
    got = {r.tree: chat.read_turns(r.text) for r in chat.format_conversations(chat.chain(df)).collect()}
    assert got == {"": [("user", "of the empty id"), ("assistant", "a" * 200_000)], None: [("", ""), ("user", "of none")], "null": [("user", "of a word")]}


@pytest.mark.parametrize("kind", ["long", "string"])
def test_rows_without_ids_keep_their_links(spark, kind):
    from spanveil.llm import jaccard

    words = [f"w{k}" for k in range(200)]
    change = lambda *at: " ".join("x" if k in at else w for k, w in enumerate(words))
    rows = [(1, change(10, 30, 60, 85)), (None, change(60)), (2, change(60, 110, 150, 180)), (None, "alone and short"), (None, "p q r s t u"), (None, "p q r s t u"), (3, "p q r s t u v w x y z")]
    # 1 and 2 are linked only by way of the row without an id
    sets = [{tuple(t.split()[k : k + 5]) for k in range(max(1, len(t.split()) - 4))} for _, t in rows]
    assert 100 * len(sets[0] & sets[2]) < 80 * len(sets[0] | sets[2]) and all(100 * len(sets[a] & sets[1]) >= 80 * len(sets[a] | sets[1]) for a in (0, 2))
    df = spark.createDataFrame([(None if i is None else str(i) if kind == "string" else i, t) for i, t in rows], f"doc_id {kind}, text string")
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.n_links) for r in jaccard.join(df).collect())
    assert got == sorted([("1", 196, "1", 1), ("None", 196, "1", 2), ("2", 196, "1", 1), ("None", 1, "None", 0), ("None", 2, "None", 1), ("None", 2, "None", 1), ("3", 7, "3", 0)])


def test_benchmark_items_of_any_id_in_any_blocks(spark):
    from spanveil.llm import decontaminate

    item = "the quick brown fox jumps over the lazy dog near the river bank"
    other = "seventeen green bottles were standing on a wall behind the old mill"
    docs = spark.createDataFrame([(1, f"so {item} ended", 5), (1, f"so {item} ended", 5), (None, f"{other} and {item}", 6), (2, None, 7), (3, "", 8), (4, "nothing here " * 20_000, 9)], "doc_id long, text string, __row int").withColumn("block", F.lit("clash"))
    bench = spark.createDataFrame([("a", item), ("b", other), ("a", item), ("c", None), (None, item), ("d", "")], "item_id string, text string")
    for chars in (10**6, 1):
        out = decontaminate.find_items(docs, bench, block_chars=chars)
        assert out.columns == ["doc_id", "text", "__row", "block", "hits"]
        got = sorted((r["__row"], sorted(h.item_id for h in r.hits)) for r in out.collect())
        assert got == [(5, ["a", "a"]), (5, ["a", "a"]), (6, ["a", "a", "b"]), (7, []), (8, []), (9, [])]
        assert sorted(r["__row"] for r in decontaminate.decontaminate(docs, bench, block_chars=chars).collect()) == [7, 8, 9]


def test_token_counts_take_words_from_memory(model, library, monkeypatch):
    from spanveil.llm import tokencount

    with open(model, "rb") as f:
        machine = tokencount.Transducer(f.read())
    assert machine.words_apart
    monkeypatch.setattr(tokencount, "WORDS", 5)
    rng = random.Random(8)
    parts = ["the", "ing", " ", "  ", "\n", "▁", "é", "中", "a1", "-", "x" * 20]
    for _ in range(800):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 40)))
        assert machine.count(text) == machine.count(text, rng.randint(1, 9)) == len(library.encode(text))


@tables
def test_toxicity_query_is_a_plain_run_of_its_steps(spark):
    """Sample, thirds, lexicon, trees and calibration in one process, from the tables; the parts themselves are held against brute force elsewhere."""
    import math
    from collections import Counter

    from spanveil.llm import toxicity as T

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").collect()}
    labels = {}
    for r in spark.read.parquet(f"{DIR}/labels.parquet").collect():
        if r.toxic is not None and zlib.crc32(str(r.doc_id).encode()) % 4 != 2:
            labels[r.doc_id] = max(labels.get(r.doc_id, 0), r.toxic)
    hashes = {r.i: r.h for r in spark.createDataFrame([(i,) for i in labels], "i long").select("i", F.xxhash64(F.lit(17), "i").alias("h")).collect()}
    chosen = sorted(labels, key=lambda i: (hashes[i], i))[: T.SAMPLE]
    third = {i: hashes[i] % 3 for i in chosen if i in texts}
    has, size = [Counter(), Counter()], Counter()
    for i in (i for i in third if third[i] == 0):
        size[labels[i]] += 1
        has[labels[i]].update({u for w in {w.strip(T._EDGE) for w in (texts[i] or "").lower().split()} if w for u in T.units(w)})
    weights = {u: math.log((n + 0.5) / (size[1] + 1)) - math.log((has[0][u] + 0.5) / (size[0] + 1)) for u, n in has[1].items() if n >= 3}
    lexicon = {u: w for u, w in sorted(weights.items()) if w >= 1.5}
    own = T.Lexicon(lexicon)
    rows = sorted((third[i], float(labels[i]), *T.features(texts[i], own)[::-1]) for i in third if third[i] > 0)
    of = lambda k: (np.array([r[2:][::-1] for r in rows if r[0] == k]).reshape(-1, len(T.FEATURES)), np.array([r[1] for r in rows if r[0] == k]))
    trees = T.Trees().fit(*of(1))
    x, y = of(2)
    calibrated = T.Isotonic(trees.margin(x), y)
    got = {r.doc_id: r for r in queries.op7(spark, DIR).collect()}
    assert set(got) == set(texts)
    for i, text in texts.items():
        want = float(np.clip(calibrated(trees.margin(np.array([T.features(text, own)]))), 0, 1)[0])
        assert got[i].score == pytest.approx(want, abs=1e-9) and got[i].predicted == int(got[i].score >= 0.3) and got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
