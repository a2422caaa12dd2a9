"""Each operator against a brute-force version, and on nulls, empty and long texts, ties, repeats, empty tables and clashing columns."""

import functools
import hashlib
import itertools
import math
import os
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spanveil.llm import chat, components, decontaminate, embeddings, jaccard, licenses, lm, mixing, secrets, tokencount, toxicity

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [f"{a}{b}" for a in ("ka", "lo", "mi", "ne", "su", "ta", "vo", "ri") for b in ("n", "rel", "dos", "mit", "pa", "x")]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def tokens(text):
    return (text or "").encode().translate(LOWER).split()


@pytest.fixture(scope="module")
def texts():
    """Ids to texts: copies, near copies, shared passages, short, empty, null and long ones."""
    rng = random.Random(3)
    base = [prose(rng, rng.randint(30, 120)) for _ in range(12)]
    out = list(base)
    out += [base[0]] * 4 + [base[1].upper()]
    for k in range(8):  # near copies of one text and chains of them
        words = base[2].split()
        for _ in range(k % 3):
            words[rng.randrange(len(words))] = "changed"
        out.append(" ".join(words))
    out += [f"{base[3]} {prose(rng, 60)}" for _ in range(5)]
    out += ["one two", "one two", "one  two three", "", None, " \n\t", "x", prose(rng, 4000), "a" * 5000]
    return dict(enumerate(out))


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", f"s{i % 3}" if i % 7 else None, len(t or "")) for i, t in texts.items()], DOCS).withColumn("score", F.lit("clash")).withColumn("hits", F.lit(1)).withColumn("secrets", F.lit(2))


def empty(spark):
    return spark.createDataFrame([], DOCS)


def groups(edges, nodes):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components_of_paths_stars_and_rings(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(200 + i, 200 + (i + 1) % 30) for i in range(30)] + [(7, 7), (500, 501), (501, 500)]
    rng.shuffle(edges)
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    want = groups(edges, {x for e in edges for x in e})
    by = defaultdict(set)
    for n, r in got.items():
        by[r].add(n)
    assert sorted(map(sorted, by.values())) == sorted(sorted(n for n in want if want[n] == r) for r in set(want.values()))
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def jaccard_brute(texts):
    sets = {}
    for i, t in texts.items():
        w = tokens(t)
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    ids = sorted(sets)
    edges = [(a, b) for a in ids for b in ids if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    return {i: len(s) for i, s in sets.items()}, groups(edges, ids), Counter(x for e in edges for x in e)


@pytest.mark.parametrize("block", [1024, 3])
def test_jaccard_join(docs, texts, block):
    n, comp, links = jaccard_brute(texts)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in jaccard.join(docs, block=block).collect()}
    assert got == {i: (n[i], comp[i], links[i]) for i in texts}


def test_jaccard_on_empty_and_repeated_rows(spark, docs, texts):
    assert jaccard.join(empty(spark)).count() == 0
    twice = jaccard.join(docs.union(docs))
    assert twice.count() == 2 * len(texts) and twice.distinct().count() == len(texts)
    kept = jaccard.keep_one(docs.union(docs))
    assert kept.columns == docs.columns
    comp = jaccard_brute(texts)[1]
    assert sorted(r.doc_id for r in kept.collect()) == sorted({i for i in texts if comp[i] == i})


def test_jaccard_of_a_text_of_more_than_65536_shingles(spark):
    long = [f"w{k}" for k in range(66_000)]
    other = [f"v{k}" for k in range(70_000)]
    near = long[:30_000] + ["changed"] + long[30_001:]
    rows = {0: prose(random.Random(17), 50), 1: " ".join(long), 2: "x", 3: " ".join(near), 4: " ".join(long[100:140]), 5: " ".join(other + long[:500]), 6: " ".join(long[100:140]), 7: None}
    df = spark.createDataFrame(list(rows.items()), "doc_id long, text string").repartitionByRange(8, "doc_id")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(df).collect()}
    n, comp, _ = jaccard_brute(rows)
    assert n[1] > 1 << 16 and (comp[3], comp[6]) == (1, 4)
    assert got == {i: (n[i], comp[i]) for i in rows}


def test_jaccard_keeps_ids_of_any_type(spark, texts):
    n, comp, links = jaccard_brute(texts)
    name = lambda i: f"{i:03}"
    rows = [(name(i), t, 1) for i, t in texts.items()] + [(None, texts[0], 2), (None, None, 3)]
    got = jaccard.join(spark.createDataFrame(rows, "doc_id string, text string, node int")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id} == {name(i): (n[i], name(comp[i])) for i in texts}
    assert sorted(r.n_shingles for r in got if r.doc_id is None) == [0, n[0]]


@pytest.mark.parametrize("light", [0, 96])
def test_divide_skip_against_counting(light, monkeypatch):
    monkeypatch.setattr(jaccard, "LIGHT", light)
    rng = random.Random(5)
    for _ in range(200):
        sets = sorted((np.array(sorted(rng.sample(range(30), rng.randint(1, 20)))) for _ in range(rng.randint(2, 40))), key=len)
        index = jaccard.Index(sets)
        for q in range(len(sets)):
            low, least = rng.randint(0, q), rng.randint(1, 12)
            got = dict(zip(*map(np.ndarray.tolist, index.search(q, low, least)), strict=True))
            assert got == {c: len({*sets[q].tolist()} & {*sets[c].tolist()}) for c in range(low, q) if len({*sets[q].tolist()} & {*sets[c].tolist()}) >= least}


def test_embeddings(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(6, 16))
    rows = []
    for i in range(160):
        c = centres[i % 6] + rng.normal(size=16) * (0.12 if i % 5 else 1.0)
        rows.append((i, c.astype(np.float32).tolist(), i % 2 if i % 31 else None))
    rows += [(200 + i, rows[4][1], 0) for i in range(5)] + [(300, None, 0), (301, [0.0] * 16, 0), (302, [float("nan")] * 16, 0), (303, [None] * 16, 0), (304, [float("inf")] + [1.0] * 15, 1), (305, [1.0] * 3, 0), (306, [1.0] * 3, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    ok = [r for r in rows if r[1] is not None and r[2] is not None and all(x is not None and math.isfinite(x) for x in r[1]) and any(r[1])]
    edges = []
    for i, a in enumerate(ok):
        for b in ok[:i]:
            if a[2] == b[2] and len(a[1]) == len(b[1]):
                u, v = np.array(a[1]), np.array(b[1])
                if u @ v / (np.linalg.norm(u) * np.linalg.norm(v)) >= 0.93:
                    edges.append((a[0], b[0]))
    n = Counter(x for e in edges for x in e)
    comp = groups(edges, [r[0] for r in rows])
    for options in ({}, {"cell": 10, "block": 7}, {"cell": 25, "max_pivots": 3, "block": 1000}):
        got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(df, **options).collect()}
        assert got == {r[0]: (n[r[0]], comp[r[0]], comp[r[0]] == r[0]) for r in rows}
    assert embeddings.near_duplicates(df.limit(0)).count() == 0
    named = df.select(F.concat(F.lit("v"), F.lpad(F.col("vec_id").cast("string"), 3, "0")).alias("vec_id"), "embedding", F.concat(F.lit("l:"), F.col("label").cast("string")).alias("label"), F.lit(1).alias("key"), F.lit(2).alias("group"), F.lit(3).alias("cell"))
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_duplicates(named.union(named)).collect()}
    assert got == {f"v{r[0]:03}": (n[r[0]], f"v{comp[r[0]]:03}") for r in rows}
    again = embeddings.near_duplicates(df.union(df.where("vec_id = 0").withColumn("embedding", F.transform("embedding", lambda x: -x)))).where("vec_id = 0").collect()
    assert len(again) == 2  # a vec_id with two vectors


def test_licences(spark):
    mit = licenses.KNOWN["MIT"]
    rows = [(1, "Copyright (c) 2020 Somebody\n\n" + mit), (2, "# MIT License\n# Copyright 1999 X\n" + "\n".join("# " + x for x in mit.split("\n"))), (3, mit + " More."), (4, None), (5, ""), (6, mit.replace("sublicense", "sub-licence").replace('"', "”").upper()), (7, "prose\nLicensed under CC BY-NC 4.0.\nprose"), (8, licenses.KNOWN["BSD-3-Clause"].replace("1.", "*")), (9, licenses.KNOWN["Zlib"] + "\n"), (10, "x\n" * 100_000 + "Released under the MIT License.\n"), (None, "// SPDX-License-Identifier: GPL-3.0"), (11, "Released under the MIT License\nLicense: ISC\nreleased under the mit license!"), (11, "Released under the MIT License\nLicense: ISC\nreleased under the mit license!")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("license_id", F.lit("clash")).withColumn("sha256", F.lit("clash")).withColumn("line", F.lit(0))
    assert {r.doc_id: r.license_id for r in licenses.scan(df.where("doc_id < 11")).collect()} == {1: "MIT", 2: "MIT", 3: None, 4: None, 5: None, 6: "MIT", 7: None, 8: None, 9: "Zlib", 10: None}
    assert sorted((r.doc_id, r.line, r.license_id) for r in licenses.scan(df.where("doc_id < 11 and doc_id > 6"), unit="line").collect()) == [(7, 2, "CC-BY-NC-4.0-notice"), (10, 100_001, "MIT-notice")]
    every = licenses.scan_all(df)
    assert sorted((r.doc_id or 0, r.n_notices, r.first_notice) for r in every.where("n_notices > 0").collect()) == [(0, 1, "GPL-3.0-notice"), (7, 1, "CC-BY-NC-4.0-notice"), (10, 1, "MIT-notice"), (11, 3, "ISC-notice"), (11, 3, "ISC-notice")]
    assert every.count() == len(rows) and licenses.scan_all(df.limit(0)).count() == 0 and licenses.scan(df.limit(0)).count() == 0
    own = spark.createDataFrame([("own", hashlib.sha256(b"my terms").hexdigest())], "license_id string, license_sha256 string")
    assert [r.license_id for r in licenses.scan(spark.createDataFrame([(1, "My  terms!")], "doc_id long, text string"), own).collect()] == ["own"]


def test_long_licences_by_digest(spark):
    path = "/usr/share/common-licenses/"
    if not os.path.exists(f"{path}GPL-3"):
        pytest.skip("no licence texts here")
    rows = [(i, open(path + n, encoding="utf-8").read()) for i, n in enumerate(("GPL-2", "GPL-3", "LGPL-2.1", "Apache-2.0", "MPL-2.0", "CC0-1.0"))]
    assert [r.license_id for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id").collect()] == ["GPL-2.0", "GPL-3.0", "LGPL-2.1", "Apache-2.0", "MPL-2.0", "CC0-1.0"]


def secrets_brute(text):
    out = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, f"assign:{m.start()}:{m.end()}"))
    out += [(m.start(), 1, f"access:{m.start()}:{m.end()}") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, f"hex:{m.start()}:{m.end()}") for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return ",".join(x for _, _, x in sorted(out))


def test_secrets(spark):
    rng = random.Random(4)
    key = lambda: "sk_" + "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(24))
    known = [f"say token = \"{key()}\" now" for i in range(200)] + [f"id AKIA{''.join(rng.choice('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') for _ in range(16))} é" for _ in range(60)] + [f"sum {hashlib.md5(str(i).encode()).hexdigest()}" for i in range(60)]
    new, short, rest = key(), hashlib.md5(b"x").hexdigest()[:20], key()
    odd = ["TOKEN: secret: abcdefgh", "api_key=ab", "é password='" + "x" * 3000, "AKIAAKIA", "AKIA" * 9, "deadbeef" * 3 + "g", "", None, "plain words only, and 2024-11-05T12:00:00", f"key {new} end", "ſecret=abcdefgh", f"and {short}.", f"{rest}+token=abcdef", "unwahrscheinlichkeiten 4111111111111111 https://example.org/a-long-path/with.words"]
    rows = list(enumerate(known + odd))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("secrets", F.lit("clash"))
    found = secrets.scan(df.union(df)).collect()
    got = {r.doc_id: r.secrets for r in found}
    assert len(found) == 2 * len(rows)
    for i, t in rows:
        spans = [{"kind": s.kind, "start": s.start, "stop": s.stop} for s in got[i]]
        assert secrets.digests(spans)[0] == hashlib.sha256(secrets_brute(t or "").encode()).hexdigest(), t
    added = {i: [t[s.start : s.stop] for s in got[i] if s.kind == "format"] for i, t in rows if t}
    assert [v for v in added.values() if v] == [[new], [short + "."], [rest + "+"]]
    clean = {r.doc_id: r.text for r in secrets.redact(df.drop("secrets")).collect()}
    n = len(known)
    assert clean[0] == "say [SECRET]\" now" and clean[n + 6] == "" and clean[n + 7] is None and clean[n + 8] == odd[8] and clean[n + 12] == "[SECRET][SECRET]"
    assert secrets.scan(df.limit(0)).count() == 0


def test_automata_merge_compatible_states():
    # Two tails of different make: states that are followed alike become one, others stay apart.
    rng = random.Random(6)
    values = [f"k{'x' if i % 2 else 'y'}-{rng.randrange(10**6):06}" for i in range(600)] + ["G" + "".join(itertools.takewhile(lambda _: rng.random() < 0.8, itertools.repeat("H"))) for _ in range(600)]
    a = secrets.Automaton.infer(values)
    words = Counter(v.translate(secrets._TO_CLASS) + secrets.STOP for v in values)
    end = lambda text: functools.reduce(lambda s, c: a.next[s][c][0], text, 0)
    assert end("gg-") != end("GG") and end("gg-00") != end("gg-000") and end("GGG") == end("GGGG")
    assert a.next[0]["g"][1] == sum(n for w, n in words.items() if w[0] == "g") and sum(n for _, n in a.next[0].values()) >= len(values)
    total = sum(n * w.count(c) for w, n in words.items() for c in {*w})
    assert sum(n for s in a.next for _, n in s.values()) == total  # merging moves counts and loses none
    long = "z1" * 5000
    b = secrets.Automaton.infer([long] * 3 + ["ab"] * 3)
    assert sum(n for s in b.next for _, n in s.values()) == 3 * 10_001 + 3 * 3


def test_automata_merge_states_and_prefer_their_own():
    rng = random.Random(6)
    values = [hashlib.sha1(str(i).encode()).hexdigest() for i in range(400)]
    a = secrets.Automaton.infer(values)
    assert len(a.next) < 60  # of some thousands of tree states
    assert a.evidence(hashlib.sha1(b"new").hexdigest()) > 20 > 0 > a.evidence("".join(rng.choice("ghijklmnop") for _ in range(40)))
    b = secrets.Automaton([{"0": (1, 6), "g": (0, 2)}, {"0": (1, 3), secrets.STOP: (-1, 5)}])
    want = math.log(2 / 8.5 / 20) + math.log(6 / 8.5 / 10) + math.log(3 / 8.5 / 10) + math.log(5 / 8.5) - sum(secrets.ordinary(x, y) for x, y in (("", "g"), ("g", "0"), ("0", "0"), ("0", secrets.STOP)))
    assert b.evidence("k07") == pytest.approx(want) and b.evidence("k0-7") == pytest.approx(math.log(2 / 8.5 / 20) + math.log(6 / 8.5 / 10) + math.log(0.5 / 8.5) - secrets.ordinary("", "g") - secrets.ordinary("g", "0"))


def test_ordinary_runs_are_those_of_the_corpus(spark):
    rng = random.Random(12)
    sha = lambda i: hashlib.sha1(str(i).encode()).hexdigest()
    texts = [prose(rng, 40) + f" token={sha(i)}, ünder a/b_c. 2024-11-05 {i:016}" for i in range(60)] + ["", None, "x", "=", "y" * 30_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    known = secrets.learn(df.repartition(5))
    want, runs = Counter(), 0
    for t in filter(None, texts):
        for s, _, e, _ in secrets.base_spans(t):
            t = t[:s] + " " * (e - s) + t[e:]
        for run in re.findall(r"[A-Za-z0-9+/_.=-]+", t):
            runs += 1
            word = "$" + run.translate(secrets._TO_CLASS) + "$"
            want.update(zip(word, word[1:]))
    total = Counter(a for a, b in want.elements())
    size = lambda c: len(secrets.CLASSES.get(c, "1"))
    for a in secrets.SYMBOLS:
        for b in secrets.SYMBOLS:
            assert known.ordinary(a, b) == pytest.approx(math.log((want[a, b] + size(b) / 69) / (total[a] + 1) / size(b))), (a, b)
        assert sum(math.exp(known.ordinary(a, b)) * size(b) for b in secrets.SYMBOLS) == pytest.approx(1)
    assert (known.ordinary.runs, known.labelled) == (runs, 120) and known.odds == pytest.approx(math.log(runs / 120))
    assert known.has(sha(1000)) and not known.has("0" * 16) and not known.has("y" * 30_000)
    # Where a key is none of the grammar's, the value alone is found; beside other parts of an address too.
    assert [s[:3] for s in secrets.find(f"see x.org/c/{sha(1001)}?a={sha(1002)[:23]} end", known)[1]] == [(55, "format", 78)]
    assert list(secrets.formatted(f"sig={sha(1003)} and x.org/{sha(1004)}/b", known)) == [(4, 44), (55, 95)]
    assert secrets.learn(df.limit(0)).automata == {} and secrets.find("a1b2c3d4e5f60718", secrets.learn(df.limit(0)))[1] == []


def test_formats_find_values_without_their_grammar(spark):
    rng = random.Random(13)
    sha = lambda i: hashlib.sha1(str(i).encode()).hexdigest()
    key = lambda: "AKIA" + "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16))
    rows = [(i, f"{prose(rng, 60)} {f'secret: {sha(i)}' if i % 2 else key()} {prose(rng, 5)}") for i in range(600)]
    df = spark.createDataFrame([*rows, (600, None), (601, ""), (None, "nobody")], "doc_id long, text string")
    held = [t for i, t in rows if zlib.crc32(str(i).encode()) % 2]
    n = {k: sum(x[1] == k for t in held for x in secrets.base_spans(t)) for k in secrets.KINDS}
    got = secrets.quality(df).first()
    assert (got.n_values, got.n_found) == (sum(n.values()), sum(n.values())) and got.n_added == got.n_right == n["hex"] + n["access"]
    alone = secrets.quality(df, without="access").first()  # nothing labelled is like these
    assert (alone.n_values, alone.n_found, alone.n_added) == (n["access"], 0, n["hex"])
    like = secrets.quality(df, without="hex").first()  # keys' values are
    assert (like.n_values, like.n_found) == (n["hex"], n["hex"])
    assert secrets.quality(df.limit(0)).first() == (0, 0, 0, 0)


def test_decontamination(spark, docs):
    rng = random.Random(8)
    items = [prose(rng, 30) for _ in range(6)] + ["short", "", None, "Tiny Item!"]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    edited = list(items[0])
    for k in range(6):
        edited[20 * k + 3] = "#"
    rows = [(0, "é lead " + items[0] + " tail"), (1, "".join(edited)), (2, items[1].upper().replace(" ", "\n-- ")), (3, items[2][: len(items[2]) // 2]), (4, "a short text"), (5, "shorter"), (6, None), (7, ""), (8, items[3] + " " + items[4] + " " + items[3]), (9, "x tiny, item y"), (10, prose(rng, 3000) + items[5] + prose(rng, 3000))]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("hits", F.lit("clash"))
    got = {r.doc_id: r.hits for r in decontaminate.find_items(df, bench).collect()}
    assert {i: {h.item_id for h in got[i]} for i in got} == {0: {0}, 1: {0}, 2: {1}, 3: set(), 4: {6}, 5: set(), 6: set(), 7: set(), 8: {3, 4}, 9: {9}, 10: {5}}
    h = got[0][0]
    assert rows[0][1].encode()[h.start : h.stop].decode() == items[0] and h.edits == 0 and got[1][0].edits in range(1, 7)
    assert sorted(r.doc_id for r in decontaminate.decontaminate(df, bench).collect()) == [3, 5, 6, 7]
    odd = df.withColumnsRenamed({"hits": "__before"}).withColumn("HITS", F.lit(1)).withColumn("__hits", F.lit(2))
    assert decontaminate.decontaminate(odd, bench).columns == odd.columns and {r.doc_id: len(r.found) for r in decontaminate.find_items(odd, bench, into="found").collect()} == {i: len(got[i]) for i in got}
    small = {r.doc_id: {h.item_id for h in r.hits} for r in decontaminate.find_items(df, bench, block_chars=100).collect()}
    assert small == {i: {h.item_id for h in got[i]} for i in got}
    assert decontaminate.find_items(docs.limit(0), bench).count() == 0 and decontaminate.decontaminate(docs, bench.limit(0)).count() == docs.count()


def test_decontamination_against_brute_force(spark):
    """Every document and item: found where a plain alignment of the normalised texts has few enough edits."""
    rng = random.Random(20)
    plain = lambda t: re.sub(rb"[^a-z0-9\x80-\xff]+", b" ", t.encode().translate(LOWER)).strip(b" ")
    items = [prose(rng, rng.randint(6, 25)) for _ in range(8)]
    rows = []
    for i in range(60):
        text = list(items[i % 8])
        for _ in range(rng.randint(0, 16)):
            at = rng.randrange(len(text))
            text[at : at + rng.randint(0, 1)] = rng.choice(["", "q", "zz", " "])
        rows.append((i, f"{prose(rng, 5)} {''.join(text)} {prose(rng, rng.randint(0, 40))}"))
    bench, df = spark.createDataFrame(list(enumerate(items)), "item_id long, text string"), spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, h.item_id): h.edits for r in decontaminate.find_items(df, bench).collect() for h in r.hits}
    want = {}
    for i, t in rows:
        for k, x in enumerate(items):
            item, text = plain(x), plain(t)
            row = np.zeros(len(text) + 1, dtype=int)
            for j, c in enumerate(item, 1):
                diagonal = np.minimum(row[:-1] + (np.frombuffer(text, np.uint8) != c), row[1:] + 1)
                steps = np.arange(len(text) + 1)
                row = np.minimum.accumulate(np.concatenate([[j], diagonal]) - steps) + steps
            if row.min() <= min(int(decontaminate.RATE * len(item)), max(0, (len(item) - decontaminate.Q) // decontaminate.Q)):
                want[i, k] = int(row.min())
    assert got == want and len(want) > 10 and len(set(want.values())) > 3


def test_banded_alignment_against_edit_distance():
    rng = random.Random(9)

    def best(item, text):
        row = [0] * (len(text) + 1)
        for i, a in enumerate(item, 1):
            new = [i]
            for j, b in enumerate(text, 1):
                new.append(min(row[j - 1] + (a != b), row[j] + 1, new[-1] + 1))
            row = new
        return min(row)

    long = bytes(rng.choice(b"abcdefgh ") for _ in range(20_000))
    began = time.process_time()
    assert decontaminate.align(long, b"xx" + long[:9000] + b"Q" + long[9001:] + b"yy", 1) == (1, 2, 20_002)
    assert time.process_time() - began < 0.5
    for _ in range(200):
        item = bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 25)))
        text = bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 40)))
        d, k = best(item, text), rng.randint(0, 6)
        got = decontaminate.align(item, text, k)
        assert (got is None) == (d > k) and (got is None or got[0] == d)
        if got:
            assert best(item, text[got[1] : got[2]]) == d


def test_token_counts(spark):
    tokenizers = pytest.importorskip("public_tokenizers")
    import sentencepiece

    path = tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(10)
    parts = ["a", " ", "  ", "\n", "\t", "\r\n", "é", "▁", "語", "the ", "</s>", "<s>", "😀", ".", "tion", ");\r", " ", "<0x0A>"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 60)))) for i in range(400)] + [(1000, None), (1001, ""), (1002, "word " * 20000), (1003, "x" * 70000 + " y" * 40000)]
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in tokencount.count_tokens(spark.createDataFrame(rows, "doc_id long, text string"), path).collect()}
    twice = spark.createDataFrame([("a", "x y"), ("a", "x y"), (None, "z")], "doc_id string, text string").withColumn("n_tokens", F.lit("clash"))
    assert sorted((r.doc_id or "", r.n_tokens) for r in tokencount.count_tokens(twice, path).collect()) == [("", 1), ("a", 2), ("a", 2)] and tokencount.count_tokens(twice.limit(0), path).count() == 0
    for i, t in rows:
        n = len(library.encode(t or ""))
        assert got[i] == (len((t or "").encode()), n, n > 4096), repr(t)[:80]


def test_chunk_maps_compose_in_any_cut():
    tokenizers = pytest.importorskip("public_tokenizers")
    import sentencepiece

    path = tokenizers.path("piece_bpe_32k.model")
    with open(path, "rb") as f:
        machine = tokencount.Transducer(f.read())
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(11)
    vocabulary = list(machine.rank)
    for k in range(1500):
        parts = ["ab", " ", "  ", "\n", "é", "the", "▁", ".", "語"] if k % 2 else vocabulary
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 30)))
        n = len(library.encode(text))
        assert machine.count(text) == machine.count(text, chunk=rng.randint(1, 9)) == n, text
        maps = [machine.chunk_map(x) for x in text]
        left = functools.reduce(machine.compose, maps)
        right = functools.reduce(lambda b, a: machine.compose(a, b), reversed(maps))
        assert left == right == machine.scan(maps), text


def test_transducer_begins_anew_when_full(monkeypatch):
    tokenizers = pytest.importorskip("public_tokenizers")
    with open(tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        model = f.read()
    text = prose(random.Random(21), 400)
    n = tokencount.Transducer(model).count(text)
    monkeypatch.setattr(tokencount, "STATES", 5)
    small = tokencount.Transducer(model)
    assert small.count(text) == n and len(small.states) <= 10
    with pytest.raises(ValueError):
        tokencount.read_model(b"")


def test_toxicity_held_out(spark):
    rng = random.Random(12)
    bad = ["grumkin", "snarlit", "vexo"]
    rows, labels = [], []
    for i in range(900):
        toxic = i % 4 == 0
        words = prose(rng, rng.randint(20, 80)).split()
        if toxic:
            for _ in range(rng.randint(2, 5)):
                words.insert(rng.randrange(len(words)), rng.choice(bad) if rng.random() < 0.6 else "quze" + rng.choice(["tu", "la", "mor", "nix"]))
        rows.append((i, " ".join(words), "en"))
        labels.append((i, int(toxic)))
    rows += [(5000, None, "en"), (5001, "", "en"), (5002, "x" * 200000, "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score(df, lab).collect()}
    held = [i for i in range(900) if zlib.crc32(str(i).encode()) % 4 == 2]
    wrong = sum((got[i].predicted == 1) != (i % 4 == 0) for i in held)
    assert len(held) > 150 and wrong <= 0.05 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values()) and got[5000].predicted == got[5001].predicted == 0
    kept = toxicity.keep_clean(df, lab)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if not r.predicted}
    assert toxicity.score(df.limit(0), lab).count() == 0 and toxicity.score(df, lab.limit(0)).count() == len(rows)


def test_boosted_trees_against_exhaustive_search():
    """Each tree's splits are the best of all, by trying every one; the margins add up to the same."""
    rng = np.random.default_rng(3)
    x = rng.integers(0, 6, size=(120, 3)).astype(float)
    y = ((x[:, 0] > 2) ^ (x[:, 1] > 3)).astype(float)
    y[:10] = 1 - y[:10]
    model = toxicity.Trees(rounds=5, depth=2, least=4).fit(x, y)
    margin = np.full(len(y), math.log(y.mean() / (1 - y.mean())))

    def grow(rows, depth, g, h):
        leaf = lambda: {tuple(rows): model.rate * g[rows].sum() / (h[rows].sum() + model.ridge)}
        if depth == model.depth:
            return leaf()
        score = lambda k: g[k].sum() ** 2 / (h[k].sum() + model.ridge)
        best = (1e-3, None)
        for f in range(x.shape[1]):
            for c in sorted({*np.quantile(x[:, f], np.linspace(0, 1, model.bins)[1:-1]), 0.0}):
                left, right = rows[x[rows, f] <= c], rows[x[rows, f] > c]
                if len(left) >= model.least and len(right) >= model.least and (gain := score(left) + score(right) - score(rows)) > best[0]:
                    best = (gain, (left, right))
        return leaf() if best[1] is None else grow(best[1][0], depth + 1, g, h) | grow(best[1][1], depth + 1, g, h)

    for feature, cut, value in model.trees:
        p = 1 / (1 + np.exp(-margin))
        want = grow(np.arange(len(y)), 0, y - p, np.maximum(p * (1 - p), 1e-6))
        got = toxicity.Trees._apply(x, feature, cut, value)
        for rows, v in want.items():
            assert got[list(rows)] == pytest.approx(v)
        margin += got
    assert model.margin(x) == pytest.approx(margin) and ((margin > 0) == y).mean() > 0.6


def test_calibration_is_the_isotonic_regression():
    """Pools are the least-squares fit: at each place the max over starts of the min over ends of means."""
    rng = np.random.default_rng(4)
    s = np.sort(rng.normal(size=40))
    y = (rng.random(40) < 1 / (1 + np.exp(-2 * s))).astype(float)
    fit = [max(min(y[a : b + 1].mean() for b in range(i, 40)) for a in range(i + 1)) for i in range(40)]
    model = toxicity.Isotonic(s, y)
    assert sorted(set(np.round(fit, 9))) == list(np.round(model.y, 9))
    assert np.all(np.diff(model(np.linspace(-4, 4, 200))) > 0) and len(toxicity.Isotonic(s[:0], y[:0])(s)) == 40


def test_features_against_plain_counts():
    lexicon = toxicity.Lexicon({"vexo": 2.0, "^quze": 1.5, "vile": 3.0})
    text = "You VEXO, quzemor! hello v1le THE 12 end you"
    f = dict(zip(toxicity.FEATURES, toxicity.features(text, lexicon), strict=True))
    n, size = 9, len(text)
    assert f["lexicon_density"] == pytest.approx(2 / n) and f["lexicon_peak"] == 2 and f["lexicon_log_hits"] == pytest.approx(math.log(2)) and f["stem_density"] == pytest.approx(1.5 / n)
    assert f["second_person"] == pytest.approx(2 / n) and f["near_second"] == pytest.approx(2 / n) and f["capital_rate"] == pytest.approx(8 / size) and f["shouted_rate"] == pytest.approx(2 / n)
    assert f["digit_rate"] == pytest.approx(3 / size) and f["strong_mark_rate"] == pytest.approx(1 / size) and f["obfuscated_rate"] == pytest.approx(1 / n) and f["obfuscated_hits"] == 1
    assert f["kinds"] == pytest.approx(math.log(3)) and toxicity.features(None, lexicon) == toxicity.features("", lexicon)


def test_toxicity_of_repeated_rows_and_ties(spark):
    rows = [(i, "bad bad word" if i % 2 else "good nice word") for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("third", F.lit("clash")).withColumn("predicted", F.lit("clash"))
    lab = spark.createDataFrame([(i, i % 2) for i in range(80)] + [(1, 0), (None, 1)], "doc_id long, toxic int")
    got = toxicity.score(df.union(df), lab).collect()
    assert len(got) == 160 and len({(r.text, r.score) for r in got}) == 2


def water_fill(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: 1.0 + k % 3 for k, s in enumerate(names)}
    target, open_ = dict.fromkeys(names, 0.0), set(names)
    left = float(sum(sizes.values()))
    while open_ and left > 1e-9:
        total = sum(weight[s] for s in open_)
        share = {s: left * weight[s] / total for s in open_}
        left = 0.0
        for s in list(open_):
            target[s] += share[s]
            if target[s] >= 3 * sizes[s]:
                left += target[s] - 3 * sizes[s]
                target[s] = 3.0 * sizes[s]
                open_.discard(s)
    return target


def test_mixing(spark, docs, texts):
    rows = docs.collect()
    sizes = Counter()
    for r in rows:
        sizes[r.source] += len(tokens(r.text))
    want = water_fill(sizes)
    out = mixing.mix(docs).collect()
    assert len(out) == len(rows) and mixing.mix(docs).exceptAll(spark.createDataFrame(out, mixing.mix(docs).schema)).count() == 0
    taken = Counter()
    for r in out:
        assert r.size == len(tokens(texts[r.doc_id])) and r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source]) and 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 1 + min(want[s], sizes[s]) / 256
    assert mixing.mix(empty(spark)).count() == 0
    skewed = spark.createDataFrame([(0, "a b c", "x"), (1, prose(random.Random(1), 5000), "y"), (2, None, "z"), (2, None, "z"), (3, "q " * 40, "w"), (4, "one", "v"), (4, "two", "v")], "doc_id long, text string, source string").withColumn("copy", F.lit("clash")).withColumn("TAKEN", F.lit(7))
    got = {r.source: r for r in mixing.mix(skewed).collect()}
    assert got["x"].target == 9 == got["x"].taken and got["z"].target == 0 and got["v"].taken == 3 and mixing.mix(skewed).count() == 7
    whole = mixing.mixed(skewed.drop("TAKEN"))
    assert whole.columns == [*skewed.columns[:-1], "taken"] and sorted((r.doc_id, r.text[:3], r.taken) for r in whole.where("source <> 'y' and source <> 'w'").collect()) == [(0, "a b", 9), (4, "one", 3), (4, "two", 3)]


def test_schedule_and_blocks_against_brute_force(spark):
    """Slots by the golden ratio one at a time, blocks word by word."""
    rng = random.Random(22)
    rows = [(i, " ".join(["w"] * rng.choice([1, 2, 7, 40, 900])), rng.choice(["a", "b", "b", "c", None])) for i in range(150)] + [(900, "x " * 5, "tiny"), (901, None, "a"), (3, "again", "a"), (3, "again", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(tokens(t))
    want, block = water_fill(sizes), mixing.block_words(sum(sizes.values()))
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None]
    words = {s: max(1, min(block, int(min(want[s], sizes[s]) / mixing.SHARES))) for s in names}
    blocks = {s: -(-sizes[s] // words[s]) for s in names}
    slots = {s: min(3 * blocks[s], int(want[s] / sizes[s]) * blocks[s] + min(blocks[s], int((want[s] - int(want[s] / sizes[s]) * sizes[s]) / words[s] + 0.5))) for s in names}
    total, edges = sum(slots.values()), {}
    upto = 0
    for s in names:
        edges[s] = (math.floor(upto / total * mixing.RING), math.floor((upto + slots[s]) / total * mixing.RING))
        upto += slots[s]
    times, ranks = defaultdict(Counter), Counter()
    for k in range(total):
        point = k % mixing.RING * mixing.STEP % mixing.RING
        s = next(s for s in names if edges[s][0] <= point < edges[s][1])
        if ranks[s] < slots[s]:
            times[s][ranks[s] % blocks[s]] += 1
        ranks[s] += 1
    for s in names:
        for r in range(ranks[s], slots[s]):
            times[s][r % blocks[s]] += 1
    seen, out = Counter(), []
    for i, t, s in rows:
        n = len(tokens(t))
        seen[i, s, n] += 1
        out.append((s, hashlib.md5(f"0:{i}:{n}:{seen[i, s, n]}".encode()).hexdigest(), i, n))
    taken, at = Counter(), Counter()
    for s, _, i, n in sorted(out, key=lambda x: (str(x[0]), x[1])):
        taken[i, s] += sum(times[s][(at[s] + k) // words[s]] for k in range(n))
        at[s] += n
    got = Counter()
    for r in mixing.mix(df).collect():
        got[r.doc_id, r.source] += r.taken
    assert got == taken and got[900, "tiny"] == 15


def test_targets_against_repeated_sharing(spark):
    rng = random.Random(13)
    for _ in range(5):
        sizes = {f"s{k}": rng.choice([0, 1, 5, 50, 1000, 10**6]) for k in range(rng.randint(1, 9))} | {None: rng.randint(0, 99)}
        got = mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
        want = water_fill(sizes)
        assert {r.source: round(r.target, 6) for r in got} == {k: round(v, 6) for k, v in want.items()}


def test_escapes_read_back():
    rng = random.Random(14)
    parts = [*chat.CONTROL, "\\", "<", "|", "[", "s>", "/s>", "x", "\n", "<\\", "[\\INST]"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 8)))
        safe = chat.escape(text)
        assert chat.unescape(safe) == text and not any(c in safe for c in chat.CONTROL)
        turns = [(rng.choice(["user", "assistant", text]), text) for _ in range(3)]
        whole, mask = chat.format_turns(turns)
        assert chat.read_turns(whole) == turns
        assert [chat.unescape(whole[a:b]) for a, b in mask] == [t for r, t in turns if r == "assistant"]


def test_reply_trees(spark):
    #      1 -> 2 -> 4 (0.9)      10 -> 11 (ties with 12)     20 <-> 21 a ring     30 replies to a missing message
    rows = [("a", 1, None, "user", "q", 0.5), ("a", 2, 1, "assistant", "r", 0.1), ("a", 4, 2, "user", "s", 0.9), ("a", 3, 1, "assistant", "t", 0.2), ("b", 10, None, "user", None, 0.0), ("b", 11, 10, None, "x", None), ("b", 12, 10, "assistant", "y", 0.0), ("c", 20, 21, "user", "z", 1.0), ("c", 21, 20, "user", "z", 1.0), ("d", 30, 99, "user", "w", 1.0)]
    df = spark.createDataFrame(rows, "tree string, id long, parent long, role string, text string, score double")
    got = {r.tree: chat.read_turns(r.text) for r in chat.format_conversations(df).collect()}
    assert got == {"a": [("user", "q"), ("assistant", "r"), ("user", "s")], "b": [("user", ""), ("", "x")], "d": [("user", "w")]}
    both = [(r.tree, r.path) for r in chat.format_conversations(df, top=2).orderBy("tree", "path").collect()]
    assert both == [("a", 3), ("a", 4), ("b", 11), ("b", 12), ("d", 30)]
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_long_chain_with_ties(spark):
    rows = [(7, t, "user" if t % 2 else "assistant", f"t{t}") for t in range(150)] + [(7, 3, "assistant", "t3"), (None, None, None, None)]
    got = {r.tree: chat.read_turns(r.text) for r in chat.format_conversations(chat.chain(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    assert got[7] == [(r, x) for _, _, r, x in sorted(rows[:-1], key=lambda x: x[1:])] and got[None] == [("", "")]


def test_language_model(spark, docs, texts):
    got = {r.doc_id: r for r in lm.score(docs).collect()}
    counts = Counter()
    for i, t in texts.items():
        if zlib.crc32(str(i).encode()) % 7 != 2:
            counts.update([*tokens(t), None])
    n, v = sum(counts.values()), len(counts)
    for i, t in texts.items():
        own = [*tokens(t), None]
        assert got[i].n_tokens == len(own) and got[i].n_known == sum(counts[w] > 0 for w in own) and got[i].train_tokens == n
        assert got[i].base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own))
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 7 == 2) and math.isfinite(got[i].score) and got[i].score < 0
    assert lm.score(docs.union(docs)).count() == 2 * len(texts) and lm.score(empty(spark)).count() == 0


def ppm_brute(training):
    """log10 probability of a run of bytes under PPM with escape method D and exclusion, straight from its definition."""
    after = defaultdict(Counter)
    for run in training:
        for k in range(lm.ORDER, len(run)):
            for order in range(lm.ORDER + 1):
                after[run[k - order : k]][run[k]] += 1

    def symbol(context, x):
        out, gone = 0.0, set()
        for order in range(len(context), -1, -1):
            full = after.get(context[len(context) - order :])
            if not full:
                continue
            here = {s: c for s, c in full.items() if s not in gone}
            total = sum(here.values())
            if x in here:
                return out + math.log10((2 * here[x] - 1) / (2 * total))
            if total:
                out += math.log10(len(here) / (2 * total))
            gone = set(full)
        return out + math.log10(1 / (256 - len(gone)))

    return lambda run: sum(symbol(run[k - lm.ORDER : k], run[k]) for k in range(lm.ORDER, len(run)))


def test_scores_against_brute_force_ppm(spark, docs, texts):
    run = lambda t: b" " * lm.ORDER + b"".join(w + b" " for w in tokens(t)) + b"\n"
    brute = ppm_brute([run(t) for i, t in texts.items() if zlib.crc32(str(i).encode()) % 7 != 2])
    for r in lm.score(docs.withColumn("train", F.lit("clash")).withColumn("key", F.lit(0))).collect():
        assert r.score == pytest.approx(brute(run(texts[r.doc_id]))), r.doc_id


def test_scores_keep_ids_of_any_type(spark):
    got = lm.score(spark.createDataFrame([("a", "x y"), ("a", "x y"), (None, "long " * 50_000), ("b", None)], "doc_id string, text string"))
    assert sorted((r.doc_id or "", r.n_tokens) for r in got.collect()) == [("", 50_001), ("a", 3), ("a", 3), ("b", 1)]


def test_contexts_cross_words(spark):
    rng = random.Random(19)
    pairs = [(f"{a}o", f"{b}u") for a, b in zip("bcdfg", "lmnpq", strict=True)]
    plain = {i: " ".join(f"{a} {b}" for a, b in (rng.choice(pairs) for _ in range(20))) for i in range(60)}
    plain |= {100: plain[0].upper().replace(" ", " \n"), 101: " ".join(sorted(plain[0].split())), 102: "", 103: None}
    got = {r.doc_id: r for r in lm.score(spark.createDataFrame(list(plain.items()), "doc_id long, text string").repartitionByRange(8, "doc_id")).collect()}

    def grams(text):
        run = b" " * lm.ORDER + b"".join(w.encode() + b" " for w in tokens_of(text)) + b"\n"
        assert lm.running(pa.array([text]))[0].tobytes() == run
        return [int.from_bytes(run[k : k + lm.ORDER + 1], "big") for k in range(len(run) - lm.ORDER)]

    def tokens_of(text):
        return (text or "").lower().split()

    counts = Counter(g for i, t in plain.items() if not got[i].held_out for g in grams(t))
    trie = lm.Trie(lm._levels(*lm._merge(np.array(list(counts), dtype=np.uint64), np.array(list(counts.values()))), lm.ORDER, 0), lm.ORDER)
    for i, t in plain.items():
        assert got[i].score == pytest.approx(trie.log10(np.array(grams(t), dtype=np.uint64)).sum())
    assert got[100].score == pytest.approx(got[0].score) and got[101].score < 1.5 * got[0].score


def test_scores_by_partition_are_those_of_a_whole_trie_of_over_4_m_nodes(spark):
    every = lambda col: np.concatenate([p >> np.uint64(16) for p in lm.packed_grams(pa.array(col))])
    rng = random.Random(18)
    col = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789+/-_", k=100_000)) for _ in range(52)]
    col = [" ".join(t[k : k + 500] for k in range(0, len(t), 500)) for t in col] + ["", None, "a b", col[0][:50]]
    df = spark.createDataFrame(list(enumerate(col)), "doc_id long, text string").repartitionByRange(8, "doc_id")
    got = {r.doc_id: r for r in lm.score(df).collect()}
    train = [t or "" for i, t in enumerate(col) if not got[i].held_out]
    keys, counts = np.unique(every(train), return_counts=True)
    assert len(keys) > 4_000_000
    trie = lm.Trie(lm._levels(keys, counts, lm.ORDER, 0), lm.ORDER)
    for i in range(45, len(col)):
        assert got[i].score == pytest.approx(trie.log10(every([col[i] or ""])).sum())


def test_trie_probabilities_sum_to_one():
    rng = random.Random(15)
    grams = Counter()
    for _ in range(200):
        w = b" " * lm.ORDER + bytes(rng.choice(b"abcd") for _ in range(rng.randint(1, 6))) + b" "
        for k in range(len(w) - lm.ORDER):
            grams[int.from_bytes(w[k : k + lm.ORDER + 1], "big")] += 1
    levels = []
    for k in range(lm.ORDER + 1):
        c = Counter()
        for g, n in grams.items():
            c[g & ((1 << 8 * (k + 1)) - 1)] += n
        levels.append((np.array(list(c), dtype=np.uint64), np.array(list(c.values()))))
    trie = lm.Trie(levels, lm.ORDER)
    for ctx in [b"     ", b"  abc", b"zzzzz", b"abcda", b"  zab"]:
        base = int.from_bytes(ctx, "big") << 8
        p = 10 ** trie.log10(np.array([base | s for s in range(256)], dtype=np.uint64))
        assert p.sum() == pytest.approx(1.0)


def test_words_in_any_chunk(monkeypatch):
    from spanveil.llm import words

    rng = random.Random(16)
    col = ["".join(rng.choice(["ab", "É", " ", "\n", "X", "y" * 30]) for _ in range(rng.randint(0, 20))) for _ in range(60)] + [None, ""]
    whole = words.split_words(pa.array(col))
    spelled = [bytes(words.lowered(whole.raw)[a:b]) for a, b in zip(whole.start, whole.stop, strict=True)]
    assert [(d, w) for d, w in zip(whole.doc, spelled, strict=True)] == [(i, w) for i, t in enumerate(col) for w in tokens(t)]
    for size in (1, 7, 50):
        monkeypatch.setattr(words, "CHUNK", size)
        cut = words.split_words(pa.array(col))
        assert (cut.code == whole.code).all() and (cut.start == whole.start).all() and (cut.doc == whole.doc).all()
    by = defaultdict(set)
    for w, c in zip(spelled, whole.code.tolist(), strict=True):
        by[w].add(c)
    assert all(len(v) == 1 for v in by.values()) and len({next(iter(v)) for v in by.values()}) == len(by)
