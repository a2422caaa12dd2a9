"""Secret scan: a base grammar of known forms, and stochastic automata inferred from the credentials it labels.

For each kind of credential a prefix tree of its values, over classes of characters, is folded into a probabilistic
automaton by merging states whose outgoing frequencies, and those of all states that follow on common symbols, agree
within a Hoeffding bound, from the root outwards. Every other run of credential characters in a text is a candidate: its
likelihood under the best automaton, against that of ordinary runs, decides whether it has the format of a credential.
From where a value leaves the automaton, it is as likely as ordinary text. Ordinary runs are a chain of classes of
characters, counted over all runs of all documents; how many of them there are for each labelled value is what the
evidence must outweigh.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator, Mapping
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanveil.llm.runtime import materialize, trimmed
from spanveil.llm.words import pieces

KINDS = ("assign", "access", "hex", "format")
SAMPLE = 1500  # distinct labelled values a kind that an automaton learns from, those with the least hashes
LEAST = 6  # characters of a candidate, as of a value behind a key
MARGIN = 12.0  # nats by which a candidate must be likelier as a credential, at least
OVER = 3.0  # and nats above the odds of ordinary runs to labelled values
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}+")
_RUN = re.compile(r"[A-Za-z0-9+/_.=-]{%d,}+" % LEAST)
_PART = re.compile(r"[^=/]{%d,}+" % LEAST)
#: Classes of characters and how many characters each holds; other symbols are classes of their own.
CLASSES = {"0": "0123456789", "a": "abcdef", "g": "ghijklmnopqrstuvwxyz", "A": "ABCDEF", "G": "GHIJKLMNOPQRSTUVWXYZ"}
_CLASS = {c: k for k, v in CLASSES.items() for c in v}
_SIZE = {k: len(v) for k, v in CLASSES.items()}
_TO_CLASS = str.maketrans(_CLASS)
STOP = "$"
SYMBOLS = STOP + "0agAG+/_.=-"  # the end, or the start, of a run and the classes
_CODE = bytes(SYMBOLS.find(_CLASS.get(chr(b), chr(b))) if re.match(r"[A-Za-z0-9+/_.=-]", chr(b)) else 0 for b in range(256))
KNOWN = 1 << 18  # runs that a task remembers the decision of


def base_spans(text: str) -> list[tuple[int, str, int, str]]:
    """(start, kind, stop, value) of the known forms, in code points."""
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), "assign", m.end(), m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), "access", m.end(), m[0]) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [(m.start(), "hex", m.end(), m[0]) for m in _HEX.finditer(text)]
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[1])))


def candidates(text: str, base: list[tuple[int, str, int, str]] = ()) -> Iterator[tuple[int, int]]:
    """Runs of credential characters; of a run that base spans cover in part, what they leave if it is long enough."""
    for m in _RUN.finditer(text):
        at, stop = m.span()
        for s, _, e, _ in base:
            if s >= stop:
                break
            if e > at:
                if s - at >= LEAST:
                    yield at, s
                at = max(at, e)
        if stop - at >= LEAST:
            yield at, stop


class Ordinary:
    """Ordinary runs: how often a class of characters follows another, STOP being the start and the end of a run.

    Characters of a class are equal among themselves. A class that never followed has its share of one count by the number of its
    characters, so that without counts all characters and the end are equally likely.
    """

    def __init__(self, counts: Mapping[tuple[str, str], int] | None = None):
        counts = counts or {}
        self.runs = sum(n for (a, b), n in counts.items() if a == STOP)
        total = {a: sum(counts.get((a, b), 0) for b in SYMBOLS) + 1 for a in SYMBOLS}
        share = {b: _SIZE.get(b, 1) / sum(_SIZE.get(x, 1) for x in SYMBOLS) for b in SYMBOLS}
        self._log = {(a, b): math.log((counts.get((a, b), 0) + share[b]) / total[a] / _SIZE.get(b, 1)) for a in SYMBOLS for b in SYMBOLS}

    def __call__(self, before: str, c: str) -> float:
        """Log likelihood of a character of class c behind one of another class ("" at the start)."""
        return self._log[before or STOP, c]


ordinary = Ordinary()


def followers(texts: Iterable[str]) -> np.ndarray:
    """How often each symbol follows each in the runs of texts outside base spans, as len(SYMBOLS) squared counts."""
    rest = []
    for t in texts:
        for s, _, e, _ in base_spans(t):
            t = t[:s] + " " * (e - s) + t[e:]
        rest.append(t)
    codes = np.frombuffer(("\n" + "\n".join(rest) + "\n").encode("ascii", "replace").translate(_CODE), np.uint8)
    out = np.bincount(codes[:-1] * np.uint8(len(SYMBOLS)) + codes[1:], minlength=len(SYMBOLS) ** 2)
    out[0] = 0  # between runs
    return out


@dataclass
class Automaton:
    """States with counts; count[s] is how often s was passed, next[s][symbol] = (state, count), STOP leads nowhere."""

    next: list[dict[str, tuple[int, int]]] = field(default_factory=list)

    @classmethod
    def infer(cls, values: Iterable[str], alpha: float = 0.05) -> Automaton:
        """Prefix tree of the values' classes, then merging of compatible states."""
        tree: list[dict[str, list[int]]] = [{}]
        for v in sorted(values):
            s = 0
            for c in [*v.translate(_TO_CLASS), STOP]:
                step = tree[s].setdefault(c, [-1, 0])
                step[1] += 1
                if c != STOP:
                    if step[0] < 0:
                        tree.append({})
                        step[0] = len(tree) - 1
                    s = step[0]
        bound_c = math.sqrt(0.5 * math.log(2 / alpha))
        total = lambda s: sum(n for _, n in tree[s].values())

        def alike(a: int, b: int) -> bool:
            todo = [(a, b)]  # what follows b is a tree, so this ends
            while todo:
                a, b = todo.pop()
                na, nb = total(a), total(b)
                if not na or not nb:
                    continue
                limit = bound_c * (1 / math.sqrt(na) + 1 / math.sqrt(nb))
                if any(abs(tree[a].get(c, (0, 0))[1] / na - tree[b].get(c, (0, 0))[1] / nb) > limit for c in tree[a].keys() | tree[b].keys()):
                    return False
                todo += [(tree[a][c][0], tree[b][c][0]) for c in tree[a].keys() & tree[b].keys() if c != STOP]
            return True

        def fold(a: int, b: int) -> None:
            """Add what follows b, still a tree, to a."""
            todo = [(a, b)]
            while todo:
                a, b = todo.pop()
                for c, (t, n) in tree[b].items():
                    if c not in tree[a]:
                        tree[a][c] = [t, n]
                    else:
                        tree[a][c][1] += n
                        if c != STOP and tree[a][c][0] != t:
                            todo.append((tree[a][c][0], t))

        red, kept = [0], {0}
        while True:
            blue = [(s, c) for s in red for c, (t, _) in tree[s].items() if c != STOP and t not in kept]
            if not blue:
                break
            s, c = max(blue, key=lambda x: (tree[x[0]][x[1]][1], -x[0], x[1]))
            b = tree[s][c][0]
            for r in red:
                if alike(r, b):
                    tree[s][c][0] = r
                    fold(r, b)
                    break
            else:
                red.append(b)
                kept.add(b)
        number = {s: i for i, s in enumerate(red)}
        return cls([{c: (number.get(t, -1), n) for c, (t, n) in tree[s].items()} for s in red])

    def evidence(self, value: str, ordinary: Ordinary = ordinary) -> float:
        """Log likelihood of the value and its end, over that as an ordinary run. A class's characters are equal among themselves.

        At each state half a count stands for symbols that learning never saw there; behind one, nothing more is known.
        """
        s, out, before = 0, 0.0, ""
        for c in [*value.translate(_TO_CLASS), STOP]:
            arcs = self.next[s]
            total = sum(n for _, n in arcs.values()) + 0.5
            if c not in arcs:
                return out + math.log(0.5 / total)
            s, n = arcs[c]
            out += math.log(n / total / _SIZE.get(c, 1)) - ordinary(before, c)
            before = c
        return out


@dataclass
class Formats:
    """What a corpus teaches: an automaton a kind, ordinary runs, and how many labelled values there are."""

    automata: dict[str, Automaton] = field(default_factory=dict)
    ordinary: Ordinary = ordinary
    labelled: int = 0
    _known: dict[str, bool] = field(default_factory=dict, repr=False, compare=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_known": {}}

    @property
    def odds(self) -> float:
        """Log of the ordinary runs to each labelled value."""
        return math.log(max(self.ordinary.runs, 1) / max(self.labelled, 1))

    def evidence(self, value: str) -> float:
        """That of the best automaton."""
        return max((a.evidence(value, self.ordinary) for a in self.automata.values()), default=-math.inf)

    def has(self, value: str, margin: float = MARGIN) -> bool:
        """Whether the value has the format of a credential, by the margin, and by OVER above the odds."""
        if (got := self._known.get(value)) is None:
            if len(self._known) >= KNOWN:
                self._known.clear()
            got = self._known[value] = self.evidence(value) >= max(margin, self.odds + OVER)
        return got


def learn(docs: DataFrame, sample: int = SAMPLE, kinds: Iterable[str] = KINDS[:3]) -> Formats:
    """Automata of the kinds, from whole values that the base grammar finds in all of docs: distinct ones, `sample` a kind at
    most. Ordinary runs are counted over all other runs of docs in the same scan. Null and empty texts teach nothing."""

    @trimmed
    def values(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = np.zeros(len(SYMBOLS) ** 2, np.int64)
        for batch in pieces(batches, most=16 << 20, rows=1 << 16):
            texts = [t for t in batch.column("text").to_pylist() if t]
            pairs += followers(texts)
            got = sorted(Counter((k, v) for t in texts for _, k, _, v in base_spans(t)).items())
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x, _ in got], pa.string()), pa.array([x[1] for x, _ in got], pa.string()), pa.array([n for _, n in got], pa.int64())], names=["kind", "value", "n"])
        seen = [i for i, n in enumerate(pairs) if n]
        yield pa.RecordBatch.from_arrays([pa.array(["run"] * len(seen), pa.string()), pa.array([SYMBOLS[i // len(SYMBOLS)] + SYMBOLS[i % len(SYMBOLS)] for i in seen], pa.string()), pa.array(pairs[seen], pa.int64())], names=["kind", "value", "n"])

    found = materialize(docs.select("text").mapInArrow(values, "kind string, value string, n long").groupBy("kind", "value").agg(F.sum("n").alias("n")).withColumn("h", F.xxhash64("value")))
    pairs = {tuple(r.value): r.n for r in found.where("kind = 'run'").collect()}  # no more than pairs of symbols
    kinds = [k for k in KINDS[:3] if k in {*kinds}]
    labelled = found.where(F.col("kind").isin(kinds)).agg(F.sum("n")).first()[0] or 0
    by_kind = {k: [r.value for r in found.where(F.col("kind") == k).orderBy("h", "value").limit(sample).collect()] for k in kinds}
    return Formats({k: Automaton.infer(v) for k, v in by_kind.items() if len(v) >= 8}, Ordinary(pairs), labelled)


def formatted(text: str, formats: Formats, base: list[tuple[int, str, int, str]] = (), margin: float = MARGIN) -> Iterator[tuple[int, int]]:
    """Candidates that have a credential's format; of one that has it not as a whole, the parts between = and / that do."""
    for at, stop in candidates(text, base) if formats.automata else ():
        value = text[at:stop]
        if formats.has(value, margin):
            yield at, stop
        elif "=" in value or "/" in value:
            yield from ((at + m.start(), at + m.end()) for m in _PART.finditer(value) if m.end() - m.start() < len(value) and formats.has(m[0], margin))


def find(text: str, formats: Formats, margin: float = MARGIN) -> tuple[list[tuple[int, str, int, str]], list[tuple[int, str, int, str]]]:
    """Base spans, and spans that the automata add; those don't overlap base spans."""
    base = base_spans(text)
    return base, [(s, "format", e, text[s:e]) for s, e in formatted(text, formats, base, margin)]


def joined(spans: Iterable[tuple[int, str, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, k, e, _ in sorted(spans, key=lambda x: (x[0], KINDS.index(x[1]))))


SPANS = "secrets array<struct<kind: string, start: int, stop: int>>"
_SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32())]))


def scan(docs: DataFrame, formats: Formats | None = None, margin: float = MARGIN) -> DataFrame:
    """All columns of docs with secrets: spans in code points, by start, then kind.

    Null and empty texts have none. Repeated rows repeat. A column of docs named secrets is replaced.
    """
    docs = docs.drop("secrets")
    known = learn(docs) if formats is None else formats

    @trimmed
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, rows=1 << 14):
            out = []
            for t in batch.column("text").to_pylist():
                base, added = find(t or "", known, margin)
                out.append([{"kind": k, "start": s, "stop": e} for s, k, e, _ in sorted(base + added, key=lambda x: (x[0], KINDS.index(x[1])))])
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in batch.schema.names], pa.array(out, _SPAN_TYPE)], names=[*batch.schema.names, "secrets"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{schema}, {SPANS}")


def mask(text: str, spans: list[tuple[int, int]], sign: str = "[SECRET]") -> str:
    """text with every span, or run of overlapping spans, replaced."""
    out, at = [], 0
    for s, e in sorted(spans):
        if s >= at:
            out += [text[at:s], sign]
        at = max(at, e)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, formats: Formats | None = None, sign: str = "[SECRET]") -> DataFrame:
    """docs with the secrets in text replaced, all other columns as they are."""
    known = learn(docs) if formats is None else formats

    @trimmed
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, rows=1 << 14):
            out = []
            for t in batch.column("text").to_pylist():
                spans = [(s, e) for found in find(t, known) for s, _, e, _ in found] if t else []
                out.append(mask(t, spans, sign) if spans else t)
            yield batch.set_column(batch.schema.names.index("text"), "text", pa.array(out, batch.schema.field("text").type))

    return docs.mapInArrow(run, docs.schema)


def quality(docs: DataFrame, without: str | None = None, margin: float = MARGIN) -> DataFrame:
    """How well formats alone find what the base grammar knows: one row of n_values, n_found, n_added, n_right (long).

    One half of docs, by doc_id, teaches; the kind `without` is left out there. In the other half no grammar is used: every run
    is a candidate. n_values are the values of the grammar there (only those of `without`, where that is given), n_found those
    that an added span lies over; n_added the added spans, n_right those over a value of any kind. Recall is
    n_found / n_values, precision n_right / n_added. Rows of null doc_id teach.
    """
    half = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 2, F.lit(0))
    known = learn(docs.where(half == 0), kinds=[k for k in KINDS[:3] if k != without])

    @trimmed
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, rows=1 << 14):
            sums = [0, 0, 0, 0]
            for t in filter(None, batch.column("text").to_pylist()):
                truth = [(e - len(v), e, k) for _, k, e, v in base_spans(t)]
                added = [*formatted(t, known, margin=margin)]
                over = lambda x, those: any(x[0] < y[1] and y[0] < x[1] for y in those)
                asked = [x for x in truth if without in (None, x[2])] if truth else []
                for i, n in enumerate((len(asked), sum(over(x, added) for x in asked), len(added), sum(over(x, truth) for x in added))):
                    sums[i] += n
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()) for n in sums], names=names)

    names = ["n_values", "n_found", "n_added", "n_right"]
    rows = docs.where(half == 1).select("text").mapInArrow(run, ", ".join(f"{n} long" for n in names))
    return rows.agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names])


def digests(spans) -> tuple[str, str]:
    """SHA-256 of the base spans' list, and the list of all spans, from rows of kind, start and stop."""
    rows = [(x["start"], x["kind"], x["stop"], "") for x in spans]
    return hashlib.sha256(joined(x for x in rows if x[1] != "format").encode()).hexdigest(), joined(rows)
