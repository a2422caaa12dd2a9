"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

Labelled rows of the training folds are split by a hash: on a third the lexicon is learnt (words and word beginnings
with their log odds), on a third the trees, on a third the calibration; so no feature has seen its own label. Learning
takes at most `sample` labelled rows, those with the least hashes, and writes their texts once; scoring covers every row
and whole texts. The lexicon holds all units that qualify: its size is bounded by the sample's texts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanveil.llm.runtime import in_fold, materialize, trimmed
from spanveil.llm.words import pieces

SAMPLE = 18_000
THRESHOLD = 0.3
# Second-person words of the languages at hand.
SECOND = frozenset("you your yours yourself u ur du dich dir dein deine deiner euch ihr sie ihnen tu te toi ton ta tes vous votre vos tú ti tuyo usted ustedes vosotros vuestro".split())
FEATURES = ("lexicon_density", "lexicon_mean", "lexicon_peak", "lexicon_log_hits", "stem_density", "stem_log_hits", "second_person", "near_second", "capital_rate", "shouted_rate", "mark_rate", "strong_mark_rate", "digit_rate", "obfuscated_rate", "obfuscated_hits", "log_words", "kinds")
_LOOKS = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "*": "", "_": "", "-": "", ".": "", "+": "t"})
_INNER = re.compile(r"[^\W\d_][0-9@$!*_+.\-]+[^\W\d_]|[@$][^\W\d_]")
_EDGE = ".,;:!?\"'()[]{}<>|*-_#&%$"
_CAPITALS, _DIGITS, _MARKS, _STRONG = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", b"!?"
STEMS = (4, 5, 6)


def units(word: str) -> list[str]:
    return [word, *(f"^{word[:k]}" for k in STEMS if len(word) > k)]


def _unit_counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents, by label, that hold each word and word beginning, summed within a slice."""
    for batch in pieces(batches, most=16 << 20, rows=1 << 16):
        n = [Counter(), Counter()]
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            words = {w.strip(_EDGE) for w in (text or "").lower().split()}
            n[toxic].update({u for w in words if w for u in units(w)})
        keys = list(n[1])  # only what a toxic document has can speak for toxicity
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([n[1][k] for k in keys], pa.int64()), pa.array([n[0][k] for k in keys], pa.int64())], names=["unit", "toxic", "clean"])
        rest = [k for k in n[0] if k not in n[1]]
        yield pa.RecordBatch.from_arrays([pa.array(rest, pa.string()), pa.array([0] * len(rest), pa.int64()), pa.array([n[0][k] for k in rest], pa.int64())], names=["unit", "toxic", "clean"])


class Lexicon(dict):
    """Word -> (weight as a word, weight of its best beginning); looked up once for each new word."""

    def __init__(self, weights: dict[str, float]):
        super().__init__()
        self.weights = weights

    def __missing__(self, word: str) -> tuple[float, float]:
        if len(self) > 30_000:  # looked up anew, to the same end
            self.clear()
        w = word.strip(_EDGE)
        stem = max((self.weights.get(f"^{w[:k]}", 0.0) for k in STEMS if len(w) > k), default=0.0)
        self[word] = pair = (self.weights.get(w, 0.0), stem)
        return pair


def features(text: str | None, lexicon: Lexicon) -> list[float]:
    """The dense features of one whole text; all 0 for null and empty."""
    text = text or ""
    raw = text.encode()
    words = text.lower().split()
    n, size = max(len(words), 1), max(len(raw), 1)
    found = list(map(lexicon.__getitem__, words))
    hits = [i for i, (w, s) in enumerate(found) if w > 0 or s > 0]
    exact = [found[i][0] for i in hits if found[i][0] > 0]
    stems = [found[i][1] for i in hits if found[i][1] > 0]
    second = [i for i, w in enumerate(words) if w in SECOND] if not SECOND.isdisjoint(words) else []
    near = 0
    if hits and second:
        at = np.searchsorted(second, hits)
        s = np.array([-99, *second, 1 << 60])
        near = int((np.minimum(np.array(hits) - s[at], s[at + 1] - np.array(hits)) <= 8).sum())
    hidden = hidden_hits = 0
    for m in set(w.strip(".,;:!?") for w in words if not w.isalpha() and _INNER.search(w.strip(".,;:!?"))) if _INNER.search(text) else ():
        hidden += 1
        hidden_hits += max(lexicon[m.translate(_LOOKS)]) > 0
    shouted = sum(1 for w in text.split() if len(w) > 2 and w.isupper())
    without = lambda marks: size - len(raw.translate(None, marks)) if raw else 0
    return [
        sum(exact) / n, float(np.mean(exact)) if exact else 0.0, max(exact, default=0.0), float(np.log1p(len(exact))), sum(stems) / n, float(np.log1p(len(stems))),
        len(second) / n, near / n, without(_CAPITALS) / size, shouted / n, without(_MARKS) / size, without(_STRONG) / size, without(_DIGITS) / size,
        hidden / n, float(hidden_hits), float(np.log1p(len(words))), float(np.log1p(len({words[i] for i in hits}))),
    ]


class Trees:
    """Gradient boosting of shallow regression trees on the logistic loss, with binned features."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, least: float = 8.0, ridge: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.least, self.ridge = rounds, depth, rate, bins, least, ridge
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.start = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        base = min(max(y.mean(), 1e-4), 1 - 1e-4) if len(y) else 0.5
        self.start = float(np.log(base / (1 - base)))
        cuts = [np.unique(np.concatenate([np.quantile(c, np.linspace(0, 1, self.bins)[1:-1]), [0.0]])) for c in x.T] if len(y) else []
        binned = np.stack([np.searchsorted(c, v, "left") for c, v in zip(cuts, x.T, strict=True)], 1) if len(y) else x
        margin = np.full(len(y), self.start)
        for _ in range(self.rounds if len(y) else 0):
            p = 1 / (1 + np.exp(-margin))
            grad, hess = y - p, np.maximum(p * (1 - p), 1e-6)
            n = 2 ** (self.depth + 1) - 1
            feature, cut, value = np.full(n, -1), np.zeros(n), np.zeros(n)
            node = np.zeros(len(y), dtype=int)
            for k in range(n):
                mine = np.flatnonzero(node == k)
                if not len(mine):
                    continue
                g, h = grad[mine].sum(), hess[mine].sum()
                value[k] = self.rate * g / (h + self.ridge)
                if k >= 2**self.depth - 1:
                    continue
                best = (1e-3, -1, 0)
                for f in range(x.shape[1]):
                    width = len(cuts[f]) + 1
                    gs = np.cumsum(np.bincount(binned[mine, f], weights=grad[mine], minlength=width))[:-1]
                    hs = np.cumsum(np.bincount(binned[mine, f], weights=hess[mine], minlength=width))[:-1]
                    ns = np.cumsum(np.bincount(binned[mine, f], minlength=width))[:-1]
                    gain = gs**2 / (hs + self.ridge) + (g - gs) ** 2 / (h - hs + self.ridge) - g**2 / (h + self.ridge)
                    gain[(ns < self.least) | (len(mine) - ns < self.least)] = 0
                    if len(gain) and gain.max() > best[0]:
                        best = (float(gain.max()), f, int(gain.argmax()))
                if best[1] < 0:
                    continue
                feature[k], cut[k] = best[1], cuts[best[1]][best[2]]
                right = binned[mine, best[1]] > best[2]
                node[mine] = 2 * k + 1 + right
            self.trees.append((feature, cut, value))
            margin += self._apply(x, *self.trees[-1])
        return self

    @staticmethod
    def _apply(x: np.ndarray, feature: np.ndarray, cut: np.ndarray, value: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), dtype=int)
        rows = np.arange(len(x))
        while (go := feature[node] >= 0).any():
            f = feature[node]
            node = np.where(go, 2 * node + 1 + (x[rows, np.maximum(f, 0)] > cut[node]), node)
        return value[node]

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.start + sum((self._apply(x, *t) for t in self.trees), np.zeros(len(x)))


class Isotonic:
    """Pool adjacent violators, then straight lines between the pools' centres."""

    def __init__(self, score: np.ndarray, y: np.ndarray):
        pools: list[list[float]] = []
        for s, v in sorted(zip(score.tolist(), y.tolist(), strict=True)):
            pools.append([v, 1.0, s])
            while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
                v1, n1, s1 = pools.pop()
                v0, n0, s0 = pools[-1]
                pools[-1] = [(v0 * n0 + v1 * n1) / (n0 + n1), n0 + n1, (s0 * n0 + s1 * n1) / (n0 + n1)]
        self.x = np.array([p[2] for p in pools])
        self.y = np.array([p[0] for p in pools])

    def __call__(self, score: np.ndarray) -> np.ndarray:
        raw = 1 / (1 + np.exp(-score))
        if not len(self.x):
            return raw
        # A hundredth of the uncalibrated score keeps the order within a pool.
        return 0.99 * np.interp(score, self.x, self.y) + 0.01 * raw


def _features_of(lexicon):
    @trimmed
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Lexicon(lexicon)
        for batch in pieces(batches, rows=1 << 14):
            x = [features(t, own) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("third"), batch.column("toxic"), pa.array(x, pa.list_(pa.float64()))], names=["third", "toxic", "x"])

    return run


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, mod: int = 4, held: int = 2) -> tuple[dict[str, float], Trees, Isotonic]:
    """Lexicon, trees and calibration, from labelled rows outside the held fold. Several labels of a document: the highest counts."""
    ids = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).where(~in_fold(mod, held)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    ids = ids.withColumn("h", F.xxhash64(F.lit(17), "doc_id")).orderBy("h", "doc_id").limit(sample).withColumn("third", F.pmod("h", F.lit(3)).cast("int")).drop("h")
    # At most `sample` ids of a few bytes: the broadcast is bounded.
    rows = materialize(docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("text", "third", "toxic"))
    size = {r.toxic: r.n for r in rows.where("third = 0").groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    per = rows.where("third = 0").select("text", "toxic").mapInArrow(_unit_counts, "unit string, toxic long, clean long").groupBy("unit").agg(F.sum("toxic").alias("a"), F.sum("clean").alias("b"))
    weight = F.log((F.col("a") + 0.5) / F.lit(size.get(1, 0) + 1.0)) - F.log((F.col("b") + 0.5) / F.lit(size.get(0, 0) + 1.0))
    lexicon = {r.unit: r.weight for r in per.where("a >= 3").withColumn("weight", weight).where("weight >= 1.5").select("unit", "weight").orderBy("unit").collect()}
    table = rows.where("third > 0").mapInArrow(_features_of(lexicon), "third int, toxic int, x array<double>").toArrow()
    x = np.array(table.column("x").to_pylist(), dtype=float).reshape(-1, len(FEATURES))
    y, third = table.column("toxic").to_numpy().astype(float), table.column("third").to_numpy()
    order = np.lexsort((*x.T, y, third))  # rows come in any order; sums must not depend on it
    x, y, third = x[order], y[order], third[order]
    trees = Trees().fit(x[third == 1], y[third == 1])
    return lexicon, trees, Isotonic(trees.margin(x[third == 2]), y[third == 2])


def _scored(model, threshold: float, batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with score and whether it reaches the threshold."""
    lexicon, trees, calibrated = model.value
    own = Lexicon(lexicon)
    for batch in pieces(batches, rows=1 << 14):
        x = np.array([features(t, own) for t in batch.column("text").to_pylist()]).reshape(-1, len(FEATURES))
        s = np.clip(calibrated(trees.margin(x)), 0.0, 1.0)
        yield batch, s, s >= threshold


def _score(model, threshold: float):
    @trimmed
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, s, toxic in _scored(model, threshold, batches):
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in batch.schema.names], pa.array(s), pa.array(toxic.astype(np.int32))], names=[*batch.schema.names, "score", "predicted"])

    return run


def score(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, fit_on: DataFrame | None = None, **options) -> DataFrame:
    """All columns of docs with score and predicted (score >= threshold); only the text is scored.

    Null and empty texts get the score of a text without words. Repeated rows repeat, equal texts score alike. Without
    labelled rows every score is 0.5 or what the base rate gives. Columns of docs named score or predicted are replaced.
    An empty table gives no rows.
    """
    docs = docs.drop("score", "predicted")
    model = docs.sparkSession.sparkContext.broadcast(learn(docs if fit_on is None else fit_on, labels, **options))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", score double, predicted int"
    return docs.mapInArrow(_score(model, threshold), schema)


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **options) -> DataFrame:
    """The rows of docs that score below the threshold, all columns as they are."""
    model = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, **options))

    @trimmed
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, toxic in _scored(model, threshold, batches):
            yield batch.filter(pa.array(~toxic))

    return docs.mapInArrow(run, docs.schema)
