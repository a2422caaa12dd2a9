"""Scoring texts by prediction by partial matching (PPM) over bytes, and by a base model over words.

One pass over the texts cuts them into slices and writes, for each slice, its distinct words and its distinct grams (a
byte and the ORDER bytes before it) with their training counts, and its texts, compressed. Words are dealt by
fingerprint, grams by the last DEALT_BY bytes of their context, so what every document holds arrives once a slice and not
once an occurrence. Nothing of the corpus is left out of the counts.

PPM: a text is its lower-cased words, each closed by a blank, then one end symbol. The context of a byte is the up to
ORDER bytes before it in the running text, blanks and words before its own included (blanks stand before the first
word). A trie node's symbols share (2c - 1) / 2T; the rest, d / 2T, escapes to the context one byte shorter, where the
symbols of the longer context are excluded; below the empty context all 256 symbols are equal. The probabilities of a
context sum to 1.

The trie is never in one place. All contexts of DEALT_BY bytes or more that a gram can escape through end in the same
bytes, so one partition holds them, and scores its grams there. Shorter contexts are broadcast: there are at most 256 ^
DEALT_BY nodes of them, however large the corpus is. What comes back to a slice is a number for each of its distinct
words and grams, in their order; there they meet the slice's texts.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanveil.llm.runtime import in_fold, materialize, parts, trim, trimmed
from spanveil.llm.words import INK, U, group_bounds, lowered, mix, pieces, split_words, task_slice, text_buffer

ORDER = 5
DEALT_BY = 3
CONTEXT = np.uint64((1 << 8 * DEALT_BY) - 1)
SLICE, ROWS = 16 << 20, 1 << 16  # bytes and rows of a slice; rows are 16 bits of a packed gram
SYMBOLS = 1 << 21  # grams that are sorted at once
BLANK, END = 0x20, 0x0A


def running(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, each as ORDER blanks, its words closed by blanks, the end symbol; and where each begins."""
    raw, offsets = text_buffer(column)
    ink = INK[raw]
    closing = ~ink
    closing[1:] &= ink[:-1]
    closing[offsets[:-1][offsets[:-1] < len(raw)]] = False
    body = lowered(raw)
    body[closing] = BLANK
    keep = ink | closing
    upto = np.concatenate([[0], np.cumsum(keep, dtype=np.int32 if len(raw) < 1 << 31 else np.int64)])[offsets]
    size = np.diff(offsets)
    open_end = np.zeros(len(size), dtype=bool)  # the last word goes up to the end of the text
    open_end[size > 0] = ink[offsets[1:][size > 0] - 1]
    at = np.concatenate([[0], np.cumsum(np.diff(upto) + open_end + ORDER + 1)])
    out = np.full(at[-1], BLANK, dtype=np.uint8)
    own = np.ones(len(out), dtype=bool)
    own[(at[:-1, None] + np.arange(ORDER)).ravel()] = False
    own[at[1:] - 1] = False
    own[at[1:][open_end] - 2] = False
    out[own] = body[keep]
    out[at[1:] - 1] = END
    return out, at


def packed_grams(column: pa.Array) -> Iterator[np.ndarray]:
    """Grams of all symbols of the texts, each over 16 bits that name its row, sorted; at most SYMBOLS at once."""
    first = 0
    for piece in pieces([pa.RecordBatch.from_arrays([column], names=["text"])], rows=ROWS):
        text, at = running(piece.column("text"))
        for lo in range(ORDER, len(text), SYMBOLS):
            hi = min(lo + SYMBOLS, len(text))
            code = np.zeros(hi - lo, dtype=U)
            for k in range(ORDER + 1):
                code <<= U(8)
                code |= text[lo - ORDER + k : hi - ORDER + k]
            code <<= U(16)
            share = np.diff(np.clip(at, lo, hi))
            code |= np.repeat(np.arange(first, first + len(share), dtype=U), share)
            begin = (at[:-1, None] + np.arange(ORDER)).ravel() - lo  # the blanks before a text are no symbols
            symbol = np.ones(hi - lo, dtype=bool)
            symbol[begin[(begin >= 0) & (begin < hi - lo)]] = False
            code = code[symbol]
            code.sort()
            yield code
        first += piece.num_rows


def _merge(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    keys = keys[order]
    at = group_bounds(keys)
    return keys[at], np.add.reduceat(counts[order], at) if len(at) else counts[:0]


def distinct_grams(column: pa.Array, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct grams with how many symbols of training rows have each."""
    keys, counts = [], []
    for packed in packed_grams(column):
        gram = packed >> U(16)
        at = group_bounds(gram)
        keys.append(gram[at])
        counts.append(np.add.reduceat(train[(packed & U(0xFFFF)).astype(np.int64)], at) if len(at) else train[:0])
    if len(keys) == 1:
        return keys[0], counts[0]
    return _merge(np.concatenate([*keys, np.zeros(0, dtype=U)]), np.concatenate([*counts, np.zeros(0, dtype=np.int64)]))


def distinct_words(column: pa.Array, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted fingerprints of the distinct words with how often training rows have each."""
    every, known, first = [np.zeros(0, dtype=U)], [np.zeros(0, dtype=U)], 0
    for piece in pieces([pa.RecordBatch.from_arrays([column], names=["text"])]):
        w = split_words(piece.column("text"))
        every.append(w.code)
        known.append(w.code[train[w.doc + first] > 0])
        first += piece.num_rows
    codes, trained = np.unique(np.concatenate(every)), np.sort(np.concatenate(known))
    return codes, np.searchsorted(trained, codes, "right") - np.searchsorted(trained, codes, "left")


def squeeze(x: np.ndarray, width: int = 8) -> bytes:
    """Integers as compressed planes of bytes; sorted ones and small ones take little."""
    raw = np.ascontiguousarray(x.astype(np.int64, copy=False).view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()
    return len(x).to_bytes(4, "little") + bytes([width]) + pa.compress(raw, codec="zstd", asbytes=True)


def spread(b: bytes) -> np.ndarray:
    n, width = int.from_bytes(b[:4], "little"), b[4]
    out = np.zeros((n, 8), dtype=np.uint8)
    out[:, :width] = np.frombuffer(pa.decompress(b[5:], decompressed_size=n * width, codec="zstd", asbytes=True), dtype=np.uint8).reshape(width, n).T
    return out.reshape(-1).view(np.int64)


WORDS, GRAMS, TEXTS, LOW = range(4)
SLICED = "kind int, part int, slice long, keys binary, counts binary, rows long"


def dealt(kind: int, keys: np.ndarray, n: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """The order of sorted keys by partition, and (partition, from, to) in that order."""
    if not len(keys):
        return np.zeros(0, dtype=np.int64), []
    if kind == WORDS:
        part = ((keys >> U(32)) * U(n) >> U(32)).astype(np.int32)
        order = np.arange(len(keys))
    else:
        part = ((mix(keys >> U(8) & CONTEXT, 3) >> U(32)) * U(n) >> U(32)).astype(np.int32)
        order = np.argsort(part, kind="stable")
        part = part[order]
    at = group_bounds(part)
    return order, list(zip(part[at].tolist(), at.tolist(), np.append(at[1:], len(part)).tolist(), strict=True))


def _slices(n: int):
    """(doc_id, held_out, text) -> SLICED."""

    @trimmed
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for turn, batch in enumerate(pieces(batches, most=SLICE, rows=ROWS)):
            train = (~batch.column("held_out").to_numpy(zero_copy_only=False).astype(bool)).astype(np.int64)
            name, rows = task_slice(turn), []
            for kind, (keys, counts) in ((WORDS, distinct_words(batch.column("text"), train)), (GRAMS, distinct_grams(batch.column("text"), train))):
                order, shares = dealt(kind, keys, n)
                k, c = keys[order], counts[order]
                rows += [(kind, p, name, squeeze(k[i:j], 8 if kind == WORDS else ORDER + 1), squeeze(c[i:j]), 0) for p, i, j in shares]
            low, at = keys & CONTEXT, counts > 0
            rows.append((LOW, -1, name, *map(squeeze, _merge(low[at], counts[at])), int(train.sum())))
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_batch(batch)
            rows.append((TEXTS, -1, name, sink.getvalue().to_pybytes(), None, batch.num_rows))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int64()), strict=True)], names=[x.split()[0] for x in SLICED.split(", ")])

    return run


def _levels(keys: np.ndarray, counts: np.ndarray, top: int, low: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Counts of nodes of order top -> those of orders low to top."""
    out = [(keys, counts)]
    for k in range(top - 1, low - 1, -1):
        out.append(_merge(out[-1][0] & U((1 << 8 * (k + 1)) - 1), out[-1][1]))
    return out[::-1]


def _sum_low(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of nodes of order DEALT_BY - 1, summed within a task."""
    keys, counts = np.zeros(0, dtype=U), np.zeros(0, dtype=np.int64)
    for batch in batches:
        for k, c in zip(batch.column("keys").to_pylist(), batch.column("counts").to_pylist(), strict=True):
            keys, counts = _merge(np.concatenate([keys, spread(k).view(U)]), np.concatenate([counts, spread(c)]))
    yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], names=["key", "n"])


def low_levels(sliced: DataFrame) -> list[tuple[np.ndarray, np.ndarray]]:
    """Nodes under order DEALT_BY over all training texts: at most 256 ^ DEALT_BY rows."""
    table = sliced.where(F.col("kind") == LOW).select("keys", "counts").mapInArrow(_sum_low, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    return _levels(*_merge(table.column("key").to_numpy().view(U), table.column("n").to_numpy()), DEALT_BY - 1, 0)


class Trie:
    """Sorted node and context keys by order, as arrays: all of a corpus, or all that the grams of one partition meet."""

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray]], order: int):
        """levels[k]: keys (k context bytes and a symbol) and counts of order k."""
        self.order = order
        self.nodes, self.counts, self.contexts, self.total, self.distinct, self.left = [], [], [], [], [], []
        for k, (keys, counts) in enumerate(levels):
            o = np.argsort(keys)
            keys, counts = keys[o], counts[o].astype(np.float64)
            own = keys >> U(8)
            at = group_bounds(own)
            ctx = own[at]
            total = np.add.reduceat(counts, at) if len(at) else counts[:0]
            distinct = np.diff(np.append(at, len(keys))).astype(np.float64)
            left = None
            if k:  # in the shorter context, the total without the symbols that this one has
                short = keys & U((1 << 8 * k) - 1)
                where = np.searchsorted(self.nodes[-1], short)
                where = np.minimum(where, max(len(self.nodes[-1]) - 1, 0))
                hit = self.nodes[-1][where] == short
                inner = np.add.reduceat(np.where(hit, self.counts[-1][where], 0.0), at)
                seen = np.add.reduceat(hit.astype(np.float64), at)
                left = (inner, seen)
            self.nodes.append(keys)
            self.counts.append(counts)
            self.contexts.append(ctx)
            self.total.append(total)
            self.distinct.append(distinct)
            self.left.append(left)

    def log10(self, grams: np.ndarray) -> np.ndarray:
        """log10 probability of each coded symbol (order context bytes, then the symbol)."""
        out = np.zeros(len(grams))
        todo = np.arange(len(grams))
        came = np.full(len(grams), -1)
        for k in range(self.order, -1, -1):
            if not len(todo):
                break
            node = grams[todo] & U((1 << 8 * (k + 1)) - 1)
            ctx = node >> U(8)
            if not len(self.nodes[k]):
                came[:] = -1
                continue
            c = np.minimum(np.searchsorted(self.contexts[k], ctx), len(self.contexts[k]) - 1)
            have = self.contexts[k][c] == ctx
            total, distinct = self.total[k][c].copy(), self.distinct[k][c].copy()
            if k < self.order:
                cut = came >= 0
                inner, seen = self.left[k + 1]
                total[cut] -= inner[came[cut]]
                distinct[cut] -= seen[came[cut]]
            at = np.minimum(np.searchsorted(self.nodes[k], node), len(self.nodes[k]) - 1)
            hit = have & (self.nodes[k][at] == node)
            out[todo[hit]] += np.log10((2 * self.counts[k][at[hit]] - 1) / (2 * total[hit]))
            miss = ~hit
            escape = miss & have & (total > 0)
            out[todo[escape]] += np.log10(distinct[escape] / (2 * total[escape]))
            came = np.where(have, c, -1)[miss]
            todo = todo[miss]
        if len(todo):
            out[todo] += np.log10(1.0 / (256 - (len(self.nodes[0]) if self.nodes[0] is not None else 0)))
        return out


ANSWERED = "kind int, part int, slice long, values binary, total long, distinct long"


def _answer(low):
    """One partition of words or grams: corpus counts, then what each slice asked for."""

    def run(table: pa.Table) -> pa.Table:
        kinds = table.column("kind").to_numpy()
        out = []
        for kind in (WORDS, GRAMS):
            some = table.filter(pa.array(kinds == kind))
            if not some.num_rows:
                continue
            asked = [spread(x).view(U) for x in some.column("keys").to_pylist()]
            keys, total = _merge(np.concatenate(asked), np.concatenate([spread(x) for x in some.column("counts").to_pylist()]))
            if kind == GRAMS:
                seen = total > 0
                logs = Trie([*low.value, *_levels(keys[seen], total[seen], ORDER, DEALT_BY)], ORDER).log10(keys).astype(np.float64)
                give = lambda at: pa.compress(logs[at].tobytes(), codec="zstd", asbytes=True)
            else:
                give = lambda at: squeeze(total[at])
                out.append((kind, -1, None, None, int(total.sum()), int((total > 0).sum())))
            part = table.column("part")[0].as_py()
            out += [(kind, part, name, give(np.searchsorted(keys, own)), 0, 0) for name, own in zip(some.column("slice").to_pylist(), asked, strict=True)]
        if table.nbytes > 1 << 22:
            trim()
        return pa.table([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.int64()), strict=True)], names=[x.split()[0] for x in ANSWERED.split(", ")])

    return run


def _gather(kind: int, keys: np.ndarray, n: int, answers: dict) -> np.ndarray:
    """What came back for sorted keys, in their order."""
    order, shares = dealt(kind, keys, n)
    out = np.zeros(len(keys), dtype=np.int64 if kind == WORDS else np.float64)
    for p, i, j in shares:
        b = answers[kind, p]
        out[order[i:j]] = spread(b) if kind == WORDS else np.frombuffer(pa.decompress(b, decompressed_size=8 * (j - i), codec="zstd", asbytes=True), dtype=np.float64)
    return out


def _score_slice(n: int):
    """The texts of one slice and what came back for it -> a row for each text."""

    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        got = dict(zip(zip(answers.column("kind").to_pylist(), answers.column("part").to_pylist(), strict=True), answers.column("values").to_pylist(), strict=True))
        whole = pa.ipc.open_stream(texts.column("keys")[0].as_py()).read_all().combine_chunks()
        column = whole.column("text").combine_chunks()
        rows = len(column)
        every = np.zeros(rows, dtype=np.int64)
        words, _ = distinct_words(column, every)
        grams, _ = distinct_grams(column, every)
        count, logs = _gather(WORDS, words, n, got), _gather(GRAMS, grams, n, got)
        log_count = np.log10(count + 1.0)
        tokens, known, base, score, first = every.copy(), every.copy(), np.zeros(rows), np.zeros(rows), 0
        for piece in pieces([pa.RecordBatch.from_arrays([column], names=["text"])]):
            w = split_words(piece.column("text"))
            at, doc = np.searchsorted(words, w.code), w.doc + first
            tokens += np.bincount(doc, minlength=rows)
            known += np.bincount(doc[count[at] > 0], minlength=rows)
            base += np.bincount(doc, weights=log_count[at], minlength=rows)
            first += piece.num_rows
        for packed in packed_grams(column):
            gram = packed >> U(16)
            at = group_bounds(gram)
            each = np.repeat(logs[np.searchsorted(grams, gram[at])], np.diff(np.append(at, len(gram))))
            score += np.bincount((packed & U(0xFFFF)).astype(np.int64), weights=each, minlength=rows)
        trim()
        return pa.table([whole.column("doc_id"), whole.column("held_out"), pa.array(tokens), pa.array(known), pa.array(base), pa.array(score)], names=["doc_id", "held_out", "words", "known", "logs", "score"])

    return run


def score(docs: DataFrame, mod: int = 7, held: int = 2) -> DataFrame:
    """Rows of docs (doc_id, text) with held_out, n_tokens, n_known, train_tokens, base_score and score (log10).

    The models learn from the rows outside the held fold. Null and empty texts are one end token. Repeated rows repeat
    and each counts; doc_id may be null and of any type. With no training rows all words are unknown. An empty table
    gives no rows. Columns other than these two are left out. One document must fit in a task's memory. Words are known
    by 64-bit fingerprints; log probabilities travel as 32-bit floats, so a score is right to about 7 digits.
    """
    spark = docs.sparkSession
    n = parts(spark, docs)
    rows = docs.select("doc_id", in_fold(mod, held).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    sliced = materialize(rows.mapInArrow(_slices(n), SLICED))
    low = spark.sparkContext.broadcast(low_levels(sliced))
    asked = sliced.where(F.col("kind") < TEXTS).select("kind", "part", "slice", "keys", "counts")
    answers = materialize(asked.groupBy("part").applyInArrow(_answer(low), ANSWERED))
    sums = answers.where("slice is null").agg(F.coalesce(F.sum("total"), F.lit(0)).alias("total"), F.coalesce(F.sum("distinct"), F.lit(0)).alias("distinct")).head()
    ends = sliced.where(F.col("kind") == LOW).agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("n")).head().n
    tokens, kinds = sums.total + ends, sums.distinct + (1 if ends else 0)
    texts = sliced.where(F.col("kind") == TEXTS).select("slice", "keys")
    kind = dict(docs.dtypes)["doc_id"]
    per = texts.groupBy("slice").cogroup(answers.where("slice is not null").select("kind", "part", "slice", "values").groupBy("slice"))
    out = per.applyInArrow(_score_slice(n), f"doc_id {kind}, held_out boolean, words long, known long, logs double, score double")
    base = F.col("logs") + float(np.log10(ends + 1.0)) - (F.col("words") + 1) * float(np.log10(tokens + kinds + 1.0))
    return out.select("doc_id", "held_out", (F.col("words") + 1).alias("n_tokens"), (F.col("known") + (1 if ends else 0)).alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"), base.alias("base_score"), "score")
