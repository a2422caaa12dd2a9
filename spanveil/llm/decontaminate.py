"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

Texts are normalised: ASCII letters in lower case, every run of other ASCII characters one blank. An item of m
characters occurs with at most k = floor(rate m) edits only where the text shares m - q + 1 - k q of its q-grams within
k diagonals. Shared q-grams are counted in overlapping bands of diagonals; regions that reach the bound are verified by
an alignment that leaves k diagonals open on either side of the region's own.

Items are the stated query set: they go to every task in blocks of at most `block_chars` characters, each block against
all rows.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, DataType, IntegerType, LongType, StructField, StructType

from spanveil.llm.runtime import materialize, trimmed
from spanveil.llm.words import U, group_bounds, pieces, text_buffer

Q = 10
RATE = 0.06
BLOCK_CHARS = 4_000_000
_TABLE = np.full(256, 0x20, dtype=np.uint8)
for _c in [*range(48, 58), *range(97, 123), *range(128, 256)]:
    _TABLE[_c] = _c
_TABLE[65:91] = np.arange(97, 123)


def normalise(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Normalised bytes of all texts, offsets into them, and the place in raw of each byte kept."""
    b = _TABLE[raw]
    blank = b == 0x20
    keep = ~blank
    keep[1:] |= ~blank[:-1]
    if len(b):
        starts = offsets[:-1][offsets[:-1] < len(b)]
        keep[starts] = ~blank[starts]
    at = np.flatnonzero(keep)
    return b[at], np.searchsorted(at, offsets), at


def q_grams(b: np.ndarray, q: int = Q) -> np.ndarray:
    """Code of the q bytes from each place; 8 <= q <= 12."""
    n = len(b) - q + 1
    if n <= 0:
        return np.zeros(0, dtype=U)
    two = b[:-1].astype(np.uint16) | b[1:].astype(np.uint16) << np.uint16(8)
    four = two[:-2].astype(np.uint32) | two[2:].astype(np.uint32) << np.uint32(16)
    low = four[:-4][:n].astype(U) | four[4:][:n].astype(U) << U(32)
    tail = four[q - 4 :][:n].astype(U)
    h = (low * U(0x9E3779B97F4A7C15)) ^ (tail * U(0xC2B2AE3D27D4EB4F))
    return (h ^ (h >> U(29))) * U(0xBF58476D1CE4E5B9)


class Index:
    """q-grams of the items: a bit table that most places of a text miss, then exact lists of (item, place)."""

    def __init__(self, texts: list[str], q: int, rate: float):
        self.q, self.rate = q, rate
        self.items, self.edits, self.least, self.exact = [], [], [], []
        codes, item, place = [], [], []
        for k, text in enumerate(texts):
            raw = np.frombuffer(text.encode(), dtype=np.uint8)
            body = normalise(raw, np.array([0, len(raw)]))[0].tobytes().strip(b" ")
            m = len(body)
            edits = min(int(rate * m), max(0, (m - q) // q))
            self.items.append(body)
            self.edits.append(edits)
            self.least.append(m - q + 1 - edits * q)
            if m < q:
                self.exact.append(k)
                continue
            c = q_grams(np.frombuffer(body, dtype=np.uint8), q)
            codes.append(c)
            item.append(np.full(len(c), k))
            place.append(np.arange(len(c)))
        codes = np.concatenate(codes) if codes else np.zeros(0, dtype=U)
        order = np.argsort(codes, kind="stable")
        self.codes = codes[order]
        self.item = np.concatenate(item)[order] if item else np.zeros(0, dtype=int)
        self.place = np.concatenate(place)[order] if place else np.zeros(0, dtype=int)
        self.first = group_bounds(self.codes)
        self.distinct = self.codes[self.first]
        self.last = np.append(self.first[1:], len(self.codes))
        self.bits = max(16, min(26, int(np.ceil(np.log2(max(len(self.distinct), 1) * 64)))))
        self.table = np.zeros(1 << self.bits, dtype=bool)
        self.table[self.distinct >> U(64 - self.bits)] = True


def _words(b: bytes, pad: bytes) -> np.ndarray:
    """The eight bytes from each place on; pad stands behind the last."""
    return np.ndarray((len(b) + 1,), dtype="<u8", buffer=b + pad * 16, strides=(1,)).copy()


def align(item: bytes, text: bytes, edits: int) -> tuple[int, int, int] | None:
    """Least edits at which item lies in text, with the place: (edits, start, stop); None above the limit.

    Banded: of each diagonal within `edits` of one that item can begin and end on, only the furthest place of item that
    e edits reach is kept, for e = 0, 1, ...; equal stretches are passed eight bytes at a time. text is the region of
    the band, so there are a few times `edits` diagonals, and the work does not grow with their length.
    """
    at = text.find(item)
    if at >= 0:
        return 0, at, at + len(item)
    m, n = len(item), len(text)
    if not edits or n < m - edits:
        return None
    a, b = _words(item, b"\0"), _words(text, b"\1")
    diagonal = np.arange(-edits, n - m + edits + 1)

    def extend(i: np.ndarray) -> np.ndarray:
        todo = np.flatnonzero((i >= 0) & (i < m) & (i + diagonal >= 0) & (i + diagonal < n))
        while len(todo):
            x = a[i[todo]] ^ b[i[todo] + diagonal[todo]]
            low = x & (~x + U(1))
            same = np.where(x == 0, 8, np.log2(np.maximum(low, U(1)).astype(np.float64)).astype(np.int64) >> 3)
            i[todo] += same
            todo = todo[(same == 8) & (i[todo] < m) & (i[todo] + diagonal[todo] < n)]
        return i

    off = -1 << 40
    begin = np.maximum(diagonal, 0)
    reach = extend(np.where((diagonal >= 0) & (diagonal <= n), 0, off))
    for e in range(1, edits + 1):
        lower, upper = np.append(off, reach[:-1]), np.append(reach[1:], off)
        options = np.stack([reach + 1, upper + 1, lower])  # another character, one of item left out, one of text left out
        options[:, :] = np.where((options <= m) & (options + diagonal <= n) & (options + diagonal >= 0), options, off)
        which = options.argmax(0)
        begins = np.stack([begin, np.append(begin[1:], 0), np.append(0, begin[:-1])])
        new = options[which, np.arange(len(diagonal))]
        begin = np.where(new > reach, begins[which, np.arange(len(diagonal))], begin)
        reach = extend(np.maximum(new, reach))
        done = np.flatnonzero(reach >= m)
        if len(done):
            d = done[np.lexsort((diagonal[done], begin[done]))[0]]
            return e, int(begin[d]), m + int(diagonal[d])
    return None


def find(index: Index, column: pa.Array) -> list[tuple[int, int, int, int, int]]:
    """(row, item, first byte, stop byte, edits) of every item found, best first place per row, item and band."""
    raw, offsets = text_buffer(column)
    body, edge, at = normalise(raw, offsets)
    found: dict[tuple[int, int], tuple[int, int, int]] = {}

    def keep(row: int, item: int, hit: tuple[int, int, int], base: int) -> None:
        start, stop = base + hit[1], base + hit[2]
        while start < stop - 1 and body[start] == 0x20:
            start += 1
        old = found.get((row, item))
        new = (hit[0], int(at[start] - offsets[row]), int(at[stop - 1] + 1 - offsets[row]))
        if old is None or new < old:
            found[row, item] = new

    if len(index.distinct) and len(body) >= index.q:
        codes = q_grams(body, index.q)
        maybe = np.flatnonzero(index.table[codes >> U(64 - index.bits)])
        c = codes[maybe]
        slot = np.minimum(np.searchsorted(index.distinct, c), len(index.distinct) - 1)
        same = index.distinct[slot] == c
        maybe, slot = maybe[same], slot[same]
        row = np.searchsorted(edge, maybe, "right") - 1
        inside = maybe + index.q <= edge[row + 1]
        maybe, slot, row = maybe[inside], slot[inside], row[inside]
        times = index.last[slot] - index.first[slot]
        which = np.repeat(index.first[slot], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        pos, row, item = np.repeat(maybe, times), np.repeat(row, times), index.item[which]
        edits, least = np.array(index.edits), np.array(index.least)
        # Bands of 2k + 2 diagonals, one every k + 1: any k + 1 neighbouring diagonals lie in one of them.
        width = edits[item] + 1
        diagonal = pos - index.place[which] + (1 << 20)
        for shift in (0, 1):
            band = diagonal // width - shift
            band = band // 2 * 2 + shift
            order = np.lexsort((index.place[which], band, item, row))
            r, i, g = row[order], item[order], band[order]
            fresh = np.ones(len(order), dtype=bool)
            fresh[1:] = (r[1:] != r[:-1]) | (i[1:] != i[:-1]) | (g[1:] != g[:-1])
            starts = np.flatnonzero(fresh)
            p = index.place[which][order]
            new = fresh.copy()
            new[1:] |= p[1:] != p[:-1]  # an item's q-gram counts once a band
            n = np.add.reduceat(new.astype(int), starts) if len(starts) else np.zeros(0, dtype=int)
            for s in starts[n >= least[i[starts]]].tolist():
                k, doc = int(i[s]), int(r[s])
                low = int(g[s]) * int(edits[k] + 1) - (1 << 20) - int(edits[k])
                lo = max(int(edge[doc]), low)
                hi = min(int(edge[doc + 1]), low + 4 * int(edits[k] + 1) + len(index.items[k]))
                if hit := align(index.items[k], body[lo:hi].tobytes(), int(edits[k])):
                    keep(doc, k, hit, lo)
    for k in index.exact:
        item = index.items[k]
        if item:
            for doc in range(len(offsets) - 1):
                # A short item must stand between blanks.
                text = b" " + body[edge[doc] : edge[doc + 1]].tobytes() + b" "
                if (x := text.find(b" " + item + b" ")) >= 0:
                    keep(doc, k, (0, x, x + len(item)), int(edge[doc]))
    return sorted((r, k, s, e, d) for (r, k), (d, s, e) in found.items())


def _hits(kind: DataType) -> ArrayType:
    """What is found in a text: items by their ids, whatever type these have."""
    return ArrayType(StructType([StructField("item_id", kind), StructField("start", LongType()), StructField("stop", LongType()), StructField("edits", IntegerType())]))


def _mark(index, into: str, kind: DataType, only: bool):
    """Batches with what a block of items is found at; only: no other column but the row's number, and no rows without hits."""
    as_arrow = to_arrow_type(_hits(kind))

    @trimmed
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, names = index.value
        for batch in pieces(batches, rows=1 << 16):
            hits: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            for r, k, s, e, d in find(own, batch.column("text")):
                hits[r].append({"item_id": names[k], "start": s, "stop": e, "edits": d})
            if only:
                some = [r for r, h in enumerate(hits) if h]
                yield pa.RecordBatch.from_arrays([batch.column(ROW).take(pa.array(some, pa.int64())), pa.array([hits[r] for r in some], as_arrow)], names=[ROW, into])
            else:
                yield batch.set_column(batch.schema.get_field_index(into), into, pa.array(hits, as_arrow))

    return run


ROW = "__row"


def _blocks(benchmark: DataFrame, most: int) -> Iterator[list]:
    """Items in blocks of at most `most` characters (one item at least); one block is held at a time."""
    block, room = [], most
    for x in benchmark.select("item_id", "text").where("text is not null and item_id is not null").orderBy("item_id", "text").toLocalIterator():
        if block and room < len(x.text):
            yield block
            block, room = [], most
        block.append((x.item_id, x.text))
        room -= len(x.text)
    if block:
        yield block


def find_items(docs: DataFrame, benchmark: DataFrame, q: int = Q, rate: float = RATE, block_chars: int = BLOCK_CHARS, into: str = "hits") -> DataFrame:
    """All columns of docs with hits: benchmark items (item_id, text) found in the whole text, with UTF-8 byte spans.

    Items that normalise to fewer than q characters must occur exactly, between blanks; null and empty items never do.
    Null and empty texts have no hits. Repeated rows repeat; items with equal texts or ids are all reported. Ids of items
    may be of any type that has an order. A column of docs named as `into` is replaced. Blocks of items run one after
    another, so that the driver and a task hold one block's index whatever the size of the benchmark; with more than one,
    the documents are numbered and written once, each block writes only the hits of the rows that it is found in, and the
    hits are joined at the end.
    """
    spark, kind = docs.sparkSession, benchmark.schema["item_id"].dataType
    index = lambda block: spark.sparkContext.broadcast((Index([t for _, t in block], q, rate), [i for i, _ in block]))
    out = docs.drop(into).withColumn(into, F.array().cast(_hits(kind)))
    blocks = _blocks(benchmark, block_chars)
    first, second = next(blocks, None), next(blocks, None)
    if first is None:
        return out
    if second is None:
        return out.mapInArrow(_mark(index(first), into, kind, False), out.schema)
    row = ROW
    while row.lower() in (c.lower() for c in out.columns):
        row += "_"
    rows, found = materialize(out.drop(into).withColumn(row, F.monotonically_increasing_id())), []
    numbered = rows.select(F.col(row).alias(ROW), "text")
    for n, block in enumerate(itertools.chain([first, second], blocks)):
        held = index(block)
        hits = numbered.mapInArrow(_mark(held, into, kind, True), StructType([StructField(ROW, LongType()), StructField(into, _hits(kind))]))
        found.append(materialize(hits.withColumn("block", F.lit(n))))
        held.unpersist()
    in_order = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("block", into))), lambda x: x[into]))
    every = functools.reduce(DataFrame.unionByName, found).groupBy(ROW).agg(in_order.alias(into)).withColumnRenamed(ROW, row)
    return rows.join(every, row, "left").withColumn(into, F.coalesce(into, F.array().cast(_hits(kind)))).select(*docs.drop(into).columns, into)


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of docs without a benchmark item, all columns as they are."""
    into = "hits"
    while into.lower() in (c.lower() for c in docs.columns):
        into += "_"
    return find_items(docs, benchmark, into=into, **options).where(F.size(into) == 0).drop(into)
