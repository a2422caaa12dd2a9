"""Exact n-gram Jaccard join: documents whose sets of word shingles have a Jaccard similarity of 0.8 or more.

1. Shingles are 52-bit fingerprints of five lower-cased words. A document with a partner shares at least 80 % of its
   shingles with it, so 80 % of its shingles occur in two documents or more. One pass deals shingles by fingerprint,
   counts documents per shingle, and sends back only counts per document; the documents that fail go no further.
2. Equal sets become one class. Classes are counted anew among themselves, and a class keeps its n - ceil(0.8 n) + 1
   rarest shingles (ties by fingerprint): two classes that match share one of them. Shingles kept by two classes link
   them loosely, and loose components are the cells of the join: each set is sent to its cell once.
3. In a cell, each set is searched in an inverted index by DivideSkip: the longest lists are set aside, the short ones
   are merged (by a heap that skips; where they are long, by counting), candidates are probed for in the long lists by
   binary search and leave once they cannot reach the overlap. The count of those that stay is the exact overlap. A cell
   over `block` sets is cut by size and hash, and pairs of its parts whose sizes are compatible are searched.
4. Every link between classes counts for its documents; links that connect become components.

Sets are compared by fingerprints, not by words: two different shingles agree with a chance of 2^-52.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from math import log2

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanveil.llm.components import components
from spanveil.llm.runtime import materialize, parts, trim, trimmed
from spanveil.llm.words import U, group_bounds, mix, pieces, slice_name, split_words

BITS = 52
MASK = U((1 << BITS) - 1)
BLOCK = 1024
BAND = 1.12  # ratio of the sizes of sets in one part of a cut cell
LIGHT = 96  # postings that a heap merges faster than an array counts
MU = 0.0085  # weight of binary search against merging, in choosing how many lists are long


def shingle_sets(column: pa.Array, words: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles of each text: fingerprints, and the row of each."""
    w = split_words(column)
    base = U(0x9E3779B97F4A7C15 | 1)
    n = len(w.code)
    if not n:
        return np.zeros(0, dtype=U), np.zeros(0, dtype=np.int64)
    first = group_bounds(w.doc)
    length = np.diff(np.append(first, n))
    value = np.zeros(max(n - words + 1, 0), dtype=U)
    for k in range(words):
        value = value * base + w.code[k : k + len(value)]
    whole = w.doc[: len(value)] == w.doc[words - 1 :] if len(value) else np.zeros(0, dtype=bool)
    code, doc = mix(value[whole], 1), w.doc[: len(value)][whole]
    short = np.flatnonzero(length < words)
    if len(short):
        total = np.zeros(len(short), dtype=U)
        for k in range(words - 1):
            has = length[short] > k
            total[has] = total[has] * base + w.code[first[short[has]] + k]
        code = np.concatenate([code, mix(total + length[short].astype(U), 2)])
        doc = np.concatenate([doc, w.doc[first[short]]])
    key = np.unique(code & MASK | doc.astype(U) << U(BITS))
    return key & MASK, (key >> U(BITS)).astype(np.int64)


def _set_names(code: np.ndarray, doc: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size of each row's set and two 64-bit sums that name the set."""
    n = np.bincount(doc, minlength=rows)
    at = group_bounds(doc)
    names = np.zeros((2, rows), dtype=U)
    for k in range(2):
        if len(at):
            names[k, doc[at]] = np.add.reduceat(mix(code, 11 + k), at)
    return n, names[0].astype(np.int64), names[1].astype(np.int64)


DEALT = "kind int, part int, slice long, width int, owners binary, tokens binary, again binary"  # width: bytes of each of the owners' numbers


def _owners(doc: np.ndarray, width: int) -> bytes:
    """Documents of a sorted run and how often each comes: as long as the documents that are in it, whatever the slice holds."""
    at = group_bounds(doc)
    return np.concatenate([doc[at], np.diff(np.append(at, len(doc)))]).astype(f"u{width}").tobytes()


def _deal_slices(n: int, words: int):
    """Slices -> for each partition the shingles of each document that no other of the slice has, and the others once."""

    @trimmed
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for turn, batch in enumerate(pieces(batches, rows=4096)):
            code, doc = shingle_sets(batch.column("text"), words)
            size, a, b = _set_names(code, doc, batch.num_rows)
            order = np.argsort(code)
            ordered = code[order]
            at = group_bounds(ordered)
            run_of = np.diff(np.append(at, len(ordered)))
            shared = np.zeros(len(code), dtype=bool)
            shared[order] = np.repeat(run_of > 1, run_of)
            inner = np.bincount(doc[shared], minlength=batch.num_rows)
            part = (code * U(n) >> U(BITS)).astype(np.uint32)
            alone = np.flatnonzero(~shared)
            alone = alone[np.argsort(part[alone], kind="stable")]  # by partition, then document
            token = code.astype(np.uint32)
            twice = ordered[at[run_of > 1]]
            twice_part = (twice * U(n) >> U(BITS)).astype(np.uint32)
            some = np.union1d(part[alone], twice_part)  # only partitions that get a shingle get a row
            edge, twice_edge = (np.append(np.searchsorted(x, some), len(x)) for x in (part[alone], twice_part))
            column = batch.column("doc_id")
            ids, null = pc.fill_null(column, 0).to_numpy(), column.is_null().to_numpy(zero_copy_only=False)
            slice_id = slice_name(turn, a, ids)
            meta = np.concatenate([[len(ids)], ids, null, size, a, b, inner]).astype(np.int64).tobytes()
            width = 2 if max(size.max(initial=0), batch.num_rows) < 1 << 16 else 4
            owners = [_owners(doc[alone[a_:b_]], width) for a_, b_ in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([1] * len(some) + [2], pa.int32()),
                    pa.array([*some.tolist(), slice_id % n], pa.int32()),
                    pa.array([slice_id] * (len(some) + 1), pa.int64()),
                    pa.array([width] * len(some) + [8], pa.int32()),
                    pa.array([*owners, meta], pa.binary()),
                    pa.array([token[alone[edge[k] : edge[k + 1]]].tobytes() for k in range(len(some))] + [b""], pa.binary()),
                    pa.array([twice[twice_edge[k] : twice_edge[k + 1]].astype(np.uint32).tobytes() for k in range(len(some))] + [b""], pa.binary()),
                ],
                names=["kind", "part", "slice", "width", "owners", "tokens", "again"],
            )

    return run


def _count_shared(rows: pd.DataFrame) -> pd.DataFrame:
    """One partition of shingles: for each slice, documents and how many of their shingles another slice has too."""
    out = [(r.slice, r.owners, None) for r in rows[rows.kind == 2].itertuples()]
    own = rows[rows.kind == 1]
    tokens = [np.frombuffer(x, dtype=np.uint32) for x in own.tokens]
    again = [np.frombuffer(x, dtype=np.uint32) for x in own.again]
    ordered = np.sort(np.concatenate([*tokens, *again, np.zeros(0, dtype=np.uint32)]))
    at = group_bounds(ordered)
    several = ordered[at[np.diff(np.append(at, len(ordered))) > 1]]
    known = np.sort(np.concatenate([several, *again]))
    for slice_id, t, width, owners in zip(own.slice, tokens, own.width, own.owners, strict=True):
        if not len(t) or not len(known):
            continue
        hit = known[np.minimum(np.searchsorted(known, t), len(known) - 1)] == t
        if hit.any():
            docs, n = np.frombuffer(owners, dtype=f"u{width}").reshape(2, -1)
            held = np.bincount(np.repeat(np.arange(len(docs)), n)[hit], minlength=len(docs))
            out.append((slice_id, None, np.stack([docs[held > 0], held[held > 0]]).astype(np.int32).tobytes()))
    if len(ordered) > 1 << 20:
        trim()
    return pd.DataFrame(out, columns=["slice", "meta", "counts"])


def _join_counts(rows: pd.DataFrame) -> pd.DataFrame:
    meta = np.frombuffer(rows.meta[rows.meta.notna()].iloc[0], dtype=np.int64)
    n = int(meta[0])
    ids, null, size, a, b, inner = meta[1:].reshape(6, n)
    total = inner.copy()
    for x in rows.counts[rows.counts.notna()]:
        docs, held = np.frombuffer(x, dtype=np.int32).reshape(2, -1)
        total[docs] += held
    return pd.DataFrame({"doc_id": pd.array(ids, dtype="Int64").copy() if not null.any() else pd.array([None if z else i for i, z in zip(ids, null, strict=True)], dtype="Int64"), "n": size, "a": a, "b": b, "shared": total})


def _sets(words: int):
    @trimmed
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, rows=4096):
            code, doc = shingle_sets(batch.column("text"), words)
            size, a, b = _set_names(code, doc, batch.num_rows)
            offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.ListArray.from_arrays(pa.array(offsets), pa.array(code.astype(np.int64)))], names=["a", "b", "tokens"])

    return run


class Forest:
    """Union-find over local numbers."""

    def __init__(self, n: int):
        self.up = list(range(n))
        self.trees = n

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.find(x), self.find(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)
            self.trees -= 1


def needed(x: int, y: int, percent: int = 80) -> int:
    """Least overlap of sets of x and y shingles at that similarity."""
    return -(-percent * (x + y) // (100 + percent))


def heap_merge(lists: list[list[int]], quota: int) -> Iterator[tuple[int, int]]:
    """(number, lists that hold it) for numbers in at least `quota` of the sorted lists; lists skip what cannot reach it."""
    heap = [(x[0], k, 0) for k, x in enumerate(lists) if x]
    heapq.heapify(heap)
    while len(heap) >= quota:
        value = heap[0][0]
        popped = []
        while heap and heap[0][0] == value:
            popped.append(heapq.heappop(heap))
        if len(popped) >= quota:
            yield value, len(popped)
            target = value + 1
        else:  # quota - 1 lists may be popped in all: none below the new top can reach the quota
            while heap and len(popped) < quota - 1:
                popped.append(heapq.heappop(heap))
            if not heap:
                return
            target = heap[0][0]
        for _, k, _ in popped:
            at = bisect_left(lists[k], target)
            if at < len(lists[k]):
                heapq.heappush(heap, (lists[k][at], k, at))


class Index:
    """Inverted lists of sets in order of size: of each shingle that two sets hold, the numbers of the sets."""

    def __init__(self, sets: list[np.ndarray]):
        self.size = np.array([len(x) for x in sets])
        flat = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets)), self.size)
        order = np.argsort(flat, kind="stable")  # owners ascend within a list
        self.owner = owner[order]
        self.first = group_bounds(flat[order])
        self.last = np.append(self.first[1:], len(flat))
        number = np.zeros(len(flat), dtype=np.int64)
        number[self.first[1:]] = 1
        lists = np.empty(len(flat), dtype=np.int64)
        lists[order] = np.cumsum(number)
        several = (self.last - self.first > 1)[lists]
        upto = np.concatenate([[0], np.cumsum(several)])[np.concatenate([[0], np.cumsum(self.size)])]
        self.lists, self.upto = lists[several], upto

    def search(self, q: int, low: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Sets from low to q that share at least `least` shingles with set q, and how many they share, by DivideSkip."""
        own = self.lists[self.upto[q] : self.upto[q + 1]]
        none = own[:0], own[:0]
        if least < 1 or len(own) < least:
            return none
        length = self.last[own] - self.first[own]
        own = own[np.argsort(length, kind="stable")]
        long_n = min(least - 1, int(least / (MU * log2(int(length.max()) + 1) + 1)))
        short, long = own[: len(own) - long_n], own[len(own) - long_n :]
        quota = least - long_n  # what a candidate needs in the short lists
        count = self.last[short] - self.first[short]
        if count.sum() <= LIGHT:
            lists = [[x for x in self.owner[i:j].tolist() if low <= x < q] for i, j in zip(self.first[short].tolist(), self.last[short].tolist(), strict=True)]
            some = list(heap_merge(lists, quota))
            c, shared = np.array([x for x, _ in some], dtype=np.int64), np.array([n for _, n in some], dtype=np.int64)
        else:
            ends = np.cumsum(count)
            at = np.repeat(self.first[short] - (ends - count), count) + np.arange(ends[-1])
            x = self.owner[at]
            n = np.bincount(x[(x >= low) & (x < q)] - low, minlength=1)
            c = np.flatnonzero(n >= quota)
            c, shared = c + low, n[c]
        for k, (i, j) in enumerate(zip(self.first[long].tolist(), self.last[long].tolist(), strict=True)):
            if not k % 16:
                stay = shared + (long_n - k) >= least
                c, shared = c[stay], shared[stay]
                if not len(c):
                    return none
            x = self.owner[i:j]
            shared += x[np.minimum(np.searchsorted(x, c), j - i - 1)] == c
        stay = shared >= least
        return c[stay], shared[stay]


FOUND = "u long, v long, links long"  # two sets that a link connects; or v null, and how many documents u has links with


def _search(percent: int):
    """Two parts of a cell, or one with itself: how many links each set has there, and links that connect its sets."""

    def run(cell: pd.DataFrame) -> pd.DataFrame:
        cell = cell.sort_values(["n", "node"], ignore_index=True)
        index = Index([np.asarray(t) for t in cell.tokens])
        size, node, side, copies = index.size, cell.node.to_list(), cell.side.to_numpy(), cell["copies"].to_numpy()
        links = np.zeros(len(size), dtype=np.int64)
        forest = Forest(len(size))
        for q in range(len(size)):
            # Partners come before q in order of size; the smallest that can match has percent of q's size.
            low = int(np.searchsorted(size, -(-percent * int(size[q]) // 100)))
            if low >= q:
                continue
            c, shared = index.search(q, low, needed(int(size[q]), int(size[low]), percent))
            good = (100 * shared >= percent * (size[q] + size[c] - shared)) & ((side[c] != side[q]) | (side[c] < 0))
            c = c[good]
            links[q] += copies[c].sum()
            links[c] += copies[q]
            for x in c.tolist():
                forest.join(q, x)
        # Each set and the first of its tree: stars, which contract in two rounds.
        rows = [(node[q], node[forest.find(q)], 0) for q in range(len(size)) if forest.find(q) != q] + [(node[q], None, n) for q, n in enumerate(links.tolist()) if n]
        return pd.DataFrame({k: pd.array([r[i] for r in rows], dtype="Int64") for i, k in enumerate(("u", "v", "links"))})

    return run


def join(docs: DataFrame, words: int = 5, percent: int = 80, block: int = BLOCK) -> DataFrame:
    """Rows of docs (doc_id, text) with n_shingles, component_id (the least doc_id reachable by links) and n_links (rows linked directly).

    A text of fewer words is one shingle, the whole sequence; a null or empty text has none and is linked with nothing.
    Repeated rows repeat and are linked. A row without doc_id is linked as any other and holds components together, but
    gives none its name; a component of such rows alone has none. An empty table gives no rows. doc_id may be of any type
    that has an order; one that isn't a whole number goes by its 64-bit hash, which isn't verified. Other columns are left
    out.
    """
    spark = docs.sparkSession
    kind = dict(docs.dtypes)["doc_id"]
    if kind not in ("tinyint", "smallint", "int", "bigint"):  # by numbers, then back to ids
        keyed = docs.select(F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id")).alias("key"), "doc_id", "text")
        ids = keyed.where("key is not null").select("key", "doc_id").distinct()
        out = join(keyed.select(F.col("key").alias("doc_id"), "text"), words, percent, block).withColumnsRenamed({"doc_id": "key", "component_id": "root"}).join(ids, "key", "left")
        names = out.groupBy("root").agg(F.min("doc_id").alias("component_id"))
        return out.join(names, "root", "left").select("doc_id", "n_shingles", "component_id", "n_links")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    dealt = rows.mapInArrow(_deal_slices(parts(spark, docs), words), DEALT)
    counted = dealt.groupBy("part").applyInPandas(_count_shared, "slice long, meta binary, counts binary")
    known = materialize(counted.groupBy("slice").applyInPandas(_join_counts, "doc_id long, n long, a long, b long, shared long"))
    least = F.ceil(F.col("n") * percent / 100)
    maybe = known.where((F.col("n") > 0) & (F.col("shared") >= least))
    classes = materialize(maybe.groupBy("a", "b", "n").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).withColumn("node", F.monotonically_increasing_id()))
    # A class without any doc_id has no row to be looked up by: those rows are all looked at.
    some = rows.join(classes.select("doc_id").distinct(), "doc_id", "left_semi").unionByName(rows.where("doc_id IS NULL"))
    sets = some.mapInArrow(_sets(words), "a long, b long, tokens array<long>")
    sets = materialize(sets.join(classes.drop("doc_id"), ["a", "b"]).dropDuplicates(["node"]).select("node", "n", "copies", "tokens"))
    token = sets.select("node", "n", F.explode("tokens").alias("token"))
    often = token.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    common = materialize(token.join(often, "token"))
    # Shingles that only this class has come first in its order, so they take up places of the prefix.
    prefix = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    held = common.groupBy("node", "n").agg(F.count("*").alias("m"), F.array_sort(F.collect_list(F.struct("df", "token"))).alias("x"))
    room = (prefix - (F.col("n") - F.col("m"))).cast("int")
    keys = materialize(held.where(room > 0).select("node", F.explode(F.slice("x", F.lit(1), room)).alias("x")).select("node", F.col("x.token").alias("token")))
    heads = keys.groupBy("token").agg(F.min("node").alias("head"), F.count("*").alias("m")).where("m > 1").drop("m")
    loose = components(keys.join(heads, "token").select(F.col("node").alias("u"), F.col("head").alias("v")).distinct())
    placed = sets.join(loose, "node")
    large = placed.groupBy("root").agg(F.count("*").alias("members")).where(F.col("members") > block).select("root", F.lit(True).alias("large"))
    band = F.when(F.col("large"), F.floor(F.log("n") / F.log(F.lit(BAND)))).otherwise(0).cast("int")
    one = materialize(placed.join(large, "root", "left").select("root", "node", "n", "copies", "tokens", band.alias("band")))
    spans = materialize(one.groupBy("root", "band").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.ceil(F.count("*") / block).cast("int").alias("shares")))
    chunks = spans.select("root", "lo", "hi", F.explode(F.transform(F.sequence(F.lit(0), F.col("shares") - 1), lambda x: F.struct("band", x.alias("share")))).alias("i"))
    later = chunks.select(F.col("root").alias("r"), F.col("i").alias("j"), F.col("lo").alias("later_lo"))
    tasks = chunks.join(later, (F.col("root") == F.col("r")) & (F.col("i") <= F.col("j")) & (F.col("hi") * 100 >= F.col("later_lo") * percent)).select("root", "i", "j")
    side = lambda chunk, n: F.struct(chunk.alias("chunk"), F.lit(n).alias("side"))
    both = F.when(F.col("i") == F.col("j"), F.array(side(F.col("i"), -1))).otherwise(F.array(side(F.col("i"), 0), side(F.col("j"), 1)))
    sides = tasks.select("root", "i", "j", F.explode(both).alias("x")).select("root", "i", "j", F.col("x.chunk.band").alias("band"), F.col("x.chunk.share").alias("share"), "x.side")
    shared = one.join(spans.select("root", "band", "shares"), ["root", "band"]).withColumn("share", F.pmod(F.xxhash64("node"), F.col("shares")).cast("int")).drop("shares")
    found = materialize(shared.join(sides, ["root", "band", "share"]).groupBy("root", "i", "j").applyInPandas(_search(percent), FOUND))
    linked = components(found.where("v is not null").select("u", "v"))
    links = found.where("v is null").groupBy(F.col("u").alias("node")).agg(F.sum("links").alias("links"))
    named = classes.join(linked, "node", "left").withColumn("root", F.coalesce("root", "node")).join(links, "node", "left")
    least_id = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    grouped = materialize(named.join(least_id, "root").select("a", "b", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    out = known.join(grouped, ["a", "b"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"), F.when(F.col("n") > 0, F.coalesce("n_links", F.lit(0))).otherwise(0).cast("long").alias("n_links"))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs without those whose component holds a lesser doc_id; of repeated doc_ids one row stays.

    Rows without doc_id stay.
    """
    linked = join(docs, **options)
    out = docs.join(linked.where("component_id <> doc_id").select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)
    again = materialize(docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 and doc_id is not null").select("doc_id"))
    if again.isEmpty():
        return out
    return out.join(again, "doc_id", "left_anti").select(*docs.columns).unionByName(out.join(again, "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id"]))
