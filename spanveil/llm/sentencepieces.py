"""SentencePiece ids of whole texts and texts of ids, by a table of distinct marked words.

No piece of the model holds a whitespace marker behind another character, so no merge crosses from a word to the marker of
the next: a text is cut before each run of markers, and every distinct marked word is segmented once, wherever it stands.

A slice of texts becomes a dictionary of its distinct words and, for each text, its words' places in that dictionary. The
dictionaries go to the buckets of their words' hashes, where equal words of all slices meet and are segmented once; their
ids return to the slices and are joined to the places. Texts themselves aren't shuffled, and a word that stands everywhere
is one row's entry for each slice.
"""

from __future__ import annotations

import functools
import heapq
import math
import re
import struct
import zlib
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanveil.llm.runtime import bucketed, parts, trimmed
from spanveil.llm.tokencount import BLANK, read_fields, read_model
from spanveil.llm.words import pieces, task_slice

SLICE = 16 << 20  # bytes of text in a slice
BUCKETS = 1024  # a slice sends a row to each bucket that has a word of it, whatever the size of the input
WORDS = 1 << 19  # words of a bucket that a worker remembers; beyond it, a word may be segmented again
SHORT = 64  # characters up to which a word's merges are found by looking at all of them
NONE = -math.inf
UNKNOWN, CONTROL, BYTE = 2, 3, 6
SURFACE = " ⁇ "  # what the library writes for an unknown id unless the model says otherwise


class Segmenter:
    """Ids of marked words, and text of ids."""

    def __init__(self, model: bytes):
        self.scores = read_model(model)
        if any(BLANK in p.lstrip(BLANK) for p in self.scores):
            raise ValueError("a piece of this model crosses a whitespace marker")
        kinds, self.surface = read_pieces(model)
        self.ids = {p: k for k, (p, kind) in enumerate(kinds) if p in self.scores and kind not in (UNKNOWN, CONTROL, BYTE)}
        self.bytes = [0] * 256
        for k, (p, kind) in enumerate(kinds):
            if kind == BYTE:
                self.bytes[int(p[3:5], 16)] = k
        self.raw = [bytes([int(p[3:5], 16)]) if kind == BYTE else b"" if kind == CONTROL else self.surface.encode() if kind == UNKNOWN else p.replace(BLANK, " ").encode() for p, kind in kinds]
        self.control = {k for k, (_, kind) in enumerate(kinds) if kind == CONTROL}
        self.is_byte = [kind == BYTE for _, kind in kinds]
        self.marked = [kind not in (BYTE, CONTROL, UNKNOWN) and p.startswith(BLANK) for p, kind in kinds]
        # a line's end is cut off too where no piece holds it next to another character, so that lines share words
        self.line = not any("\n" in p and len(p) > 1 for p in self.scores)
        self.cut = re.compile(r"\n[^ \n]*| *[^ \n]+| +" if self.line else " *[^ ]+| +")

    def words(self, text: str) -> list[str]:
        """The marked words of a text, a leading blank left out of each; words that begin with a line's end have none."""
        if not text:
            return []
        text = text.replace(BLANK, " ")
        plain = text.replace("\n", " \n") if self.line else text
        if "  " not in plain and plain[0] != " ":
            return plain.split(" ")
        return [w[1:] if w[0] == " " else w for w in self.cut.findall(f" {text}")]

    def segment(self, word: str) -> list[int]:
        """Ids of a word as words() gives it: the neighbours that make the best piece merge first, the leftmost of equals."""
        word = (word if self.line and word[:1] == "\n" else f" {word}").replace(" ", BLANK)
        part = self._short(word) if len(word) <= SHORT else self._long(word)
        out: list[int] = []
        for p in part:
            known = self.ids.get(p)
            out += [known] if known is not None else [self.bytes[b] for b in p.encode()]
        return out

    def _short(self, word: str) -> list[str]:
        part, scores = list(word), self.scores
        have = [scores.get(x + y, NONE) for x, y in zip(part, word[1:], strict=False)]
        while have:
            best = max(have)
            if best == NONE:
                break
            i = have.index(best)
            part[i : i + 2] = [part[i] + part[i + 1]]
            del have[i]
            if i:
                have[i - 1] = scores.get(part[i - 1] + part[i], NONE)
            if i < len(have):
                have[i] = scores.get(part[i] + part[i + 1], NONE)
        return part

    def _long(self, word: str) -> list[str]:
        """The same with a heap: n log n steps."""
        part, scores, n = list(word), self.scores, len(word)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[float, int, int, str]] = []

        def offer(i: int, j: int) -> None:
            if (score := scores.get(both := part[i] + part[j])) is not None:
                heapq.heappush(heap, (-score, i, j, both))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            _, i, j, both = heapq.heappop(heap)
            if j >= n or part[i] + part[j] != both or after[i] != j or not part[j]:
                continue
            part[i], part[j] = both, ""
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                offer(i, k)
            if before[i] >= 0:
                offer(before[i], i)
        return [p for p in part if p]

    def text(self, ids: list[int]) -> str:
        """The text of ids: the first piece's marker goes, bytes make characters, and those that don't make any become U+FFFD."""
        for lead, i in enumerate(ids):
            if self.raw[i]:
                break
        else:
            return ""
        raw = b"".join(map(self.raw.__getitem__, ids))
        cut = int(self.marked[ids[lead]])
        try:
            if self.control.isdisjoint(ids):  # else bytes on both sides of one could make a character
                return raw[cut:].decode()
        except UnicodeDecodeError:
            pass
        out, run = [], bytearray()
        for i in [*ids, None]:
            if i is not None and self.is_byte[i]:
                run += self.raw[i]
                continue
            if run:
                out.append(_lenient(bytes(run)))
                run.clear()
            if i is not None:
                out.append(self.raw[i].decode())
        return "".join(out)[cut:]


def _lenient(raw: bytes) -> str:
    out, at = [], 0
    while at < len(raw):
        for n in (1, 2, 3, 4):
            try:
                out.append(raw[at : at + n].decode())
                break
            except UnicodeDecodeError:
                continue
        else:
            n = 1
            out.append("�")
        at += n
    return "".join(out)


def read_pieces(model: bytes) -> tuple[list[tuple[str, int]], str]:
    """(piece, kind) by id, and what an unknown id is written as."""
    kinds, surface = [], SURFACE
    for number, value in read_fields(model):
        if number == 1:
            piece = dict(read_fields(value))
            kinds.append((piece[1].decode(), piece.get(3, 1)))
        elif number == 2:
            surface = dict(read_fields(value)).get(44, surface.encode()).decode()
    return kinds, surface


@functools.lru_cache(maxsize=1)
def _segmenter(model: bytes) -> Segmenter:
    return Segmenter(model)


class _Places(dict):
    def __missing__(self, word: str) -> int:
        self[word] = place = len(self)
        return place


def _slices(batches: Iterable[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """Batches, gathered to slices of bounded bytes."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in pieces(batches):
        if held and size + batch.nbytes > SLICE:
            yield held
            held, size = [], 0
        held.append(batch)
        size += batch.nbytes
    if held:
        yield held


def _pack(*parts: bytes) -> bytes:
    """Parts in one compressed value."""
    raw = struct.pack(f"<{len(parts)}q", *map(len, parts)) + b"".join(parts)
    return struct.pack("<qq", len(parts), len(raw)) + pa.compress(raw, "zstd", asbytes=True)


def _unpack(packed: bytes) -> list[bytes]:
    n, size = struct.unpack_from("<qq", packed)
    raw = pa.decompress(packed[16:], size, "zstd", asbytes=True)
    ends = np.cumsum(struct.unpack_from(f"<{n}q", raw)) + 8 * n
    return [raw[a:b] for a, b in zip([8 * n, *ends[:-1]], ends, strict=True)]


def _planes(values: np.ndarray) -> bytes:
    """32-bit numbers byte by byte, lowest first: small ones compress."""
    return np.ascontiguousarray(values.astype("<i4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _numbers(planes: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, -1).T).view("<i4").ravel().astype(np.int64)


def _deal(model: bytes):
    """Texts (doc_id, text) -> rows of a slice: its words' buckets (turn -1), its texts' places (turn 0 and on), and its words by bucket.

    Words are numbered as they first appear in the slice; a place is 0 for the next new word, else the word's number and 1.
    """

    @trimmed
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = _segmenter(model).words
        for number, held in enumerate(_slices(batches)):
            known, name, out = _Places(), task_slice(number), []
            for turn, batch in enumerate(held):
                before, lengths, all_words = len(known), [], []
                for text in batch.column("text").to_pylist():
                    words = cut(text or "")
                    lengths.append(len(words))
                    all_words += words
                at = np.fromiter(map(known.__getitem__, all_words), np.int32, len(all_words))
                new = at > np.maximum.accumulate(np.append(before - 1, at))[:-1]
                out.append((turn, batch.column("doc_id"), _pack(_planes(np.array(lengths, np.int32)), _planes(np.where(new, 0, at + 1)))))
            words = list(known)
            bucket = np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in words), np.int64, len(words)) % BUCKETS
            kind = held[0].column("doc_id").type
            out.append((-1, pa.nulls(0, kind), _pack(_planes(bucket))))
            ids = pa.chunked_array([x for _, x, _ in out]).combine_chunks()
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(x) for _, x, _ in out)]), pa.int32()), ids)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(out), pa.int64()), pa.array([t for t, _, _ in out], pa.int32()), lists, pa.nulls(len(out), pa.int32()), pa.array([x for _, _, x in out], pa.binary())], names=DEALT)
            order = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[order], np.arange(BUCKETS + 1))
            full = np.flatnonzero(np.diff(cuts))
            sent = []
            for k in full.tolist():
                own = [words[j] for j in order[cuts[k] : cuts[k + 1]].tolist()]
                sent.append(_pack(_planes(np.fromiter(map(len, own), np.int32, len(own))), "".join(own).encode()))
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(full), pa.int64()), pa.nulls(len(full), pa.int32()), pa.nulls(len(full), pa.list_(kind)), pa.array(full, pa.int32()), pa.array(sent, pa.binary())], names=DEALT)

    return run


DEALT = ["slice", "turn", "ids", "bucket", "packed"]


def _segment(model: bytes):
    """(slice, bucket, words) -> (slice, bucket, how many ids each word has, and the ids)."""

    @trimmed
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment, now, known = _segmenter(model).segment, None, {}
        for batch in batches:
            out = []
            for bucket, packed in zip(batch.column("bucket").to_pylist(), batch.column("packed").to_pylist(), strict=True):
                if bucket != now or len(known) > WORDS:
                    now, known = bucket, {}
                sizes, text = _unpack(packed)
                text, own, at = text.decode(), [], 0
                for n in _numbers(sizes).tolist():
                    w = text[at : at + n]
                    at += n
                    got = known.get(w)
                    if got is None:
                        got = known[w] = segment(w)
                    own.append(got)
                out.append(_pack(_planes(np.fromiter(map(len, own), np.int32, len(own))), _planes(np.fromiter(chain.from_iterable(own), np.int32))))
            yield pa.RecordBatch.from_arrays([batch.column("slice"), batch.column("bucket"), pa.array(out, pa.binary())], names=["slice", "bucket", "found"])

    return run


def _join(texts: pa.Table, found: pa.Table) -> pa.Table:
    """A slice's texts (turn, ids, packed places) and its words' ids -> (doc_id, ids)."""
    parts = [_unpack(x) for x in found.sort_by("bucket")["found"].to_pylist()]
    ids = np.concatenate([np.zeros(0, np.int64), *(_numbers(x[1]) for x in parts)]).astype(np.int32)
    count = np.concatenate([np.zeros(0, np.int64), *(_numbers(x[0]) for x in parts)])
    start = np.cumsum(count) - count
    texts = texts.sort_by("turn")
    kind = texts.schema.field("ids").type.value_type
    out, by_number, new = [], None, 0
    for turn, doc_ids, packed in zip(texts["turn"].to_pylist(), texts["ids"], texts["packed"].to_pylist(), strict=True):
        if turn < 0:  # words by number -> as they stand by bucket
            order = np.argsort(_numbers(_unpack(packed)[0]), kind="stable")
            by_number = np.empty(len(order), np.int64)
            by_number[order] = np.arange(len(order))
            continue
        lengths, places = map(_numbers, _unpack(packed))
        fresh = places == 0
        places = by_number[np.where(fresh, new + np.cumsum(fresh), places) - 1]
        new += int(fresh.sum())
        n = count[places]
        ends = np.append(0, np.cumsum(n))
        flat = ids[np.arange(ends[-1]) + np.repeat(start[places] - ends[:-1], n)]
        offsets = ends[np.append(0, np.cumsum(lengths))]
        out.append(pa.RecordBatch.from_arrays([doc_ids.values, pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat))], names=["doc_id", "ids"]))
    return pa.Table.from_batches(out, pa.schema([("doc_id", kind), ("ids", pa.list_(pa.int32()))]))


def encode(docs: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, ids array<int>) of docs (doc_id, text): the ids that the library gives, without begin and end.

    A null or empty text has no ids. Repeated rows repeat, ids of documents may be null and of any type, an empty table gives
    no rows, other columns are left out. The model is read on the driver and sent along (half a MB); a model that isn't BPE
    with byte fallback over unchanged texts, or one with a piece across a whitespace marker, is refused. What a task holds: a
    slice (16 MB of texts, or one text), or a bucket's row.
    """
    spark, model = docs.sparkSession, _read(model_path)
    kind = dict(docs.dtypes)["doc_id"]
    dealt = docs.select("doc_id", "text").mapInArrow(_deal(model), f"slice long, turn int, ids array<{kind}>, bucket int, packed binary")
    dealt = bucketed(dealt, "slice", parts(spark, docs.select("doc_id", "text")))  # texts lie by slice already when the ids return
    words = dealt.where("bucket IS NOT NULL").select("slice", "bucket", "packed").repartition("bucket").sortWithinPartitions("bucket")
    found = words.mapInArrow(_segment(model), "slice long, bucket int, found binary")
    texts = dealt.where("turn IS NOT NULL").select("slice", "turn", "ids", "packed")
    return texts.groupBy("slice").cogroup(found.groupBy("slice")).applyInArrow(_join, f"doc_id {kind}, ids array<int>")


def _decode(model: bytes, at: int):
    @trimmed
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text = _segmenter(model).text
        for batch in batches:
            ids = batch.column(at)
            values, offsets = ids.values.to_numpy(zero_copy_only=False), ids.offsets.to_numpy()
            said = [text(values[a:b].tolist()) if there else None for a, b, there in zip(offsets, offsets[1:], ids.is_valid().to_pylist(), strict=False)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(said, pa.string())], names=[str(k) for k in range(batch.num_columns + 1)])

    return run


def decode(rows: DataFrame, model_path: str, column: str = "ids", into: str = "decoded") -> DataFrame:
    """rows with the text of the ids in a column, as the library decodes it; null for null. A column called as the new one gives way."""
    own = rows.drop(into) if into != column else rows
    numbered = own.toDF(*map(str, range(len(own.columns))))
    kinds = ", ".join(f"`{k}` {f.dataType.simpleString()}" for k, f in enumerate(own.schema.fields))
    return numbered.mapInArrow(_decode(_read(model_path), own.columns.index(column)), f"{kinds}, `{len(own.columns)}` string").toDF(*own.columns, into)


def _read(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()
