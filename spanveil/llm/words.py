"""Words of whole texts as 64-bit fingerprints, from Arrow buffers with numpy.

A word is a run of bytes other than 0x20 and 0x09 to 0x0D; A-Z count as a-z.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
WHITE = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
CHUNK = 1 << 19


def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection of 64-bit values whose output bits all depend on all input bits."""
    h = h + U((0x9E3779B97F4A7C15 * (salt + 1)) & 0xFFFFFFFFFFFFFFFF)
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
INK = np.ones(256, dtype=bool)
INK[list(WHITE)] = False
_CODE = mix(_LOWER.astype(U), 7)
_BASE = 0x9E3779B97F4A7C15 | 1
_powers = [np.ones(1, dtype=U), np.ones(1, dtype=U)]


def _grow(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2^64, and of its inverse."""
    if len(_powers[0]) < n:
        inverse = pow(_BASE, -1, 1 << 64)
        for k, base in enumerate((_BASE, inverse)):
            have = _powers[k]
            while len(have) < n:
                have = np.concatenate([have, have * U(pow(base, len(have), 1 << 64))])
            _powers[k] = have
    return _powers[0], _powers[1]


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and len + 1 offsets into them; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, dtype=np.int64)
    data = column.buffers()[2] if len(column) else None
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


@dataclass
class Words:
    raw: np.ndarray  # bytes of all texts
    start: np.ndarray  # first byte of each word
    stop: np.ndarray  # one past its last byte
    code: np.ndarray  # fingerprint of the lower-cased word
    doc: np.ndarray  # row of its text
    rows: int


def split_words(column: pa.Array) -> Words:
    raw, offsets = text_buffer(column)
    starts, stops, codes = [], [], []
    lo, end = 0, len(raw)
    while lo < end:
        hi = min(lo + CHUNK, end)
        if hi < end:  # cut where a word ends, so that no word lies in two chunks
            back = np.flatnonzero(~INK[raw[lo:hi]])
            while not len(back) and hi < end:
                wider = min(hi + CHUNK, end)
                back = np.flatnonzero(~INK[raw[hi:wider]])[:1] + (hi - lo)
                hi = wider
            hi = lo + int(back[-1]) + 1 if len(back) else end
        part = raw[lo:hi]
        n = len(part)
        ink = INK[part]
        fresh = np.zeros(n + 1, dtype=bool)
        inside = offsets[np.searchsorted(offsets, lo) : np.searchsorted(offsets, hi, "right")] - lo
        fresh[inside] = True
        fresh[0] = True
        before = np.empty(n, dtype=bool)
        before[0] = False
        before[1:] = ink[:-1]
        s = np.flatnonzero(ink & (~before | fresh[:-1]))
        after = np.empty(n, dtype=bool)
        after[-1] = False
        after[:-1] = ink[1:]
        e = np.flatnonzero(ink & (~after | fresh[1:])) + 1
        up, down = _grow(n + 1)
        total = np.zeros(n + 1, dtype=U)
        np.cumsum(_CODE[part] * up[:n], out=total[1:])
        starts.append(s + lo)
        stops.append(e + lo)
        codes.append(mix((total[e] - total[s]) * down[s] + (e - s).astype(U) * U(0xD6E8FEB86659FD93)))
        lo = hi
    if not starts:
        none = np.zeros(0, dtype=np.int64)
        return Words(raw, none, none, none.astype(U), none, len(offsets) - 1)
    start, stop = np.concatenate(starts), np.concatenate(stops)
    return Words(raw, start, stop, np.concatenate(codes), np.searchsorted(offsets, start, "right") - 1, len(offsets) - 1)


def lowered(raw: np.ndarray) -> np.ndarray:
    return _LOWER[raw]


def pieces(batches: Iterable[pa.RecordBatch], column: str = "text", most: int = 4 << 20, rows: int = 2048) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of bounded bytes (one row at least), so that memory follows the slice and not the batch."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        upto = np.cumsum(size)
        at = 0
        while at < batch.num_rows:
            base = upto[at - 1] if at else 0
            to = min(max(int(np.searchsorted(upto, base + most, "right")), at + 1), at + rows, batch.num_rows)
            yield batch.slice(at, to - at)
            at = to


def group_bounds(sorted_keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys starts."""
    if not len(sorted_keys):
        return np.zeros(0, dtype=np.int64)
    return np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]]))


def slice_name(turn: int, *parts: np.ndarray) -> int:
    """A name for the turn-th slice of this task: its place and its content, so that equal slices of a table differ.

    A task that runs again over the same rows gives the same name; over other rows it gives another, and what was
    counted under the first is not mixed with it.
    """
    from pyspark import TaskContext

    context = TaskContext.get()
    place = np.array([(context.partitionId() if context else 0) << 24 | turn], dtype=U)
    content = sum((int(mix(x.astype(np.int64).view(U), k).sum()) for k, x in enumerate(parts)), 0) & 0xFFFFFFFFFFFFFFFF
    return int(mix(mix(place, 21) ^ U(content), 22).astype(np.int64)[0])


def task_slice(turn: int) -> int:
    """A name for the turn-th slice of this task: unique in its job. Slices must be written before they are named again."""
    from pyspark import TaskContext

    context = TaskContext.get()
    return (context.partitionId() if context else 0) << 32 | turn
