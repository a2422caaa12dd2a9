"""Periodic runs of words, by Crochemore's partition refinement.

Places of a text are kept in classes of equal factors: at length q two places share a class when the q words from them are
equal. Going from q to q + 1, a class splits by the class of each place's successor; of the parts that a split leaves, only
the smaller ones need to split others at the next length, so that all lengths together touch O(n log n) places. A place
and its next class member q words on are a square of period q. Since every square that is no power of a shorter word shows
so, squares at consecutive places are one run, whose smallest period is q.

A slice of several texts is refined at once with numpy: classes never hold places of two texts, and each text ends in a
place of its own. A class is a segment of one array, its members are linked in order of place.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanveil.llm.runtime import trimmed
from spanveil.llm.words import group_bounds, pieces

RUN = "struct<start: bigint, length: bigint, period: bigint>"
SLICE = 2 << 20  # bytes of text that are refined at once; a longer text is a slice of its own
LEAST, TIMES = 24, 3
FEW = 24  # places that are refined one by one


def _spread(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[k], start[k] + 1, ... count[k] of them, for all k."""
    ends = np.cumsum(count)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - count), count)


class _Classes:
    """Places 0 to n - 1 in classes; codes give each place's first class."""

    def __init__(self, codes: np.ndarray, limit: np.ndarray):
        n = len(codes)
        self.limit = limit  # of each place: the longest period asked for, 0 at the ends of texts
        self.members = np.argsort(codes, kind="stable")  # segments of classes; members are in order of place only at first
        bounds = group_bounds(codes[self.members])
        count = np.diff(np.append(bounds, n))
        self.place = np.empty(n, np.int64)
        self.place[self.members] = np.arange(n)
        self.name = np.empty(n, np.int64)
        self.name[self.members] = np.repeat(np.arange(len(bounds)), count)
        self.start, self.size = np.zeros(n, np.int64), np.zeros(n, np.int64)  # by name; there are never more classes than places
        self.start[: len(bounds)], self.size[: len(bounds)] = bounds, count
        self.classes = len(bounds)
        self.next, self.before = np.full(n, -1), np.full(n, -1)
        self.moved = np.zeros(n, bool)
        self.waiting: dict[int, list[np.ndarray]] = {}  # distance -> places whose next member was so far on when they were noted
        self._link(self.members, self.name[self.members])
        self.small = np.arange(n)

    def _link(self, places: np.ndarray, groups: np.ndarray) -> None:
        """Neighbours in (group, place) order become neighbours of a class."""
        same = groups[1:] == groups[:-1]
        self.next[places] = np.append(np.where(same, places[1:], -1), -1)
        self.before[places] = np.insert(np.where(same, places[:-1], -1), 0, -1)
        self._note(places[:-1][same])

    def _note(self, places: np.ndarray) -> None:
        gap = self.next[places] - places
        keep = gap <= self.limit[places]
        places, gap = places[keep], gap[keep]
        if len(gap):
            order = np.argsort(gap, kind="stable")
            cut = group_bounds(gap[order])
            for g, own in zip(gap[order][cut].tolist(), np.split(places[order], cut[1:]), strict=True):
                self.waiting.setdefault(g, []).append(own)

    def squares(self, q: int) -> np.ndarray:
        """Places of squares of period q, in order; asked for when classes are those of length q."""
        noted = self.waiting.pop(q, None)
        if not noted:
            return np.zeros(0, np.int64)
        at = np.unique(np.concatenate(noted))
        return at[self.next[at] - at == q]

    def refine(self, q: int) -> None:
        """From length q to q + 1."""
        if len(self.small) <= FEW:
            self._refine_few(q)
            return
        own = self.small[self.small > 0]
        own = own[(self.limit[own - 1] > q) & (self.size[self.name[own - 1]] > 1)]
        split, by = self.name[own - 1], self.name[own]
        order = np.lexsort((own, by, split))
        split, by, own = split[order], by[order], own[order] - 1
        if not len(own):
            self.small = own
            return
        fresh = np.append(True, (split[1:] != split[:-1]) | (by[1:] != by[:-1]))
        first = np.flatnonzero(fresh)  # of each part
        count = np.diff(np.append(first, len(own)))
        parent = split[first]
        family = group_bounds(parent)  # of each class that is touched: its first part
        touched = np.add.reduceat(count, family)
        named = parent[family]
        rest = self.size[named] - touched
        whole = (rest == 0) & (np.diff(np.append(family, len(parent))) == 1)  # one part and nothing left: no split
        if whole.any():
            keep = ~np.repeat(whole, touched)
            own = own[keep]
            if not len(own):
                self.small = own
                return
            part_keep = ~np.repeat(whole, np.diff(np.append(family, len(parent))))
            count, parent, named, touched, rest = count[part_keep], parent[part_keep], named[~whole], touched[~whole], rest[~whole]
            first, family = np.cumsum(count) - count, group_bounds(parent)
        parts = np.diff(np.append(family, len(parent)))
        front = self.start[named]
        # the parts take the front of their class's segment
        target = _spread(front, touched)
        self.moved[own] = True
        out = self.members[target]
        out = out[~self.moved[out]]
        free = self.place[own]
        free = free[free >= np.repeat(front + touched, touched)]
        self.members[free], self.place[out] = out, free
        self.members[target], self.place[own] = own, target
        self.moved[own] = False
        # what stays is linked over the places that leave; family by family these stand in order of place
        staying = np.repeat(rest > 0, touched)
        if staying.any():
            self._unlink(own[staying], np.repeat(named, touched)[staying])
        # names: what stays keeps the name, else the last part does
        names = self.classes + np.arange(len(parent))
        last = np.append(family[1:], len(parent)) - 1
        emptied = rest == 0
        names[last[emptied]] = named[emptied]
        names[names >= self.classes] = self.classes + np.arange((names >= self.classes).sum())
        self.classes = max(self.classes, int(names.max()) + 1)
        self.start[named], self.size[named] = front + touched, rest
        self.start[names], self.size[names] = np.repeat(front, parts) + first - np.repeat(first[family], parts), count
        named_places = np.repeat(names, count)
        self.name[own] = named_places
        self._link(own, named_places)
        # all parts but the largest split others next
        largest = np.maximum.reduceat(count, family)
        by_rest = rest >= largest
        candidates = np.where(count == np.repeat(largest, parts), np.arange(len(parent)), len(parent))
        drop = np.minimum.reduceat(candidates, family)[~by_rest]
        use = np.ones(len(parent), bool)
        use[drop] = False
        small = [own[np.repeat(use, count)]]
        if (~by_rest & (rest > 0)).any():
            pick = ~by_rest & (rest > 0)
            small.append(self.members[_spread(front[pick] + touched[pick], rest[pick])])
        self.small = np.concatenate(small)

    def _refine_few(self, q: int) -> None:
        """The same one place at a time, which is faster for a few."""
        split: dict[int, dict[int, list[int]]] = {}
        for i in sorted(self.small.tolist()):
            if i and self.limit[i - 1] > q and self.size[d := self.name.item(i - 1)] > 1:
                split.setdefault(d, {}).setdefault(self.name.item(i), []).append(i - 1)
        small: list[int] = []
        for d, parts in split.items():
            rest = self.size.item(d) - sum(map(len, parts.values()))
            if not rest and len(parts) == 1:
                continue
            front = self.start.item(d)
            groups = sorted(parts.values(), key=len)
            for group in groups:
                for k, i in enumerate(group):
                    at, other = self.place.item(i), self.members.item(front + k)
                    self.members[at], self.place[other] = other, at
                    self.members[front + k], self.place[i] = i, front + k
                    if rest:
                        left, right = self.before.item(i), self.next.item(i)
                        if left >= 0:
                            self.next[left] = right
                            if right >= 0:
                                self._note_one(left, right - left)
                        if right >= 0:
                            self.before[right] = left
                name = self.classes if rest or group is not groups[-1] else d
                self.classes += name == self.classes
                self.start[name], self.size[name] = front, len(group)
                front += len(group)
                for i, before, after in zip(group, [-1, *group], [*group[1:], -1], strict=False):
                    self.name[i], self.before[i], self.next[i] = name, before, after
                    if after >= 0:
                        self._note_one(i, after - i)
            if rest:
                self.start[d], self.size[d] = front, rest
            largest = len(groups[-1])
            for group in groups[:-1] if largest > rest else groups:
                small += group
            if largest > rest:
                small += self.members[front : front + rest].tolist()
        self.small = np.array(small, np.int64)

    def _note_one(self, place: int, gap: int) -> None:
        if gap <= self.limit[place]:
            self.waiting.setdefault(gap, []).append(np.array([place]))

    def _unlink(self, places: np.ndarray, groups: np.ndarray) -> None:
        order = np.lexsort((places, groups))
        places = places[order]
        after, ahead = self.next[places], self.before[places]
        head = np.append(True, after[:-1] != places[1:])  # stretches of neighbours that leave together
        tail = np.append(head[1:], True)
        left, right = ahead[head], after[tail]
        some = left >= 0
        self.next[left[some]] = right[some]
        self.before[right[right >= 0]] = left[right >= 0]
        some &= right >= 0
        self._note(left[some])


def runs_of(codes: list[np.ndarray], least: int = LEAST, times: int = TIMES) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of the runs of each text, by start, then period; a text is the codes of its words.

    A run is a longest stretch of smallest period q and of max(least, times * q) words or more; times is 2 at least.
    """
    found: list[list[tuple[int, int, int]]] = [[] for _ in codes]
    length = np.array([len(x) for x in codes], np.int64)
    total = int(length.sum()) + len(codes)
    if not total:
        return found
    begin = np.cumsum(length + 1) - (length + 1)
    text = np.repeat(np.arange(len(codes)), length + 1)
    limit = np.repeat(np.where(length >= least, length // times, 0), length + 1)
    ends = begin + length
    limit[ends] = 0
    words = np.empty(total, np.int64)
    inside = np.ones(total, bool)
    inside[ends] = False
    words[inside] = np.concatenate(codes) if len(codes) else 0
    _, words[inside] = np.unique(words[inside], return_inverse=True)
    words[ends] = words[inside].max(initial=0) + 1
    one = text * (int(words.max()) + 1) + words  # words of two texts are never one class
    classes, q = _Classes(one, limit), 1
    while True:
        at = classes.squares(q)
        if len(at):
            first = np.flatnonzero(np.append(True, (at[1:] != at[:-1] + 1) | (text[at[1:]] != text[at[:-1]])))
            last = np.append(first[1:], len(at)) - 1
            size = at[last] - at[first] + 2 * q
            for k in np.flatnonzero(size >= max(least, times * q)):
                own = int(text[at[first[k]]])
                found[own].append((int(at[first[k]] - begin[own]), int(size[k]), q))
        if not len(classes.small):
            return [sorted(x, key=lambda r: (r[0], r[2])) for x in found]
        classes.refine(q)
        q += 1


def kept_words(n: int, runs: Iterable[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words stay when each run is cut to its first period."""
    out = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        out[start + period] += 1
        out[start + length] -= 1
    return np.cumsum(out[:n]) == 0


class _Codes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = code = len(self)
        return code


def _find(least: int, times: int, at: int):
    @trimmed
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in itertools.chain.from_iterable(pieces([b], b.schema.names[at], SLICE) for b in batches):
            words = [(x or "").encode().split() for x in batch.column(at).to_pylist()]
            known = _Codes()
            codes = [np.fromiter(map(known.__getitem__, w), np.int64, len(w)) for w in words]
            found = runs_of(codes, least, times)
            collapsed = [b" ".join(itertools.compress(w, kept_words(len(w), r).tolist()) if r else w).decode() for w, r in zip(words, found, strict=True)]
            fields = pa.array(list(itertools.chain.from_iterable(found)), pa.list_(pa.int64(), 3)).flatten().to_numpy(zero_copy_only=False).reshape(-1, 3)
            items = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(fields[:, k])) for k in range(3)], ["start", "length", "period"])
            offsets = pa.array(np.cumsum([0, *map(len, found)]), pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(map(len, words)), pa.int64()), pa.ListArray.from_arrays(offsets, items), pa.array(collapsed, pa.string())], names=[str(k) for k in range(batch.num_columns + 3)])

    return run


def find_runs(docs: DataFrame, column: str = "text", least: int = LEAST, times: int = TIMES) -> DataFrame:
    """Rows of docs with n_words, runs (start, length, period of word numbers, by start, then period) and collapsed.

    collapsed is the words, one blank between, without what repeats: a word goes if a run holds it after the run's first
    period. Words are runs of bytes other than 0x20 and 0x09 to 0x0D. Null and empty texts have no words, no runs and an
    empty collapsed. Repeated rows repeat, an empty table gives no rows; columns of docs called n_words, runs or
    collapsed give way. No shuffle: one task holds a text, or a slice of short ones.
    """
    if times < 2 or least < 1:
        raise ValueError("a run has at least two periods and one word")
    own = docs.drop("n_words", "runs", "collapsed")
    at = own.columns.index(column)
    numbered = own.toDF(*[str(k) for k in range(len(own.columns))])
    kinds = ", ".join(f"`{k}` {f.dataType.simpleString()}" for k, f in enumerate(own.schema.fields))
    out = numbered.mapInArrow(_find(least, times, at), f"{kinds}, `n_words` bigint, `runs` array<{RUN}>, `collapsed` string")
    return out.toDF(*own.columns, "n_words", "runs", "collapsed")


def strongest(runs: str) -> Column:
    """Of a column of runs, the one of most periods, exactly compared; of equal ones the first, then that of least period. Null if there is none."""
    more = lambda a, b: a["length"] * b["period"] > b["length"] * a["period"]
    return F.aggregate(runs, F.lit(None).cast(RUN), lambda best, r: F.when(best.isNull() | more(r, best), r).otherwise(best))
