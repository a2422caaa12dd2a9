"""Token counts by a compiled finite-state transducer.

A BPE model's merges are compiled into a deterministic machine over characters. The encoding of a prefix ends in exactly
one piece that may stand behind the piece before it; a pair of pieces may stand together when no merge across their
seam would have come before the merges that made them. A state therefore holds, for each place from which a piece may
still be open, the node of the pieces' trie, the piece that ends at that place, and its count relative to now; the next
character gives the next state. Transitions are annotated with the tokens that the character adds to the count (0 or
less where it makes pieces grow together). States and transitions are compiled as they are first met.

Where no piece holds two neighbouring characters, the machine stands in its start state whatever came before. So a chunk
of text is a map: what stands before its first such place is run from the incoming state, what follows is counted, and
the outgoing state is known. Maps compose associatively, and the chunks of a text are joined by a prefix scan.
"""

from __future__ import annotations

import functools
import math
import re
import struct
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanveil.llm.runtime import trimmed
from spanveil.llm.words import pieces

CHUNK = 1 << 16  # characters
STATES = 250_000  # states that a worker holds; beyond it compiling begins anew, counts are the same
WORDS = 400_000  # words whose counts a worker remembers; beyond it counting begins anew, counts are the same
BLANK = "▁"
_WORD = re.compile(" *[^ ]+| +")
NORMAL, USER_DEFINED, UNUSED, BPE = 1, 4, 5, 2


def read_fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
            continue
        size = varint() if key & 7 == 2 else {1: 8, 5: 4}[key & 7]
        yield key >> 3, data[at : at + size]
        at += size


def read_model(data: bytes) -> dict[str, float]:
    """Piece -> score, of a BPE model with byte fallback that leaves texts as they are but for a blank before them."""
    scores: dict[str, float] = {}
    trainer, normalizer = {}, {}
    for number, value in read_fields(data):
        if number == 1:
            piece = dict(read_fields(value))
            kind = piece.get(3, NORMAL)
            if kind == NORMAL:
                scores[piece[1].decode()] = struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0
            elif kind in (USER_DEFINED, UNUSED):
                raise ValueError("pieces defined by the user, or unused, aren't compiled")
        elif number == 2:
            trainer = dict(read_fields(value))
        elif number == 3:
            normalizer = dict(read_fields(value))
    if trainer.get(3) != BPE or not trainer.get(35):
        raise ValueError("only BPE models with byte fallback are compiled")
    if normalizer.get(2) or not normalizer.get(3, 1) or normalizer.get(4, 1) or not normalizer.get(5, 1) or trainer.get(24):
        raise ValueError("only models that leave texts as they are are compiled")
    return scores


class State(dict):
    """Character -> (next state, tokens added). places: (trie node, piece that ends where it begins, count there, relative), the root's first."""

    __slots__ = ("machine", "places")

    def __init__(self, machine: Transducer, places: tuple):
        super().__init__()
        self.machine, self.places = machine, places

    def __missing__(self, c: str) -> tuple[State, int]:
        self[c] = step = self.machine.compile(self, BLANK if c == " " else c)
        return step


class Words(dict):
    """Word without the blank before it -> tokens that the machine counts from its start state."""

    def __init__(self, machine: Transducer):
        super().__init__()
        self.machine = machine

    def __missing__(self, word: str) -> int:
        self[word] = n = self.machine.run(self.machine.start, f" {word}")[1]
        return n


@dataclass(frozen=True)
class ChunkMap:
    """head: text up to the first place where the state is known; inner: tokens after it; tail: the state at the end, None without such a place."""

    head: str
    inner: int
    tail: State | None


class Transducer:
    def __init__(self, model: bytes):
        scores = read_model(model)
        order = {s: i for i, s in enumerate(sorted(set(scores.values()), reverse=True))}
        self.rank = {p: order[s] for p, s in scores.items()}
        self.trie: list[dict[str, int]] = [{}]
        self.piece: list[str | None] = [None]
        self.near: set[str] = set()  # pairs of characters that stand side by side in a piece
        for p in scores:
            at = 0
            for c in p:
                if c not in self.trie[at]:
                    self.trie[at][c] = len(self.trie)
                    self.trie.append({})
                    self.piece.append(None)
                at = self.trie[at][c]
            self.piece[at] = p
            self.near.update(map("".join, zip(p, p[1:], strict=False)))
        self.near = {y for x in self.near for y in self._spelt(x)}
        self.words_apart = not any(x[1] == BLANK and x[0] != BLANK for x in self.near if x[0] != " ")
        self.known_words = Words(self)
        self.split = functools.cache(self._split)
        self.may_follow = functools.cache(self._may_follow)
        self.restart()

    @staticmethod
    def _spelt(pair: str) -> list[str]:
        """A pair as texts may write it: with a blank for the blank's sign."""
        a, b = ([c, " "] if c == BLANK else [c] for c in pair)
        return [x + y for x in a for y in b]

    def restart(self) -> None:
        self.states: dict[tuple, State] = {}
        self.start = self._state(((0, None, 0),))

    def _state(self, places: tuple) -> State:
        got = self.states.get(places)
        if got is None:
            got = self.states[places] = State(self, places)
        return got

    def _split(self, piece: str) -> tuple[str, str] | None:
        """The last merge that makes a piece from its characters: best score first, from the left; None if merges don't make it."""
        parts, last = list(piece), None
        while len(parts) > 1:
            best, at = min(((self.rank.get(parts[i] + parts[i + 1], math.inf), i) for i in range(len(parts) - 1)))
            if best == math.inf:
                return None
            last = parts[at], parts[at + 1]
            parts[at : at + 2] = ["".join(last)]
        return last

    def _may_follow(self, left: str, right: str) -> bool:
        """Whether the encoding of left + right is these two: merges are undone from the last on, and no merge across the seam may come before one undone."""
        limit = math.inf
        while True:
            across = self.rank.get(left + right)
            if across is not None and 2 * across < limit:
                return False
            a = self.rank[left] if len(left) > 1 else -1
            b = self.rank[right] if len(right) > 1 else -1
            if a > b:
                limit, left = 2 * a, self.split(left)[1]
            elif b >= 0:  # of equal merges the left one comes first
                limit, right = 2 * b + 1, self.split(right)[0]
            else:
                return True

    def compile(self, state: State, c: str) -> tuple[State, int]:
        places = state.places
        last = places[0][1]
        if last is not None and last[-1] + c not in self.near:
            places = self.start.places  # no piece holds both characters
        if c not in self.trie[0]:
            return self.start, len(c.encode())  # bytes, which no piece grows over
        grown, piece, count = [], None, 0
        for node, before, n in places:
            to = self.trie[node].get(c)
            if to is None:
                continue
            own = self.piece[to]
            if piece is None and own is not None and (len(own) == 1 or self.split(own)) and (before is None or self.may_follow(before, own)):
                piece, count = own, n + 1
            if self.trie[to]:
                grown.append((to, before, n))
        if len(self.states) > STATES:
            self.restart()
        return self._state(((0, piece, 0), *((to, before, n - count) for to, before, n in grown))), count

    def run(self, state: State, text: str) -> tuple[State, int]:
        n = 0
        for c in text:
            state, more = state[c]
            n += more
        return state, n

    def known(self, text: str) -> int:
        """The first place of text, after its first character, where the state is that of the start; -1 if there is none."""
        near = self.near
        return next((i for i in range(1, len(text)) if text[i - 1 : i + 1] not in near), -1)

    def chunk_map(self, text: str) -> ChunkMap:
        at = self.known(text)
        if at < 0:
            return ChunkMap(text, 0, None)
        tail, inner = self.run_words(text[at:])
        return ChunkMap(text[:at], inner, tail)

    def run_words(self, text: str) -> tuple[State, int]:
        """run() from the start state; where blanks are certain places, a word's map is made once and its count taken from then on.

        A word is blanks and what follows up to the next blank: no piece holds a blank behind another character, so the
        machine stands in its start state before every word.
        """
        if not self.words_apart or BLANK in text:
            return self.run(self.start, text)
        if "  " in text:  # blanks in a row belong together
            words = [w[1:] if w[0] == " " else w for w in _WORD.findall(text if text[0] == " " else f" {text}")]
            head = None if text[0] == " " else words.pop(0)
        else:
            head, *words = text.split(" ")
        state, n = self.run(self.start, head) if head else (self.start, 0)
        if words:
            if len(self.known_words) > WORDS:
                self.known_words.clear()
            n += sum(map(self.known_words.__getitem__, words))
            state = self.run(self.start, f" {words[-1]}")[0]
        return state, n

    def compose(self, a: ChunkMap, b: ChunkMap) -> ChunkMap:
        """The map of two chunks, one after the other."""
        if a.tail is None:
            return ChunkMap(a.head + b.head, b.inner, b.tail)
        state, n = self.run(a.tail, b.head)
        return ChunkMap(a.head, a.inner + n + b.inner, state if b.tail is None else b.tail)

    def scan(self, maps: list[ChunkMap]) -> ChunkMap:
        """Composition of all maps, in pairs as a parallel scan would."""
        while len(maps) > 1:
            maps = [self.compose(maps[i], maps[i + 1]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        return maps[0]

    def count(self, text: str, chunk: int = CHUNK) -> int:
        if not text:
            return 0
        text = BLANK + text
        whole = self.scan([self.chunk_map(text[i : i + chunk]) for i in range(0, len(text), chunk)])
        return self.run(self.start, whole.head)[1] + whole.inner


@functools.lru_cache(maxsize=1)
def _machine(model: bytes) -> Transducer:
    """A worker's tasks share what is compiled."""
    return Transducer(model)


def _count(model: bytes, limit: int):
    @trimmed
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _machine(model)
        for batch in pieces(batches):
            text = batch.column("text")
            size = pc.fill_null(pc.binary_length(text), 0).cast(pa.int64())
            n = [machine.count(x or "") for x in text.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), size, pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return run


def count_tokens(docs: DataFrame, model_path: str, limit: int = 4096) -> DataFrame:
    """Rows of docs (doc_id, text) with UTF-8 bytes, tokens, and whether they are over the limit.

    Null and empty texts have 0 tokens. Repeated rows repeat, ids may be null and of any type, an empty table gives no
    rows, other columns are left out. The model is read on the driver and sent along (half a MB); one that isn't BPE
    with byte fallback over unchanged texts is refused.
    """
    with open(model_path, "rb") as f:
        model = f.read()
    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", F.col("text")).mapInArrow(_count(model, limit), f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
