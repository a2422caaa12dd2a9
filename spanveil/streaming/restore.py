"""Restoring values in streams of chunks, events and raw bytes: text that may still become a placeholder is held back.

Every stream is restored under its own mapping. Nothing is lost: what a stream holds back when it ends is let go as it is.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from spanveil.functions.jsontext import Tape, quote

# Keys of an event whose texts are restored.
EVENT_KEYS = ("content", "text", "reasoning_content", "reasoning", "refusal", "output_text", "delta", "arguments", "partial_json")
_SIGN = re.compile(r"<<[a-z_]+_[0-9]+>>")
_OPEN = re.compile(r"<(?:<(?:[a-z_]+(?:_[0-9]+>?)?)?)?\Z")
BATCH = 8 << 20  # characters of restored rows that go out at once
SIGN = 128  # characters of an unfinished sign that are remembered for counting
_FRAME_END = re.compile(rb"\r?\n\r?\n")


def _tree(keys: tuple[str, ...]) -> tuple[list[dict[str, int]], list[int], re.Pattern | None]:
    """Steps down by character, where each key ends, and what finds the first character of one."""
    down: list[dict[str, int]] = [{}]
    ends = []
    for key in keys:
        at = 0
        for c in key:
            if c not in down[at]:
                down[at][c] = len(down)
                down.append({})
            at = down[at][c]
        ends.append(at)
    return down, ends, re.compile(f"[{''.join(map(re.escape, down[0]))}]") if down[0] else None


FEW = 16  # keys of a mapping up to which its tree is remembered: short streams often have the same placeholders
_few = lru_cache(maxsize=64)(_tree)


class Matcher:
    """All keys of a mapping as one automaton: a character is a step down, whatever the number of keys."""

    def __init__(self, pairs: dict[str, str]):
        keys = tuple(k for k in pairs if k)
        self.down, ends, self.first = (_few if len(keys) <= FEW else _tree)(keys)
        self.value: list[str | None] = [None] * len(self.down)
        for key, at in zip(keys, ends, strict=True):
            self.value[at] = pairs[key]


class ChunkRestorer:
    """Replaces the longest key at a place; holds back an end that could still grow into a key or a longer one."""

    def __init__(self, pairs: dict[str, str] | Matcher, held: str = "", tail: str = ""):
        self.keys = pairs if isinstance(pairs, Matcher) else Matcher(pairs)
        self.held, self.tail, self.orphans = held, tail, 0  # tail: an unfinished sign in what has passed, for counting
        self.walked: tuple | None = None  # how far down the keys what is held has come: node, place, best place and its value

    def _pass(self, text: str, out: list[str]) -> None:
        """Text that no key stands in goes out; signs in it have nothing to stand for."""
        if not text:
            return
        out.append(text)
        if "<" not in text and not self.tail:
            return
        seen = self.tail + text
        self.orphans += len(_SIGN.findall(seen))
        unfinished = _OPEN.search(seen[-SIGN:])
        self.tail = unfinished[0] if unfinished else ""

    def feed(self, chunk: str, last: bool = False) -> str:
        held, out, at = self.held, [], 0
        text = held + chunk
        down, value, end, cut, first = self.keys.down, self.keys.value, len(text), False, self.keys.first
        walked, self.walked = self.walked, None
        while at < end:
            if walked:  # what is held back has been walked before
                node, here, best, found = walked
                walked = None
            else:
                start = first.search(text, at) if first else None
                if start is None:
                    self._pass(text[at:], out)
                    at = end
                    break
                begin = start.start()
                if begin > at:
                    self._pass(text[at:begin], out)
                at, node, here, best, found = begin, 0, begin, -1, None
            while here < end and (step := down[node].get(text[here])) is not None:
                node, here = step, here + 1
                if value[node] is not None:
                    best, found = here, value[node]
            if here == end and down[node]:
                if not last:
                    self.walked = node, here - at, best - at if best >= 0 else -1, found
                    break
                if best < 0 and not cut:
                    cut = True
                    self.orphans += 1  # the end is the beginning of a key
            if best >= 0:
                out.append(found)
                at, self.tail = best, ""
            else:
                self._pass(text[at : at + 1], out)
                at += 1
        self.held = text[at:]
        return "".join(out)


class Events:
    """The restorers of one stream of events, a buffer for each place, and what they hold."""

    def __init__(self, pairs: dict[str, str], state: str = "{}"):
        self.keys = Matcher(pairs)
        known = json.loads(state)
        self.at = {place: ChunkRestorer(self.keys, held, tail) for place, (held, tail, _) in known.items()}
        self.shape: dict[str, tuple[str, str]] = {place: tuple(shape) for place, (_, _, shape) in known.items() if shape}
        self.orphans = 0

    def state(self) -> str:
        return json.dumps({k: (r.held, r.tail, self.shape.get(k) if r.held else None) for k, r in self.at.items() if r.held or r.tail})

    def _line(self, line: str, names: list[str], last: bool) -> str:
        """A data line with its texts restored; all other bytes of it stay."""
        try:
            tape = Tape(line[5:])
        except ValueError:
            return line
        own = [i for i in range(len(tape.kind)) if tape.kind[i] == '"' and tape.key[i] in EVENT_KEYS]
        new, places = [], []
        for i in own:
            place = _place(tape, i)
            r = self.at.setdefault(place, ChunkRestorer(self.keys))
            new.append((i, r.feed(tape.string[i], last)))
            places.append(place)
        for i, place in zip(own, places, strict=True):
            if self.at[place].held:  # the event that would carry it, should nothing follow
                alone = Tape(tape.splice((j, "") for j in own if j != i))  # values keep their numbers
                self.shape[place] = ("\n".join([*names, f"data: {alone.text[: alone.start[i]].strip()}"]), alone.text[alone.stop[i] :])
        return line[:5] + tape.splice(new)

    def rest(self) -> list[str]:
        """Events with what is still held, place by place."""
        out = []
        for place, r in self.at.items():
            if r.held:
                before, after = self.shape[place]
                out.append(f"{before}{quote(r.feed('', True))}{after}")
        return out

    def frame(self, frame: str, last: bool = False) -> list[str]:
        """A frame restored, and before the end of the stream the events that let go what is held."""
        lines = frame.split("\n")
        names = [x.rstrip("\r") for x in lines if x.startswith("event:")]
        before = self.rest() if any(x.startswith("data:") and x[5:].strip() == "[DONE]" for x in lines) else []
        own = "\n".join(self._line(x, names, last) if x.startswith("data:") and x[5:].strip() not in ("", "[DONE]") else x for x in lines)
        return [*before, own, *(self.rest() if last else [])]

    def feed(self, frame: str, last: bool) -> tuple[str, int]:
        """What a frame becomes, and how many placeholders it leaves behind that nothing stands for."""
        out = "\n\n".join(self.frame(frame, last))
        return out, self.counted()

    def counted(self) -> int:
        n = sum(r.orphans for r in self.at.values())
        for r in self.at.values():
            r.orphans = 0
        return n


def _place(tape: Tape, i: int) -> str:
    """Where a text stands in its events: keys down to it, and the choice it belongs to."""
    keys, choice = [tape.key[i]], None
    while (i := tape.up[i]) >= 0:
        if tape.key[i] is not None:
            keys.append(tape.key[i])
        if choice is None and tape.kind[i] == "{":
            choice = next((tape.text[tape.start[k] : tape.stop[k]] for k in tape.items(i) if tape.key[k] == "index"), None)
    return f"{'.'.join(reversed(keys))}#{choice}"


class Bytes:
    """Events out of bytes that are cut anywhere, inside characters too."""

    def __init__(self, pairs: dict[str, str], state: str = "{}", pending: bytes = b""):
        self.events, self.pending = Events(pairs, state), bytearray(pending)

    def _frame(self, raw: bytes, last: bool = False) -> list[bytes]:
        return [x.encode("utf-8", "surrogateescape") for x in self.events.frame(raw.decode("utf-8", "surrogateescape"), last)]

    def feed(self, chunk: bytes, last: bool) -> tuple[bytes, int]:
        look, at, out = max(0, len(self.pending) - 3), 0, []  # an end of a frame may have begun before
        self.pending += chunk
        for end in _FRAME_END.finditer(self.pending, look):
            *before, own = self._frame(bytes(self.pending[at : end.start()]))
            out += [*(x + b"\n\n" for x in before), own, end[0]]
            at = end.end()
        self.pending = self.pending[at:]
        if last:
            rest = self._frame(bytes(self.pending), True) if self.pending else [*(x.encode("utf-8", "surrogateescape") for x in self.events.rest()), b""]
            out.append(b"\n\n".join(rest))
            self.pending = bytearray()
        return b"".join(out), self.events.counted()


def _fed(rows: pd.DataFrame, column: str, restorer) -> pd.DataFrame:
    done = [restorer.feed(_given(c, column), bool(e)) for c, e in zip(rows[column], rows["last"], strict=True)]
    if isinstance(restorer, ChunkRestorer):
        out, counts = done, [0] * len(done)
        if counts:
            counts[-1], restorer.orphans = restorer.orphans, 0
    else:
        out, counts = [x for x, _ in done], [n for _, n in done]
    return pd.DataFrame({"stream_id": rows.stream_id, "seq": rows.seq, "restored": pd.Series(out, dtype=object), "orphans": pd.Series(counts, dtype="int64")})


def _given(value, column: str):
    missing = value is None or isinstance(value, float)
    return (b"" if missing else bytes(value)) if column == "bytes" else ("" if missing else value)


def _walk(rows: Iterator[tuple], column: str, make) -> Iterator[tuple]:
    """(stream_id, seq, restored, orphans, last) of sorted rows; one is fed when the next has come, which says whether it was its stream's last."""
    stream, pairs, restorer, before, value = object(), {}, None, None, None
    plain = make is ChunkRestorer
    feed = None
    for own, given, seq, now, shown, original in rows:
        if own != stream and (own == own or stream == stream):  # of numbers that are none there is one stream
            if feed:
                yield (stream, before, feed(value, True), restorer.orphans, True) if plain else (stream, before, *feed(value, True), True)
            stream, pairs, feed = own, {}, None
        if not given:
            pairs[shown] = original
            continue
        if feed:
            yield (stream, before, feed(value, False), 0, False) if plain else (stream, before, *feed(value, False), False)
        else:
            restorer = make(pairs)
            feed = restorer.feed
        before, value = seq, now if type(now) is str else _given(now, column)
    if feed:
        yield (stream, before, feed(value, True), restorer.orphans, True) if plain else (stream, before, *feed(value, True), True)


def _values(c: pa.Array) -> list:
    """The values of an Arrow column; texts and whole numbers by way of arrays, which costs less."""
    t = c.type
    if pa.types.is_string(t) or pa.types.is_large_string(t) or not c.null_count and (pa.types.is_integer(t) or pa.types.is_boolean(t)):
        return c.to_numpy(zero_copy_only=False).tolist()
    return c.to_pylist()


def _restored(rows: DataFrame, pairs: DataFrame, column: str, make, glue: str | bytes | None = None) -> DataFrame:
    """A stream's mapping and rows come to one task in their order, many streams after one another: a task holds one mapping and a batch of rows.

    glue: a row for each whole stream, its restored rows joined by it.
    """
    kind, none = dict(rows.dtypes), F.lit(None).cast("string")
    given = rows.select("stream_id", F.lit(True).alias("given"), "seq", column, none.alias("shown"), none.alias("original"))
    known = pairs.select(F.col("stream_id").cast(kind["stream_id"]), F.lit(False).alias("given"), F.lit(0).cast(kind["seq"]).alias("seq"), F.lit(None).cast(kind[column]).alias(column), F.col("shown").cast("string"), F.col("original").cast("string"))
    both = given.union(known).repartition("stream_id").sortWithinPartitions("stream_id", "given", F.col("seq").asc_nulls_last())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        form: list[pa.DataType] = []

        def table() -> Iterator[tuple]:
            for batch in batches:
                form[:] = [batch.schema.field(k).type for k in ("stream_id", "seq", column)]
                yield from zip(*map(_values, batch.columns), strict=True)

        def made(out: list[tuple]) -> pa.RecordBatch:
            names, forms = (("stream_id", "seq", "restored", "orphans"), form) if glue is None else (("stream_id", "restored", "orphans"), (form[0], form[2]))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (*forms, pa.int64()), strict=True)], names)

        out, size, parts, count = [], 0, [], 0
        for stream, seq, restored, orphans, last in _walk(table(), column, make):
            size += len(restored) + 64
            if glue is None:
                out.append((stream, seq, restored, orphans))
            else:
                parts.append(restored)
                count += orphans
                if last:
                    out.append((stream, glue.join(parts), count))
                    parts, count = [], 0
            if size > BATCH and out:
                yield made(out)
                out, size = [], 0
        if out:
            yield made(out)

    of = f"stream_id {kind['stream_id']}, {'' if glue is not None else f'seq {kind["seq"]}, '}restored {kind[column]}, orphans long"
    return both.mapInArrow(run, of)


def restore_chunks(chunks: DataFrame, pairs: DataFrame, whole: bool = False) -> DataFrame:
    """Batch form: (stream_id, seq, chunk) and (stream_id, shown, original) -> the same rows with restored, and orphans on the stream's last.

    Orphans: signs that nothing stands for, and an end that is only the beginning of a key. whole: (stream_id, restored,
    orphans) of whole streams, a row each.
    """
    return _restored(chunks, pairs, "chunk", ChunkRestorer, "" if whole else None)


def restore_events(frames: DataFrame, pairs: DataFrame, whole: bool = False) -> DataFrame:
    """Batch form for events: (stream_id, seq, frame) and (stream_id, shown, original) -> restored frames and orphans in each.

    What a place holds back when [DONE] or the last frame comes goes out in an event of its own form, before [DONE]. Sum
    orphans by endpoint for the counter. whole: (stream_id, restored, orphans) of whole streams, a row each.
    """
    return _restored(frames, pairs, "frame", Events, "\n\n" if whole else None)


def restore_bytes(chunks: DataFrame, pairs: DataFrame, whole: bool = False) -> DataFrame:
    """Batch form for raw bytes of event streams: (stream_id, seq, bytes), cut anywhere -> restored bytes; a chunk that ends no event gives none.

    whole: (stream_id, restored, orphans) of whole streams, a row each.
    """
    return _restored(chunks, pairs, "bytes", Bytes, b"" if whole else None)


class _Stream(StatefulProcessor):
    """State of a stream: its mapping, and what its restorer holds; a timer lets that go when nothing more comes."""

    def __init__(self, column: str, timeout_ms: int):
        self.column, self.timeout_ms = column, timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pairs = handle.getMapState("pairs", "shown string", "original string")
        self.held = handle.getValueState("held", "state string, tail string, pending binary")

    def _restorer(self):
        pairs = {k[0]: v[0] for k, v in self.pairs.iterator()}
        state, tail, pending = self.held.get() if self.held.exists() else (None, "", b"")
        if self.column == "chunk":
            return ChunkRestorer(pairs, state or "", tail or "")
        return Events(pairs, state or "{}") if self.column == "frame" else Bytes(pairs, state or "{}", bytes(pending or b""))

    def _keep(self, r) -> None:
        state = r.held if self.column == "chunk" else (r if self.column == "frame" else r.events).state()
        self.held.update((state, getattr(r, "tail", ""), bytes(getattr(r, "pending", b""))))

    def _timers(self, timers, again: bool) -> None:
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at[0] if isinstance(at, tuple) else at)
        if again:
            self.handle.registerTimer(timers.getCurrentProcessingTimeInMs() + self.timeout_ms)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        self._map(initialState)

    def _map(self, rows: pd.DataFrame) -> None:
        for k, v in zip(rows["shown"], rows["original"], strict=True):
            self.pairs.updateValue((k,), (v,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        given = pd.concat(list(rows), ignore_index=True)
        if "shown" in given.columns:
            mapped = given["shown"].notna()
            self._map(given[mapped])
            given = given[~mapped]
        given = given.sort_values("seq", ignore_index=True)
        if len(given):
            r = self._restorer()
            yield _fed(given, self.column, r)
            if over := bool(given["last"].iloc[-1]):
                self.held.clear()
                self.pairs.clear()
            else:
                self._keep(r)
            self._timers(timerValues, not over)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        r = self._restorer()
        empty = pd.DataFrame({"stream_id": [key[0]], "seq": [-1], self.column: [None], "last": [True]})
        if isinstance(r, Events):
            out = "\n\n".join(r.rest())
            yield pd.DataFrame({"stream_id": [key[0]], "seq": [-1], "restored": [out], "orphans": [r.counted()]})
        else:
            yield _fed(empty, self.column, r)
        self.held.clear()
        self.pairs.clear()

    def close(self) -> None:
        pass


def restoring(rows: DataFrame, pairs: DataFrame | None = None, column: str = "chunk", timeout_ms: int = 600_000) -> DataFrame:
    """Streaming form: a stream of (stream_id string, seq long, chunk | frame | bytes, last boolean) -> (stream_id, seq, restored, orphans).

    Each stream has its own mapping: pairs (stream_id, shown, original), a static table, are those known at the start;
    later ones come as rows of the stream itself that have shown and original instead of a chunk, before or with the
    stream's first chunk. A row with last = true ends its stream; so does the timeout, after which a row with seq -1 has
    what was held. The state store must be RocksDB, which this sets for the session.
    """
    spark = rows.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    out = "binary" if column == "bytes" else "string"
    initial = None if pairs is None else pairs.select("stream_id", "shown", "original").groupBy("stream_id")
    return rows.groupBy("stream_id").transformWithStateInPandas(_Stream(column, timeout_ms), f"stream_id string, seq long, restored {out}, orphans long", "Append", "ProcessingTime", initial)


def joined(restored: DataFrame) -> DataFrame:
    """(stream_id, restored, orphans) of whole streams, their rows in order."""
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "restored"))), lambda x: x["restored"]), "")
    return restored.groupBy("stream_id").agg(whole.alias("restored"), F.sum("orphans").cast("long").alias("orphans"))
