"""JSON texts as flat lists of values with their offsets, and writing by splices.

A body is read once, without recursion, so its depth doesn't matter; what is written back is the body itself with some of
its strings exchanged. Numbers, blanks, escapes and repeated keys stay as they were written.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable
from decimal import Decimal
from json.decoder import scanstring

_BLANK = re.compile(r"[ \t\n\r]*")
_SCALAR = re.compile(r"(?:-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?|true|false|null)(?![0-9A-Za-z.+-])")
_OPEN, _CLOSE = re.compile(r"\[+"), re.compile(r"\]+")
_HALF = re.compile("[\ud800-\udfff]")
VALUE, FIRST_VALUE, KEY, FIRST_KEY, NEXT = range(5)  # what may come


class Tape:
    """The values of a JSON text in the order in which they begin; a value's parts follow it, up to last.

    kind: { [ " for objects, lists and strings, v for others. string: a string's value, or what the object's "type" says.
    parts: how many values an object or list holds; nth: a value's place among those.
    """

    __slots__ = ("kind", "start", "stop", "key", "up", "last", "string", "parts", "nth", "text")

    def __init__(self, text: str):
        self.text = text
        self.kind, self.start, self.stop, self.key, self.up, self.last, self.string, self.parts, self.nth = ([] for _ in range(9))
        self._read(text)

    def _add(self, kind: str, start: int, stop: int, key: str | None, up: int, string: str | None) -> int:
        self.kind.append(kind)
        self.start.append(start)
        self.stop.append(stop)
        self.key.append(key)
        self.up.append(up)
        self.last.append(len(self.kind))
        self.string.append(string)
        self.parts.append(0)
        self.nth.append(self.parts[up] if up >= 0 else 0)
        if up >= 0:
            self.parts[up] += 1
        return len(self.kind) - 1

    def _open(self, start: int, stop: int, key: str | None, up: int) -> int:
        """Lists that begin one right after another, each the first part of the one before."""
        n, first = stop - start, self._add("[", start, 0, key, up, None)
        self.kind += ["["] * (n - 1)
        self.start += range(start + 1, stop)
        self.stop += [0] * (n - 1)
        self.key += [None] * (n - 1)
        self.up += range(first, first + n - 1)
        self.last += range(first + 2, first + n + 1)
        self.string += [None] * (n - 1)
        self.parts[first:] = [1] * (n - 1) + [0]
        self.nth += [0] * (n - 1)
        return first + n - 1

    def _read(self, text: str) -> None:
        at, end, up, key, need = 0, len(text), -1, None, VALUE
        while True:
            at = _BLANK.match(text, at).end()
            if at == end:
                raise ValueError("the text ends within a value")
            c = text[at]
            if need == NEXT:
                if c == ",":
                    at, need = at + 1, KEY if self.kind[up] == "{" else VALUE
                    continue
                if c != ("}" if self.kind[up] == "{" else "]"):
                    raise ValueError(f"no comma or end at {at}")
            elif need in (KEY, FIRST_KEY):
                if c == '"':
                    key, at = scanstring(text, at + 1, True)
                    at = _BLANK.match(text, at).end()
                    if text[at : at + 1] != ":":
                        raise ValueError(f"no colon at {at}")
                    at, need = at + 1, VALUE
                    continue
                if c != "}" or need == KEY:
                    raise ValueError(f"no key at {at}")
            elif c == "[" and text.startswith("[", at + 1):
                stop = _OPEN.match(text, at).end()
                up, key, at, need = self._open(at, stop, key, up), None, stop, FIRST_VALUE
                continue
            elif c == "{" or c == "[":
                up, key, at, need = self._add(c, at, 0, key, up, None), None, at + 1, FIRST_KEY if c == "{" else FIRST_VALUE
                continue
            elif c != "]" or need == VALUE:
                if c == '"':
                    value, stop = scanstring(text, at + 1, True)
                    self._add(c, at, stop, key, up, value)
                    if key == "type" and up >= 0:
                        self.string[up] = value
                else:
                    if not (m := _SCALAR.match(text, at)):
                        raise ValueError(f"no value at {at}")
                    stop = m.end()
                    self._add("v", at, stop, key, up, None)
                    if key == "type" and up >= 0:
                        self.string[up] = None  # of equal keys the last one holds
                at, key, need = stop, None, NEXT
                if up < 0:
                    break
                continue
            if c == "]" and text.startswith("]", at + 1):  # lists end
                stop, n, kinds, ups, stops, lasts = _CLOSE.match(text, at).end(), len(self.kind), self.kind, self.up, self.stop, self.last
                while at < stop and up >= 0 and kinds[up] == "[":
                    at += 1
                    stops[up], lasts[up] = at, n
                    up = ups[up]
                key, need = None, NEXT
                if up < 0:
                    break
                continue
            at += 1  # an object or list ends
            self.stop[up], self.last[up] = at, len(self.kind)
            up, key, need = self.up[up], None, NEXT
            if up < 0:
                break
        if _BLANK.match(text, at).end() != end:
            raise ValueError(f"more than one value, at {at}")

    def path(self, i: int, most: int = 64) -> str:
        """Where a value stands; of a place deeper than `most` steps, the first and the last ones."""
        steps: list[str] = []
        while self.up[i] >= 0:
            up = self.up[i]
            steps.append(f".{self.key[i]}" if self.kind[up] == "{" else f"[{self.nth[i]}]")
            i = up
        if len(steps) > most:
            steps = [*steps[: most // 2], "…", *steps[-(most // 2) :]]
        return "$" + "".join(reversed(steps))

    def items(self, i: int) -> Iterable[int]:
        """The parts of an object or list."""
        k = i + 1
        while k < self.last[i]:
            yield k
            k = self.last[k]

    def splice(self, new: Iterable[tuple[int, str]]) -> str:
        """The text with strings exchanged: (value's number, its new string), in order. What doesn't change is copied."""
        out, at = [], 0
        for i, value in new:
            if value != self.string[i]:
                out += [self.text[at : self.start[i]], quote(value)]
                at = self.stop[i]
        return "".join([*out, self.text[at:]])


def quote(value: str) -> str:
    """A string as JSON writes it; halves of surrogate pairs are escaped, so that UTF-8 can hold it."""
    said = json.dumps(value, ensure_ascii=False)
    return said if said.isascii() else _HALF.sub(lambda m: f"\\u{ord(m[0]):04x}", said)


def plain(value: str) -> str:
    """A string that UTF-8 can hold: half of a surrogate pair, which JSON can say, becomes U+FFFD."""
    return value if value.isascii() else value.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def same(a: str, b: str) -> bool:
    """Whether two JSON texts say the same: order of keys and writing of strings and numbers aside, numbers exactly."""
    return _digest(Tape(a)) == _digest(Tape(b))


def _number(text: str) -> str:
    sign, digits, exponent = Decimal(text).as_tuple()
    said = "".join(map(str, digits)).strip("0")
    whole = "".join(map(str, digits)).rstrip("0")
    return f"{'-' * sign}{said}e{exponent + len(digits) - len(whole)}" if said else "0"


def _digest(tape: Tape) -> bytes:
    """A digest of each value from those of its parts, the last values first."""
    made: list[bytes] = [b""] * len(tape.kind)
    for i in range(len(made) - 1, -1, -1):
        kind = tape.kind[i]
        if kind == "{":
            own = {tape.key[k]: made[k] for k in tape.items(i)}  # of equal keys the last one holds
            said = b"".join(hashlib.sha256(k.encode("utf-8", "surrogatepass")).digest() + own[k] for k in sorted(own))
        elif kind == "[":
            said = b"".join(made[k] for k in tape.items(i))
        elif kind == '"':
            said = tape.string[i].encode("utf-8", "surrogatepass")
        else:
            text = tape.text[tape.start[i] : tape.stop[i]]
            said = (text if text.isalpha() else _number(text)).encode()
        made[i] = hashlib.sha256(kind.encode() + said).digest()
    return made[0]
