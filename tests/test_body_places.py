"""Bodies are walked once: texts go back by their places, and only bodies that change are written anew."""

import json
import random

from spanveil.functions.jsontext import Tape
from spanveil.operators import bodies as B

BODIES = ['{"a":"é x@y.zz","b":["1",[[["q"]],[[]],[],"u"]],"arguments":"{\\"cmd\\":\\"to x\\"}","type":"t"}', "not json", '"one"', "[[[]]]", "[[1],[[2]]]", "[]", None, '{"a":[[[["\\u00e9"]]] ,[ [ ] ]]}']


def test_lists_in_lists_are_read_as_json_reads_them():
    for text in ("[[[]]]", "[[1],[[2]]]", '[[["a"],[]],[[],"b"]]', " [[ [[]] , [[1]]] ] "):
        tape = Tape(text)
        assert [json.loads(text[a:b]) for a, b in zip(tape.start, tape.stop, strict=True)][0] == json.loads(text)
        for i, up in enumerate(tape.up):
            assert tape.last[i] > i and (up < 0 or (tape.start[up] < tape.start[i] and tape.stop[i] < tape.stop[up] and tape.last[i] <= tape.last[up] and i in list(tape.items(up))))
            assert tape.parts[i] == len(list(tape.items(i))) and all(tape.nth[k] == n for n, k in enumerate(tape.items(i)))
    for bad in ("[[", "]]", "[[]]]", "[[}}", '{"a":[[}]}', "[[]", "[[,1]]", "[[1,]]", '{"a":[[]]]}'):
        try:
            Tape(bad)
        except ValueError:
            continue
        raise AssertionError(bad)


def test_texts_put_back_by_place_are_those_put_back_by_walking():
    rng = random.Random(2)
    for body in BODIES:
        for _ in range(8):
            placed = B.placed_texts(body, True)
            new = [None if rng.random() < 0.4 else f'n"{rng.random()}é' for _ in placed]
            given = [{"t": t, "start": x[3], "stop": x[4]} for t, x in zip(new, placed, strict=True)]
            want = body if all(t is None for t in new) else B.with_texts(body, new, True)
            assert B.put_back(body, given, True) == want


def test_bodies_that_do_not_change_are_not_walked_again(monkeypatch):
    def fail(*_):
        raise AssertionError("walked")

    body = '{"a":"x","b":"y"}'
    placed = B.placed_texts(body, True)
    monkeypatch.setattr(B, "Tape", fail)
    assert B.put_back(body, [{"t": None, "start": x[3], "stop": x[4]} for x in placed], True) == body
    assert B.put_back(body, [{"t": None, "start": placed[0][3], "stop": placed[0][4]}, {"t": "z", "start": placed[1][3], "stop": placed[1][4]}], True) == '{"a":"x","b":"z"}'
