"""The circuit breaker as a stream: a state for each stream of calls, and a timer that says when it may be tried again."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

CLOSED, OPEN, HALF_OPEN = "closed", "open", "half_open"


class Machine:
    """Failures in a row, and when the breaker opened; the state before a call decides whether it is let through."""

    def __init__(self, failures: int, cooldown: pd.Timedelta, bad: int = 0, opened: pd.Timestamp | None = None):
        self.failures, self.cooldown, self.bad, self.opened = failures, cooldown, bad, opened

    def state(self, at: pd.Timestamp) -> str:
        return CLOSED if self.opened is None else OPEN if at - self.opened < self.cooldown else HALF_OPEN

    def call(self, at: pd.Timestamp, ok: bool) -> str:
        state = self.state(at)
        if state != OPEN:
            self.bad = 0 if ok else self.bad + 1
            self.opened = None if ok else at if state == HALF_OPEN or self.bad >= self.failures else self.opened
        return state


class _Breaker(StatefulProcessor):
    def __init__(self, failures: int, cooldown: float):
        self.failures, self.cooldown = failures, pd.Timedelta(seconds=cooldown)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("breaker", "bad int, opened timestamp")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        calls = pd.concat(list(rows), ignore_index=True).sort_values(["at", "call_id"], ignore_index=True)
        bad, opened = self.kept.get() if self.kept.exists() else (0, None)
        machine = Machine(self.failures, self.cooldown, bad, None if opened is None or pd.isna(opened) else pd.Timestamp(opened))
        states = [machine.call(at, bool(ok)) for at, ok in zip(calls["at"], calls["ok"], strict=True)]
        self.kept.update((machine.bad, None if machine.opened is None else machine.opened.to_pydatetime()))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer[0] if isinstance(timer, tuple) else timer)
        if machine.opened is not None:  # by the clock, since no later call may come to show it
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + int(self.cooldown.total_seconds() * 1000))
        yield pd.DataFrame({"stream": calls["stream"], "call_id": calls["call_id"], "state": pd.Series(states, dtype=object), "allowed": [s != OPEN for s in states]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame({"stream": [key[0]], "call_id": [-1], "state": [HALF_OPEN], "allowed": [True]})

    def close(self) -> None:
        pass


def breaking(calls: DataFrame, failures: int = 5, cooldown_seconds: float = 10.0) -> DataFrame:
    """Streaming form of stores.breaker: (stream string, at timestamp, call_id long, ok boolean) -> (stream, call_id, state, allowed).

    Calls of one batch are taken in order of time, batches one after another. When the cooldown of an open breaker has
    passed by the clock, a row with call_id -1 says that it may be tried. The state store must be RocksDB, which this sets
    for the session.
    """
    calls.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return calls.groupBy("stream").transformWithStateInPandas(_Breaker(failures, cooldown_seconds), "stream string, call_id long, state string, allowed boolean", "Append", "ProcessingTime")
