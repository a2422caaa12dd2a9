"""Services over HTTP, and a hub of subscribers as a data source."""

from __future__ import annotations

import importlib
import json
import queue
import threading
import time
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

# Paths of a detector's service, its time for a batch in seconds, and the largest answer in bytes.
DETECT_PATH, TIMEOUT, ANSWER_BYTES = "/api/detect/batch", 20.0, 32 << 20


class TooLarge(ValueError):
    """An answer is over the limit."""


def post(url: str, body: dict, deadline: float, limit: int):
    """The JSON answer to a JSON body: within the deadline in all, and of bounded bytes."""
    until = time.monotonic() + deadline
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json"})
    with urllib.request.urlopen(request, timeout=deadline) as answer:
        if answer.status != 200:
            raise OSError(f"status {answer.status}")
        parts, size = [], 0
        while part := answer.read1(1 << 16):
            parts.append(part)
            size += len(part)
            if size > limit:
                raise TooLarge(f"an answer of over {limit} bytes")
            if time.monotonic() > until:
                raise TimeoutError(f"no whole answer within {deadline} seconds")
    return json.loads(b"".join(parts))


@dataclass
class RemoteDetector:
    """A detector's service as a function of texts, for backends.detect_by."""

    endpoint: str
    deadline: float = TIMEOUT
    limit: int = ANSWER_BYTES

    def __call__(self, texts: list[str]) -> list[list[dict]]:
        answers = post(self.endpoint.rstrip("/") + DETECT_PATH, {"items": [{"text": t} for t in texts]}, self.deadline, self.limit)
        return [[{k: e[k] for k in ("type", "value", "start", "end", "score")} for e in (a or {}).get("entities") or []] for a in answers]


def detect_remote(rows: DataFrame, endpoint: str, deadline: float = TIMEOUT, limit: int = ANSWER_BYTES, **options) -> DataFrame:
    """rows with the entities that a service finds; batches are bounded, and one that stalls or says too much fails its task."""
    from spanveil.operators.backends import detect_by

    return detect_by(rows, RemoteDetector(endpoint, deadline, limit), deadline=2 * deadline, **options)


# The hub


def _named(path: str) -> Callable:
    module, _, name = path.partition(":")
    return getattr(importlib.import_module(module), name)


@dataclass
class Sent(WriterCommitMessage):
    sent: int
    dropped: int


class Inbox:
    """A bounded inbox before a subscriber: what comes while it is full is dropped and counted, so a slow subscriber delays nobody."""

    def __init__(self, put: Callable[[str], None], size: int, patience: float):
        self.waiting: queue.Queue = queue.Queue(size)
        self.sent = self.dropped = 0
        self.patience = patience
        self.put = put
        self.worker = threading.Thread(target=self._work, daemon=True)
        self.worker.start()

    def _work(self) -> None:
        while (value := self.waiting.get()) is not None:
            self.put(value)
            self.sent += 1

    def offer(self, value: str) -> None:
        try:
            self.waiting.put_nowait(value)
        except queue.Full:
            self.dropped += 1

    def close(self) -> Sent:
        """What is in the inbox still goes out, as long as patience lasts; what is left then is dropped."""
        until = time.monotonic() + self.patience
        while self.worker.is_alive() and time.monotonic() < until:
            try:
                self.waiting.put(None, timeout=0.05)
                break
            except queue.Full:
                continue
        self.worker.join(max(0.0, until - time.monotonic()))
        left = 0
        while not self.waiting.empty():
            left += self.waiting.get_nowait() is not None
        return Sent(self.sent, self.dropped + left + (self.worker.is_alive() and left == 0))


class _HubWriter(DataSourceStreamWriter, DataSourceWriter):
    def __init__(self, options: dict[str, str]):
        self.options = dict(options)
        self.size, self.patience = int(options.get("inbox", "64")), float(options.get("patience", "5"))

    def connect(self) -> Callable[[str], None]:
        return _named(self.options["connect"])(self.options)

    def write(self, iterator: Iterator) -> Sent:
        inbox = None
        for row in iterator:
            if inbox is None:
                inbox = Inbox(self.connect(), self.size, self.patience)
            inbox.offer(row[0])
        return inbox.close() if inbox else Sent(0, 0)

    def commit(self, messages: list, batchId: int | None = None) -> None:
        done = [m for m in messages if m is not None]
        counts = {"batch": batchId, "sent": sum(m.sent for m in done), "dropped": sum(m.dropped for m in done)}
        if counts["sent"] or counts["dropped"]:
            self.connect()(json.dumps({"counts": counts}))

    def abort(self, messages: list, batchId: int | None = None) -> None:
        """What was sent before a failure was sent; it goes out again with the next attempt."""


class Hub(DataSource):
    """Subscribers as a sink: options connect (module:function that takes the options and gives a function of a text), inbox (events it may hold) and patience in seconds.

    A task has an inbox of its own; after each batch a summary of what was sent and dropped goes to a subscriber too.
    Delivery is at least once, in no order between tasks.
    """

    @classmethod
    def name(cls) -> str:
        return "event_hub"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _HubWriter(self.options)

    def streamWriter(self, schema: StructType, overwrite: bool) -> DataSourceStreamWriter:
        return _HubWriter(self.options)


def events_for_hub(spark: SparkSession, events: DataFrame) -> DataFrame:
    """Events as the hub takes them, one JSON text a row; makes the hub known to the session."""
    spark.dataSource.register(Hub)
    return events.select(F.to_json(F.struct(*events.columns)).alias("value"))
