"""Growing conversations as a stream: only segments that the snapshot before didn't have are passed on."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame


def new_segments(snapshots: DataFrame, ttl_ms: int = 1_800_000) -> DataFrame:
    """(conv_id string, version long, segments array<string>) -> (conv_id, version, place, segment) to be scanned.

    State is the hashes of the last snapshot; a divergence cuts them there, and the time to live is renewed at each use.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def run(key, frames: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        known = state.get[0].split(",") if state.exists and state.get[0] else []
        rows = sorted(((int(v), list(s)) for f in frames for v, s in zip(f.version, f.segments, strict=True)), key=lambda x: x[0])
        out = []
        for version, segments in rows:
            hashes = [hashlib.sha256(s.encode()).hexdigest() for s in segments]
            same = next((i for i, (a, b) in enumerate(zip(known, hashes, strict=False)) if a != b), min(len(known), len(hashes)))
            out += [(key[0], version, i, segments[i]) for i in range(same, len(segments))]
            known = hashes
        state.update((",".join(known),))
        state.setTimeoutDuration(ttl_ms)
        yield pd.DataFrame(out, columns=["conv_id", "version", "place", "segment"])

    return snapshots.groupBy("conv_id").applyInPandasWithState(run, "conv_id string, version long, place long, segment string", "hashes string", "append", GroupStateTimeout.ProcessingTimeTimeout)


def first_puts(puts: DataFrame, ttl: str = "30 minutes") -> DataFrame:
    """(request_id, created_at, ...) as a stream: of puts of one id within the time to live the first stays."""
    return puts.withWatermark("created_at", ttl).dropDuplicatesWithinWatermark(["request_id"])
