"""A run as its settings say: what is detected, what becomes of it, and how long it can be restored."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanveil.functions.config import Settings
from spanveil.operators.backends import detect_by
from spanveil.operators.detect import detect_by_settings
from spanveil.operators.replace import fate_overrides, replace
from spanveil.operators.spans import NONE, merge


def process(rows: DataFrame, settings: Settings, now: Column, call: Callable | None = None, deadline: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(request_id, seq, text) -> with entities and replaced, and the mapping with created_at and expires_at.

    Thresholds, the allow-list and the dictionary decide what is found; strategy, overrides, forced types and fakes what
    becomes of it; ttl_seconds how long the mapping is good. call, a service's function of texts, adds to what the rules
    find, and theirs come first where both begin alike; where it fails, fail_closed fails the run, and without it the
    rules' entities stand alone.
    """
    found = detect_by_settings(rows, settings)
    if call is not None:
        found = detect_by(found, call, into="__more", deadline=deadline, fail_closed=settings.fail_closed)
        found = found.withColumn("entities", merge(F.col("entities"), F.coalesce("__more", F.expr(NONE)))).drop("__more")
    fakes = None
    if settings.fakes:
        listed = [(kind, value, fake) for kind, pairs in settings.fakes.items() for value, fake in pairs.items()]
        fakes = rows.sparkSession.createDataFrame(listed, "type string, value string, fake string")
    out, mapping = replace(found, settings.strategy, fate_overrides(settings.overrides, settings.forced), fakes)
    return out, mapping.withColumn("created_at", now.cast("timestamp")).withColumn("expires_at", F.timestamp_micros(F.unix_micros(now.cast("timestamp")) + settings.ttl_seconds * 1_000_000))
