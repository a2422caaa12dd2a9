"""Readers and sinks: request bodies, labelled lines, dictionaries, audit records."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanveil.operators.ordered import before

ENTITY_LABEL = "array<struct<type:string,value:string,start:int,end:int>>"
DETECTOR_CASE = f"id string, subset string, text string, expect {ENTITY_LABEL}"
COMMAND_CASE = "name string, descriptor struct<kind:string,phase:string,tool:string,command:string,target:string>, want string, note string"
AUDIT = "timestamp timestamp, request_id string, conversation_id string, upstream string, model string, strategy string, replaced_count long, restored boolean, outcome string, error_code string, detected_entities array<struct<type:string,value:string,start:int,end:int,score:double>>, schema_version string"


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; blank lines and those that begin with # are left out, and no line at all is an error."""
    lines = spark.read.text(path).where(~F.col("value").rlike(r"^\s*(?:#|$)"))
    out = lines.select(F.from_json("value", schema).alias("x")).select("x.*")
    if out.isEmpty():
        raise ValueError(f"{path} holds no cases")
    return out


def read_detector_cases(spark: SparkSession, path: str) -> DataFrame:
    return read_lines(spark, path, DETECTOR_CASE)


def read_command_cases(spark: SparkSession, path: str) -> DataFrame:
    return read_lines(spark, path, COMMAND_CASE)


def read_bodies(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """(request_id, conversation_id, endpoint, body) as JSON lines, once or as a stream of files."""
    schema = T.StructType([T.StructField(n, T.StringType()) for n in ("request_id", "conversation_id", "endpoint", "body")])
    return (spark.readStream if streaming else spark.read).schema(schema).json(path)


def check_dictionary(entries: DataFrame, known_types: list[str]) -> DataFrame:
    """(type, value) -> the entries at fault, with the reason: unknown type, blank edges, too short, one value under two types."""
    v = F.col("value")
    folded = F.translate(v, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    several = entries.withColumn("folded", folded).groupBy("folded").agg(F.countDistinct("type").alias("types"))
    joined = entries.withColumn("folded", folded).join(several, "folded", "left")
    reason = F.when(F.coalesce(~F.col("type").isin(*known_types), F.lit(True)), "unknown type").when(v.isNull() | (F.trim(v) == ""), "blank").when(v != F.trim(v), "blank edges").when(F.length(v) < 2, "too short").when(F.col("types") > 1, "several types")
    return joined.withColumn("reason", reason).where("reason is not null").select("type", "value", "reason")


def check_fakes(entries: DataFrame, simulatable: list[str]) -> DataFrame:
    """(type, real, fake) -> the entries at fault: a type without fakes, a blank, or a fake that stands for two values."""
    shared = entries.groupBy("fake").agg(F.count("*").alias("n"))
    blank = F.coalesce((F.trim("real") == "") | (F.trim("fake") == ""), F.lit(True))
    reason = F.when(F.coalesce(~F.col("type").isin(*simulatable), F.lit(True)), "type has no fakes").when(blank, "blank").when(F.col("n") > 1, "fake is shared")
    return entries.join(shared, "fake", "left").withColumn("reason", reason).where("reason is not null").select("type", "real", "fake", "reason")


def write_dictionary(entries: DataFrame, path: str) -> None:
    """Trimmed and distinct, as JSON lines; the writer's commit makes it appear at once."""
    entries.select("type", F.trim("value").alias("value")).distinct().write.mode("overwrite").json(path)


def read_dictionary(spark: SparkSession, path: str, known_types: list[str] | None = None) -> DataFrame:
    """(type, value) as written, trimmed; an entry at fault is an error."""
    entries = spark.read.schema("type string, value string").json(path).select("type", F.trim("value").alias("value")).distinct()
    if known_types is not None and (bad := check_dictionary(entries, known_types).limit(5).collect()):
        raise ValueError(f"dictionary entries at fault: {[(r.type, r.reason) for r in bad]}")
    return entries


# Endpoints and where each keeps its texts.
ENDPOINTS = {"chat/completions": "messages", "completions": "prompt", "embeddings": "input", "messages": "messages", "responses": "input"}


def read_requests(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """Bodies with the endpoint's name without its version, whether it is a known one, the model, and whether the answer streams."""
    name = F.regexp_replace(F.regexp_replace("endpoint", r"[?#].*$", ""), r"^/?(?:v[0-9]+/)?", "")
    out = read_bodies(spark, path, streaming).withColumn("endpoint", name)
    return out.withColumn("known", F.coalesce(F.col("endpoint").isin(*ENDPOINTS), F.lit(False))).withColumn("model", F.get_json_object("body", "$.model")).withColumn("stream", F.coalesce(F.get_json_object("body", "$.stream") == "true", F.lit(False)))


def write_audit(events: DataFrame, path: str, records_per_file: int = 1_000_000) -> None:
    """Appended JSON lines; schema_version is 1 where it is missing, and files have a bounded number of records."""
    version = F.coalesce("schema_version", F.lit("1")) if "schema_version" in events.columns else F.lit("1")
    events.withColumn("schema_version", version).write.mode("append").option("maxRecordsPerFile", records_per_file).json(path)


def rotated(events: DataFrame, at: str, limit: int, keep: int | None = None) -> DataFrame:
    """(line, file, at, place) of audit records in order of time: files are numbered from 0 on, and the next begins where one has reached `limit` bytes.

    A record's file follows from the bytes of all records before it, which are summed in cells of time and not in one task;
    so a file is over the limit by less than a record. keep: only so many of the last files. Records without a time come
    first; of equal times those of lesser text.
    """
    version = F.coalesce("schema_version", F.lit("1")) if "schema_version" in events.columns else F.lit("1")
    stamp = F.unix_micros(F.col(at).cast("timestamp"))
    lines = events.withColumn("schema_version", version).select(stamp.isNotNull().alias("key"), F.coalesce(stamp, F.lit(0)).alias("at"), F.to_json(F.struct(*events.columns, *(["schema_version"] if "schema_version" not in events.columns else []))).alias("line"))
    size = (F.octet_length("line") + 1).cast("long")
    placed = before(lines, ["at", "line"], size, into="place")
    timeless = F.broadcast(placed.agg(F.coalesce(F.sum(F.when(~F.col("key"), size)), F.lit(0)).alias("ahead")))  # one row
    placed = placed.join(timeless).withColumn("place", F.col("place") + F.when(F.col("key"), F.col("ahead")).otherwise(0))
    out = placed.select("line", F.floor(F.col("place") / limit).cast("long").alias("file"), F.when(F.col("key"), F.col("at")).alias("at"), "place")
    if keep is not None:
        last = out.agg(F.max("file").alias("last"))
        out = out.join(F.broadcast(last), F.col("file") > F.col("last") - keep).drop("last")  # one row
    return out


def write_rotated(events: DataFrame, path: str, at: str = "timestamp", limit: int = 64 << 20, keep: int | None = 3) -> None:
    """Audit records as JSON lines, a folder file=n of one file for each; a task writes one file's bytes at a time."""
    out = rotated(events, at, limit, keep)
    out.repartition("file").sortWithinPartitions("file", "place").select("line", "file").write.mode("overwrite").partitionBy("file").text(path)


def stream_audit(events: DataFrame, path: str, checkpoint: str):
    """The same as a stream."""
    return events.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def write_metrics(lines: DataFrame, path: str) -> None:
    """Lines of the text format for scrapers, in one file; a line a metric and label, so they are few."""
    lines.select("line").coalesce(1).write.mode("overwrite").text(path)


def publish(events: DataFrame, connect: Callable[[], Callable[[str], None]]) -> None:
    """Events as JSON to subscribers: each partition connects once and sends its rows; at least once, in no order between partitions."""

    def send(rows: Iterable) -> None:
        put = None
        for row in rows:
            put = put or connect()
            put(row.value)

    events.select(F.to_json(F.struct(*events.columns)).alias("value")).foreachPartition(send)


def publish_stream(events: DataFrame, connect: Callable[[], Callable[[str], None]], checkpoint: str):
    """The same as a stream, batch by batch."""
    return events.writeStream.foreachBatch(lambda batch, _: publish(batch, connect)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
