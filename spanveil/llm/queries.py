"""The operators over their whole tables, with production parameters, and SQL for what SQL can say."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanveil.llm import chat, decontaminate, embeddings, interactions, jaccard, licenses, lm, mixing, repeats, secrets, sentencepieces, tokencount, toxicity
from spanveil.llm.runtime import in_fold


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embedding near-dedup."""
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence scan: the licence that a whole text is, and the lines that are known notices."""
    return licenses.scan_all(table(spark, sf_dir, "documents"))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secret scan."""
    found = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    count = lambda kind: F.size(F.filter("secrets", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    one = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["stop"].cast("string"))
    base = F.concat_ws(",", F.transform(F.filter("secrets", lambda x: x["kind"] != "format"), one))
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(base, 256).alias("base_sha256"), F.concat_ws(",", F.transform("secrets", one)).alias("spans"))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join."""
    return jaccard.join(table(spark, sf_dir, "documents"))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items found in documents, a row for each document and item."""
    found = decontaminate.find_items(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.explode("hits").alias("h")).select("doc_id", "h.item_id", F.col("h.start").alias("start_byte"), F.col("h.stop").alias("stop_byte"), "h.edits")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts."""
    import public_tokenizers

    return tokencount.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.score(docs, table(spark, sf_dir, "labels")).select("doc_id", in_fold(4, 2).alias("held_out"), "score", "predicted")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mixing sources to target weights."""
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")


def _read_back(frames):
    for frame in frames:
        out = []
        for conv, text, loss in zip(frame["tree"], frame["text"], frame["loss"], strict=True):
            turns = chat.read_turns(text)
            said = "".join(chat.unescape(text[x["start"] : x["stop"]]) for x in loss)  # joined first, two texts could make a control string
            whole = "".join(f"{r}\n{t}\n" for r, t in turns)
            out.append((conv, len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest(), len(text)))
        yield pd.DataFrame(out, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chat formatting, with a conversation that says control strings, read back from the formatted text."""
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    formatted = chat.format_conversations(chat.chain(turns))
    return formatted.mapInPandas(_read_back, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language-model scores."""
    return lm.score(table(spark, sf_dir, "documents"))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SentencePiece ids of every text, and the text of the ids."""
    import public_tokenizers

    model = public_tokenizers.path("piece_bpe_32k.model")
    decoded = sentencepieces.decode(sentencepieces.encode(table(spark, sf_dir, "documents"), model), model)
    ids = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filter interaction audit: five filters in all orders."""
    failures = interactions.text_failures(table(spark, sf_dir, "documents"))
    marks = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    out = interactions.audit(failures.join(marks, "doc_id", "left"), list("ABCDE"), ["good", "toxic"])
    return out.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def planted(docs: DataFrame) -> DataFrame:
    """doc_id and text of documents, where every tenth by crc32(doc_id) repeats a stretch of its words from some place on."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), h.alias("h")).withColumn("w", F.when(F.col("h") % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))))
    at = words.withColumn("n", F.size("w")).withColumn("g", F.floor(F.col("h") / 10)).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    cut = at.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    again = F.flatten(F.array_repeat(F.slice("w", F.col("a") + 1, F.col("p")), F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int")))
    whole = F.concat_ws(" ", F.slice(F.concat(F.slice("w", F.lit(1), F.col("a")), again), F.lit(1), F.col("n")))
    return cut.select("doc_id", F.when(F.col("n") > 0, whole).otherwise(F.col("text")).alias("text"))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words, and texts without them."""
    found = repeats.find_runs(planted(table(spark, sf_dir, "documents")))
    said = F.concat_ws("", F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))))
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), repeats.strongest("runs").alias("best"), F.sha2(said, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256")).select(
        "doc_id", "n_runs", "best.start", "best.length", "best.period", F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"), "runs_sha256", "collapsed_sha256"
    )


def queries() -> dict:
    return {
        "op1_embedding_near_dedup": op1, "op2_license_scan": op2, "op3_secret_scan": op3, "op4_ngram_jaccard": op4, "op5_benchmark_decontamination": op5,
        "op6_token_counts": op6, "op7_toxicity": op7, "op8_source_mixing": op8, "op9_chat_format": op9, "op10_lm_score": op10,
        "op11_sentencepiece": op11, "op12_filter_interactions": op12, "op13_periodic_runs": op13,
    }


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _canonical_sql(column: str) -> str:
    out = f"regexp_replace(lower({column}), {_text('(?m)' + licenses.NOTICE)}, '', 'g')"
    out = f"concat(' ', regexp_replace({out}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' ')"
    for spelling, plain in licenses.SPELLINGS:
        out = f"replace({out}, {_text(spelling)}, {_text(plain)})"
    return f"trim({out})"


def _license_sql() -> str:
    values = ", ".join(f"({_text(k)}, {_text(v)})" for k, v in licenses.known_texts())
    given = ", ".join(f"({_text(k)}, {_text(v)})" for k, v in licenses.DIGESTS.items())
    return f"""
    WITH every AS (SELECT license_id, sha256({_canonical_sql("body")}) AS digest FROM (VALUES {values}) v(license_id, body) UNION ALL SELECT * FROM (VALUES {given})),
    known AS (SELECT min(license_id) AS license_id, digest FROM every GROUP BY digest),
    own AS (SELECT doc_id, CASE WHEN text IS NOT NULL THEN sha256({_canonical_sql("text")}) END AS text_sha256 FROM documents),
    pieces AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
    found AS (SELECT doc_id, count(*) AS n_notices, min(license_id) AS first_notice FROM (SELECT doc_id, sha256({_canonical_sql("line")}) AS digest FROM pieces) JOIN known USING (digest) GROUP BY doc_id)
    SELECT doc_id, text_sha256, license_id, coalesce(n_notices, 0) AS n_notices, first_notice
    FROM own LEFT JOIN known ON text_sha256 = digest LEFT JOIN found USING (doc_id)"""


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_JACCARD_SQL = f"""
    WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
    s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM w),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS overlap FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
    e AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * overlap >= 80 * (nx.n + ny.n - overlap)),
    r AS (SELECT x AS a, x AS b FROM e UNION SELECT r.a, e.y FROM r JOIN e ON e.x = r.b)
    SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.least, w.doc_id) AS component_id, coalesce(l.n_links, 0) AS n_links
    FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS least FROM r GROUP BY a) c USING (doc_id)
    LEFT JOIN (SELECT x AS doc_id, count(*) AS n_links FROM e GROUP BY x) l USING (doc_id)"""
_EMBEDDING_SQL = """
    WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
    ok AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
    l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
    r AS (SELECT x AS a, x AS b FROM l UNION SELECT r.a, l.y FROM r JOIN l ON l.x = r.b),
    c AS (SELECT a AS vec_id, min(b) AS least FROM r GROUP BY a), d AS (SELECT x AS vec_id, count(*) AS n FROM l GROUP BY x)
    SELECT v.vec_id, coalesce(d.n, 0) AS n_links, coalesce(c.least, v.vec_id) AS component_id, v.vec_id = coalesce(c.least, v.vec_id) AS kept
    FROM v LEFT JOIN c USING (vec_id) LEFT JOIN d USING (vec_id)"""
_CONTROL = r"<\\*(?:\|im_start\|>|\|im_sep\|>|\|im_end\|>|\|endoftext\|>|s>|/s>|<SYS>>|</SYS>>)|\[\\*(?:INST\]|/INST\])"
_MARKS = len(chat.START) + len(chat.SPEAKS) + len(chat.STOP) + 1
_CHAT_SQL = f"""
    WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
               UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))
    SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
           CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
           sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
           CAST(sum({_MARKS} + length(role) + len(regexp_extract_all(role, '{_CONTROL}')) + length(text) + len(regexp_extract_all(text, '{_CONTROL}'))) AS BIGINT) AS formatted_chars
    FROM t GROUP BY conv_id"""


_IN_ORDER = "source IS NULL, source"
_BLOCK = "CASE " + " ".join(f"WHEN total <= {n * 65536} THEN {n}" for n in (16, 32, 64, 128, 256, 512, 1024, 2048)) + f" ELSE {mixing.BLOCKS[1]} END"
_MIX_SQL = f"""
    WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents),
    n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, source, size) AS copy FROM d),
    s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM n GROUP BY source),
    r AS (SELECT *, CAST([1, 2, 3][(row_number() OVER (ORDER BY {_IN_ORDER}) - 1) % 3 + 1] AS DOUBLE) AS weight, source_size * {mixing.PASSES}::DOUBLE AS lim FROM s),
    l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(lim) OVER (ORDER BY lim / weight, {_IN_ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY lim / weight, {_IN_ORDER} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
    t AS (SELECT source, source_size, coalesce(least(lim, weight * (SELECT level FROM l WHERE lim >= level * weight ORDER BY lim / weight, level LIMIT 1)), lim) AS target FROM l),
    b AS (SELECT *, greatest(1, least({_BLOCK}, CAST(floor(least(target, source_size) / {mixing.SHARES}) AS BIGINT))) AS words FROM t, (SELECT sum(source_size) AS total FROM t) WHERE source_size > 0),
    c AS (SELECT *, CAST(ceil(source_size / words) AS BIGINT) AS blocks, CAST(floor(target / source_size) AS BIGINT) AS whole FROM b),
    k AS (SELECT source, words, blocks, least(blocks * {mixing.PASSES}, whole * blocks + least(blocks, CAST(floor((target - whole * source_size) / words + 0.5) AS BIGINT))) AS slots FROM c),
    o AS (SELECT *, sum(slots) OVER (ORDER BY {_IN_ORDER}) AS near, sum(slots) OVER () AS every FROM k WHERE slots > 0),
    ring AS (SELECT *, floor(CAST(near - slots AS DOUBLE) / every * {mixing.RING}) AS lo, floor(CAST(near AS DOUBLE) / every * {mixing.RING}) AS hi FROM o),
    points AS (SELECT i AS slot, i % {mixing.RING} * {mixing.STEP} % {mixing.RING} AS point FROM (SELECT unnest(range((SELECT CAST(max(every) AS BIGINT) FROM o))) AS i)),
    ranks AS (SELECT source, blocks, slots, row_number() OVER (PARTITION BY source ORDER BY slot) - 1 AS rank FROM points JOIN ring ON point >= lo AND point < hi),
    got AS (SELECT o.source, o.blocks, o.slots, count(ranks.rank) AS had FROM o LEFT JOIN ranks ON o.source IS NOT DISTINCT FROM ranks.source GROUP BY ALL),
    used AS (SELECT source, blocks, rank FROM ranks WHERE rank < slots UNION ALL SELECT source, blocks, unnest(range(had, slots)) FROM got WHERE had < slots),
    times AS (SELECT source, rank % blocks AS block, count(*) AS times FROM used GROUP BY ALL),
    h AS (SELECT *, md5(concat_ws(':', '0', coalesce(CAST(doc_id AS VARCHAR), ''), CAST(size AS VARCHAR), CAST(copy AS VARCHAR))) AS h FROM n WHERE size > 0),
    placed AS (SELECT h.*, words, CAST(coalesce(sum(size) OVER (PARTITION BY h.source ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM h JOIN k ON h.source IS NOT DISTINCT FROM k.source),
    parts AS (SELECT doc_id, source, size, copy, words, start, unnest(range(start // words, (start + size - 1) // words + 1)) AS block FROM placed),
    taken AS (SELECT doc_id, parts.source, size, copy, sum((least(start + size, (parts.block + 1) * words) - greatest(start, parts.block * words)) * times) AS taken FROM parts JOIN times ON parts.source IS NOT DISTINCT FROM times.source AND parts.block = times.block GROUP BY ALL)
    SELECT n.doc_id, n.source, n.size, t.source_size, t.target, CAST(coalesce(taken.taken, 0) AS BIGINT) AS taken FROM n JOIN t ON n.source IS NOT DISTINCT FROM t.source
    LEFT JOIN taken ON n.doc_id IS NOT DISTINCT FROM taken.doc_id AND n.source IS NOT DISTINCT FROM taken.source AND n.size = taken.size AND n.copy = taken.copy"""


_AUDIT_SQL = """
    WITH w AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
    same AS (SELECT text, min(doc_id) AS least FROM w GROUP BY text),
    marks AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
    d AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, len(ws) < 200 AS a, 100 * len(list_distinct(ws)) < 50 * len(ws) AS b,
          100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) AS c, regexp_matches(text, '[#$%&*|]') AS d, coalesce(doc_id > least, false) AS e
          FROM w JOIN same USING (text) LEFT JOIN marks USING (doc_id)),
    g AS (SELECT part, [a, b, c, d, e] AS fails, good, toxic, count(*) AS n FROM d GROUP BY ALL),
    k AS (SELECT unnest(range(1, 6)) AS k),
    orders AS (SELECT [v.k, w.k, x.k, y.k, z.k] AS o FROM k v JOIN k w ON w.k <> v.k JOIN k x ON x.k NOT IN (v.k, w.k) JOIN k y ON y.k NOT IN (v.k, w.k, x.k) JOIN k z ON z.k NOT IN (v.k, w.k, x.k, y.k)),
    steps AS (SELECT o, array_to_string(list_transform(o, lambda i: chr(CAST(64 + i AS INTEGER))), '') AS filter_order, k AS step, o[k] AS f, o[1:k - 1] AS earlier FROM orders, k),
    f AS (SELECT part, filter_order, step, f, n, fails, good, toxic, len(list_filter(earlier, lambda i: fails[i])) = 0 AS here, fails[f] AS own, len(list_filter(fails, lambda x: x)) = 1 AS once FROM g, steps),
    r AS (SELECT part, filter_order, CAST(step AS INTEGER) AS step, f, CAST(coalesce(sum(n) FILTER (here AND NOT own), 0) AS BIGINT) AS kept, CAST(coalesce(sum(n) FILTER (here AND own), 0) AS BIGINT) AS removed,
          CAST(coalesce(sum(n) FILTER (own AND NOT here), 0) AS BIGINT) AS redundant, CAST(coalesce(sum(n) FILTER (own AND once), 0) AS BIGINT) AS unique_fails,
          CAST(coalesce(sum(n) FILTER (here AND own AND good), 0) AS BIGINT) AS good_lost, CAST(coalesce(sum(n) FILTER (here AND own AND toxic), 0) AS BIGINT) AS toxic_lost FROM f GROUP BY ALL)
    SELECT * EXCLUDE (f), CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM r"""


def oracle_sql() -> dict[str, str]:
    return {"op12_filter_interactions": _AUDIT_SQL, "op1_embedding_near_dedup": _EMBEDDING_SQL, "op2_license_scan": _license_sql(), "op4_ngram_jaccard": _JACCARD_SQL, "op8_source_mixing": _MIX_SQL, "op9_chat_format": _CHAT_SQL}
