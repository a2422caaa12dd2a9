"""Entity detection as one array column, from built-in expressions.

Boundaries are judged after a match is found, on its ASCII neighbours: a match that fails has still used up its text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanveil.functions import fixed
from spanveil.functions import validators as V
from spanveil.operators.shapes import add_shaped
from spanveil.operators.tables import settled
from spanveil.operators.spans import NONE, entity, first_wins, found, let, matches, merge, resolve, worth


def _plain(kind: str, score: float):
    return lambda m: entity(F.lit(kind), m["value"], m["start"], m["end"], F.lit(score))


def _no(chars: str):
    return lambda m: ~(m["before"].rlike(f"^[{chars}]") | m["after"].rlike(f"^[{chars}]"))


_DIGIT, _ID = _no("0-9"), _no("0-9Xx")


def _all(*tests):
    def run(m: Column) -> Column:
        out = F.lit(True)
        for t in tests:
            out = out & t(m)
        return out

    return run


def _ideographs(text: Column) -> Column:
    return text.rlike("[一-龥]")


def _part(text: Column, pattern: str, own: str, to_entity, hint: Column) -> Column:
    """Matches of a cue and what follows; the entity is the match's end, from where `own` begins."""
    hits = F.transform(matches(text, pattern), lambda m: F.struct(F.regexp_extract(m["value"], own, 1).alias("value"), m["start"].alias("start"), m["end"].alias("end"), m["value"].alias("whole")))
    return F.when(worth(text, hint), F.transform(hits, to_entity)).otherwise(F.expr(NONE))


def _secrets(text: Column) -> Column:
    # Words begin and end with letters, so a boundary is what stands beside them; the first letter is asked for first.
    pattern = f"(?=[AaSsPpTt])(?<![0-9A-Za-z_])(?i:{fixed.KEY_WORDS})(?![0-9A-Za-z_]){fixed.KEY_JOINT}{fixed.KEY_VALUE}"
    own = f"^(?i:{fixed.KEY_WORDS}){fixed.KEY_JOINT}({fixed.KEY_VALUE})$"

    def make(m: Column) -> Column:
        whole = F.lower(m["whole"])
        kind = F.when(whole.contains("api_key") | whole.contains("apikey") | whole.contains("access_key"), "api_key").when(whole.contains("token"), "token").otherwise("password")
        return entity(kind, m["value"], m["end"] - F.octet_length(m["value"]), m["end"], F.lit(0.9))

    return _part(text, pattern, own, make, F.contains(text, F.lit("=")) | F.contains(text, F.lit(":")))


def trim_name(v: Column) -> Column:
    """A greedy run of two to four characters cut to the name at its start."""
    third = F.substring(v, 3, 1)
    particle = F.lit(fixed.PARTICLES).contains(third)
    four = F.when(F.substring(v, 1, 2).isin(*fixed.DOUBLE_SURNAMES), v).when(particle, F.left(v, F.lit(2))).otherwise(F.left(v, F.lit(3)))
    return F.when(F.length(v) == 4, four).when((F.length(v) == 3) & particle, F.left(v, F.lit(2))).otherwise(v)


def is_name(v: Column) -> Column:
    return F.length(v).between(2, 4) & (F.lit(fixed.SURNAMES).contains(F.left(v, F.lit(1))) | F.left(v, F.lit(2)).isin(*fixed.DOUBLE_SURNAMES))


def _names(text: Column) -> Column:
    def make(score: float, behind_cue: bool):
        def run(m: Column) -> Column:
            name = trim_name(m["value"])
            start = m["end"] - F.octet_length(m["value"]) if behind_cue else m["start"]
            return entity(F.lit("zh_person_name"), name, start, start + F.octet_length(name), F.lit(score))

        return run

    cued = _part(text, f"(?=[我姓名客联收负申用病患就员同本]){fixed.NAME_CUE}{fixed.NAME}", f"^{fixed.NAME_CUE}({fixed.NAME})$", make(0.75, True), _ideographs(text))
    titled = _part(text, f"{fixed.NAME}{fixed.NAME_TITLE}", f"^({fixed.NAME}){fixed.NAME_TITLE}$", make(0.7, False), _ideographs(text))
    cued, titled = (F.filter(x, lambda e: is_name(e["value"])) for x in (cued, titled))
    return let(cued, lambda known: F.concat(known, F.filter(titled, lambda e: ~F.exists(known, lambda c: (c["start"] == e["start"]) & (c["end"] == e["end"])))))


def _plates(text: Column) -> Column:
    def one(body: str) -> Column:
        pattern = f"(?=[LlVvRr]){fixed.WORD}{fixed.PLATE_CUE}{body}{fixed.WORD}"
        return _part(text, pattern, f"^{fixed.PLATE_CUE}({body})$", lambda m: entity(F.lit("plate"), m["value"], m["end"] - F.octet_length(m["value"]), m["end"], F.lit(0.75)), F.contains(F.lower(text), F.lit("plate")))

    return F.concat(one(fixed.PLATE_EN), one(fixed.PLATE_CA))


def _cards(text: Column) -> Column:
    return found(text, fixed.CARD, lambda m: entity(V.card_type(m["value"]), m["value"], m["start"], m["end"], F.lit(0.9)), _all(_DIGIT, lambda m: V.valid_card(m["value"])))


#: Rules by name, in the order in which they are tried; each maps a text column to an array of entities. Where a pattern
#: begins with choices or boundaries, the characters that it can begin with are asked for first; an address begins where
#: its run of characters does, or where the last one ended.
RULES = {
    "id_18": lambda t: found(t, fixed.ID_18, _plain("zh_id_card", 0.95), _all(_ID, lambda m: V.valid_id_card(m["value"]))),
    "id_15": lambda t: found(t, fixed.ID_15, _plain("zh_id_card", 0.85), _all(_ID, lambda m: V.valid_id_card(m["value"]))),
    "phone": lambda t: found(t, fixed.PHONE, _plain("zh_phone", 0.95), _all(_DIGIT, lambda m: V.valid_phone(m["value"]))),
    "card": _cards,
    "email": lambda t: found(t, f"(?:(?<![A-Za-z0-9._%+\\-])|\\G){fixed.EMAIL}", _plain("email", 0.9), hint="@"),
    "ipv4": lambda t: found(t, f"(?=[0-9]){fixed.IPV4}", _plain("ip_address", 0.8), _DIGIT, hint=t.rlike(r"[0-9]\.[0-9]{1,3}\.[0-9]")),
    "date": lambda t: found(t, f"(?=[12]){fixed.DATE}", _plain("date", 0.7)),
    "address": lambda t: found(t, f"(?=[一-龥]){fixed.ADDRESS}", _plain("zh_address", 0.7), hint=_ideographs(t)),
    "api_key": lambda t: found(t, f"(?=[spa]){fixed.WORD}{fixed.API_KEY}", _plain("api_key", 0.9), hint="-"),
    "jwt": lambda t: found(t, f"(?=eyJ){fixed.WORD}{fixed.JWT}", _plain("token", 0.9), hint="eyJ"),
    "plate": lambda t: found(t, fixed.PLATE, _plain("plate", 0.85), hint=_ideographs(t)),
    "url": lambda t: found(t, f"(?=[hf]){fixed.WORD}{fixed.URL}", _plain("url", 0.9), lambda m: V.valid_url(m["value"]), hint="://"),
    "ssn": lambda t: found(t, f"(?=[0-9]){fixed.WORD}{fixed.SSN}{fixed.WORD}", _plain("us_ssn", 0.9), _all(_DIGIT, lambda m: V.valid_ssn(m["value"])), hint="-"),
    "key_value": _secrets,
    "name": _names,
    "plate_english": _plates,
}


def spread(rows: DataFrame) -> DataFrame:
    """rows over all cores, where reading them gives less than half as many tasks: looking at a text costs far more than moving it.

    Files of one block can't be split, whatever their number of tasks says; large tables are left as they are read.
    """
    spark = rows.sparkSession
    size = int(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    cores = spark.sparkContext.defaultParallelism
    each = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    return rows.repartition(cores) if size // each + 1 <= cores // 2 else rows


def scan(text: Column, rules: list[str] | None = None) -> Column:
    """Entities of the named rules (all by default), rule by rule, unresolved."""
    return F.concat(*[RULES[r](text) for r in (RULES if rules is None else rules)])


def detect(text: Column, rules: list[str] | None = None, thresholds: dict[str, float] | None = None, allowed: list[str] | None = None) -> Column:
    """Resolved entities of a text as it is written; null counts as empty. Built-in expressions only.

    thresholds: least scores by type, instead of the fixed ones; {} leaves the default for every type.
    """
    return resolve(scan(F.coalesce(text, F.lit("")), rules), _limits(thresholds), fixed.DEFAULT_THRESHOLD, allowed)


def _limits(thresholds: dict[str, float] | None) -> Column | None:
    thresholds = fixed.THRESHOLDS if thresholds is None else thresholds
    return F.create_map(*[F.lit(x) for kv in thresholds.items() for x in kv]) if thresholds else None


def add_entities(rows: DataFrame, text: str = "text", into: str = "entities", rules: list[str] | None = None, thresholds: dict[str, float] | None = None, allowed: list[str] | None = None, dictionary: dict[str, str] | None = None) -> DataFrame:
    """rows with their entities, numbers written with separators, full width or a country code among them.

    A dictionary (value -> type) lies over what is found; thresholds and the allow-list don't touch its hits.
    """
    found = rows.withColumn("__t", F.coalesce(F.col(text), F.lit(""))).withColumn("__e", scan(F.col("__t"), rules))
    out = add_shaped(found, "__t", "__e").withColumn(into, resolve(F.col("__e"), _limits(thresholds), fixed.DEFAULT_THRESHOLD, allowed))
    if dictionary:
        out = out.withColumn(into, merge(dictionary_hits(F.col("__t"), dictionary), F.col(into)))
    return out.drop("__t", "__e")


def dictionary_hits(text: Column, values: dict[str, str]) -> Column:
    """Literal values (value -> type), ASCII case aside, longest first at a place; score 1."""
    if not values:
        return F.expr(NONE)
    folded = {"".join(c.lower() if c.isascii() else c for c in v): k for v, k in values.items()}
    pattern = "(?i:" + "|".join("\\Q" + v.replace("\\E", "\\E\\\\E\\Q") + "\\E" for v in sorted(folded, key=lambda v: (-len(v.encode()), v))) + ")"
    kinds = F.create_map(*[F.lit(x) for kv in sorted(folded.items()) for x in kv])
    return found(text, pattern, lambda m: entity(F.element_at(kinds, V.fold_ascii(m["value"])), m["value"], m["start"], m["end"], F.lit(1.0)))


def detect_with_dictionary(text: Column, values: dict[str, str], **options) -> Column:
    """Detection with a dictionary over it, which thresholds and the allow-list don't touch."""
    return merge(dictionary_hits(F.coalesce(text, F.lit("")), values), detect(text, **options))


def detect_by_settings(rows: DataFrame, settings, text: str = "text", into: str = "entities") -> DataFrame:
    """rows with entities under the thresholds, the allow-list and the dictionary of the settings."""
    return add_entities(rows, text, into, thresholds=settings.thresholds, allowed=settings.allowed, dictionary=settings.dictionary)


def detect_cached(requests: DataFrame, conversation: str = "conversation_id", text: str = "text", version: int = 0, **options) -> DataFrame:
    """requests with entities and cached: each text of a conversation is looked at once, under one version of the dictionaries.

    The first row of a text by `at` (where there is such a column) is the miss; a new version is a cache of its own.
    """
    key = F.struct(F.lit(version).alias("version"), F.col(conversation).alias("conversation"), F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256).alias("hash"))
    keyed = requests.withColumn("__key", key)
    once = settled(add_entities(keyed.groupBy("__key").agg(F.min(text).alias("__text"), *([F.min("at").alias("__first")] if "at" in requests.columns else [])), "__text", **options).drop("__text"))
    out = keyed.join(once, "__key")
    return out.withColumn("cached", F.col("at") > F.col("__first") if "at" in requests.columns else F.lit(None).cast("boolean")).drop("__key", "__first")


def dictionary_table(rows: DataFrame, entries: DataFrame, text: str = "text", into: str = "entities", block: int = 200_000) -> DataFrame:
    """rows with hits of a dictionary that is a table (value, type) of any length, as dictionary_hits finds them.

    Tasks find beginnings of values by one automaton, in one pass over a text: as many characters of each value as leave
    about `block` different beginnings at most, whole values where those are no longer. Where a longer value may stand, as
    long a piece of the text is joined with the dictionary. So a text is looked at once, however long the dictionary is.
    The longest of the values at a place counts.
    """
    import ahocorasick
    import pyarrow as pa

    row = "__row"
    folded = settled(entries.select(V.fold_ascii(F.col("value")).alias("value"), "type").where("value <> ''").groupBy("value").agg(F.max("type").alias("type")))
    numbered = settled(rows.withColumn(row, F.monotonically_increasing_id()))
    cut = _beginning(folded, block)
    longer = F.length("value") > cut
    known = folded.groupBy(F.left("value", F.lit(cut)).alias("head")).agg(F.max(F.when(~longer, F.struct("type"))).alias("own"), F.sort_array(F.collect_set(F.when(longer, F.length("value")))).alias("lengths"))
    heads = rows.sparkSession.sparkContext.broadcast([(r.head, r.own is not None, r.own and r.own.type, r.lengths) for r in known.toLocalIterator()])
    lower = {c: c + 32 for c in range(65, 91)}

    def look(batches):
        machine = ahocorasick.Automaton()
        for head, *known in heads.value:
            machine.add_word(head, (len(head), *known))
        if heads.value:
            machine.make_automaton()
        names = [row, "start", "stop", "type", "value"]
        types = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string()]
        made = []
        for batch in batches:
            for n, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                t = t.translate(lower) if t else ""
                for end, (size, whole, kind, lengths) in machine.iter(t) if heads.value and t else ():
                    start = end + 1 - size
                    if whole:
                        made.append((n, start, end + 1, kind, None))
                    made += [(n, start, start + k, None, t[start : start + k]) for k in lengths if start + k <= len(t)]
                    if len(made) >= 1 << 15:
                        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*made, strict=True), types, strict=True)], names=names)
                        made = []
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*made, strict=True), types, strict=True)], names=names)

    some = numbered.select(row, F.col(text)).mapInArrow(look, f"{row} long, start int, stop int, type string, value string")
    if not folded.where(longer).isEmpty():
        some = settled(some)
        some = some.where("value IS NULL").unionByName(some.drop("type").join(folded, "value").select(*some.columns))
    every = some.groupBy(row).agg(F.collect_list(F.struct("start", "stop", "type")).alias("__hits"))
    out = numbered.join(every, row, "left").withColumn("__hits", F.coalesce("__hits", F.expr("cast(array() as array<struct<start:int,stop:int,type:string>>)")))
    t = F.col(text)
    bytes_at = lambda n: F.octet_length(F.left(t, n))
    made = F.transform("__hits", lambda h: entity(h["type"], F.substring(t, h["start"] + 1, h["stop"] - h["start"]), bytes_at(h["start"]), bytes_at(h["stop"]), F.lit(1.0)))
    return out.withColumn(into, first_wins(made)).drop("__hits", row)


def _beginning(values: DataFrame, block: int) -> int:
    """Characters of a value's beginning: all, or the most that leave about `block` different beginnings (one character at least)."""
    longest = values.agg(F.count("*").alias("n"), F.max(F.length("value")).alias("most")).first()
    if longest.n <= block:
        return longest.most or 1
    low, high = 1, longest.most
    while low < high:  # beginnings never become fewer with more characters; eight lengths a pass
        step = max((high - low) // 8, 1)
        tried = range(low + step, high + 1, step)
        counts = values.agg(*[F.approx_count_distinct(F.left("value", F.lit(k)), 0.02).alias(str(k)) for k in tried]).first()
        fits = [k for k in tried if counts[str(k)] <= block]
        low, high = max(fits, default=low), min([k for k in tried if counts[str(k)] > block], default=high + 1) - 1
        high = max(low, high)
    return low
