"""Audit projections, metrics, and detector quality."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Histogram bounds in seconds, classes of data.
DETECT_BUCKETS = [0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0]
HISTOGRAMS = {
    "detect": (["engine"], DETECT_BUCKETS),
    "request": (["endpoint"], [0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0]),
    "restore": (["endpoint"], [0.0005, 0.001, 0.0025, 0.005, 0.01, 0.025, 0.05, 0.1]),
    "judge": (["engine"], [0.0005, 0.001, 0.005, 0.01, 0.05, 0.1, 0.3, 0.5, 1.0]),
}
#: Counters and their labels.
COUNTERS = {
    "requests": ["endpoint", "outcome"], "replaced": ["fate"], "restored": ["endpoint"], "blocked": ["reason"], "upstream_errors": ["endpoint", "status"], "stream_orphans": ["endpoint"],
    "cache_hits": ["conversation"], "cache_misses": ["conversation"], "incremental_segments": ["action"], "pii_detected": ["entity_type", "fate"], "tool_calls_scanned": [], "verdicts": ["action", "category", "engine"], "judge_unavailable": ["engine", "reason"],
}
SENSITIVE = ["zh_id_card", "zh_bank_card", "api_key", "password", "token"]
DATA_CLASSES = ("敏感/重要数据", "一般个人信息", "非敏感")


def data_class(types: Column) -> Column:
    """Of an array of entity types."""
    return F.when(F.exists(types, lambda t: t.isin(*SENSITIVE)), DATA_CLASSES[0]).when(F.size(types) > 0, DATA_CLASSES[1]).otherwise(DATA_CLASSES[2])


def entity_summary(entities: Column, with_values: bool = False) -> Column:
    """Entities for the audit; values only where they may be logged."""
    value = (lambda e: e["value"]) if with_values else (lambda e: F.lit(None).cast("string"))
    return F.transform(entities, lambda e: F.struct(e["type"].alias("type"), value(e).alias("value"), e["start"].alias("start"), e["end"].alias("end"), e["score"].alias("score")))


def compliance(events: DataFrame, form: str = "pip") -> DataFrame:
    """events (.., types array) in the fields of a form: gdpr, dsl, csl, 等保2.0, or pip for all others."""
    base = [c for c in events.columns if c != "types"]
    if form == "gdpr":
        more = [F.col("types").alias("subject_categories"), F.lit("consent").alias("lawful_basis"), F.lit("session").alias("retention")]
    elif form in ("dsl", "csl", "等保2.0"):
        more = [data_class(F.col("types")).alias("data_class"), F.col("upstream").alias("flow")]
    else:
        more = [F.size("types").cast("long").alias("pii_count"), F.col("types").alias("pii_types")]
    return events.select(*base, *more)


def histogram(values: DataFrame, value: str, labels: list[str], bounds: list[float] | None = None) -> DataFrame:
    """Cumulative counts by bucket, as (labels.., le, n), with count and sum repeated."""
    bounds = bounds or DETECT_BUCKETS
    sums = values.groupBy(*labels).agg(F.count(value).alias("count"), F.sum(value).alias("sum"), *[F.sum(F.when(F.col(value) <= b, 1).otherwise(0)).alias(f"b{i}") for i, b in enumerate(bounds)])
    pairs = F.array(*[F.struct(F.lit(b).cast("double").alias("le"), F.col(f"b{i}").cast("long").alias("n")) for i, b in enumerate(bounds)], F.struct(F.lit(float("inf")).alias("le"), F.col("count").alias("n")))
    return sums.select(*labels, F.explode(pairs).alias("x"), "count", "sum").select(*labels, "x.le", "x.n", "count", "sum")


def latency(values: DataFrame, name: str, value: str = "seconds") -> DataFrame:
    """One of the named histograms, under its labels and bounds."""
    labels, bounds = HISTOGRAMS[name]
    return histogram(values, value, labels, bounds)


def counter(events: DataFrame, name: str, amount: str | None = None) -> DataFrame:
    """(metric, labels, value) of a counter: rows of events, or the sum of a column, by the counter's labels."""
    labels = COUNTERS[name]
    total = F.count("*") if amount is None else F.sum(amount)
    made = F.map_from_arrays(F.array(*[F.lit(x) for x in labels]), F.array(*[F.coalesce(F.col(x).cast("string"), F.lit("")) for x in labels])) if labels else F.expr("cast(map() as map<string,string>)")
    grouped = events.groupBy(*labels).agg(total.cast("long").alias("value"))
    return grouped.select(F.lit(name).alias("metric"), made.alias("labels"), F.coalesce("value", F.lit(0)).alias("value"))


def counters(sources: dict[str, DataFrame | tuple[DataFrame, str]]) -> DataFrame:
    """Several counters as one table; a source is events, or events and the column that is summed."""
    made = [counter(*((x, name) if isinstance(x, DataFrame) else (x[0], name, x[1]))) for name, x in sources.items()]
    out = made[0]
    for more in made[1:]:
        out = out.unionByName(more)
    return out


def store_size(tables: DataFrame, now: Column) -> DataFrame:
    """A gauge: mapping tables alive."""
    return tables.where(now <= F.col("expires_at")).agg(F.count("*").alias("value")).select(F.lit("store_size").alias("metric"), "value")


def active_streams(streams: DataFrame, now: Column) -> DataFrame:
    """A gauge: streams begun and not ended (opened_at, closed_at; null while open)."""
    return streams.where((F.col("opened_at") <= now) & (F.col("closed_at").isNull() | (F.col("closed_at") > now))).agg(F.count("*").alias("value")).select(F.lit("active_streams").alias("metric"), "value")


def exposition(metrics: DataFrame) -> DataFrame:
    """(metric, labels, value) as lines of the text format that scrapers read."""
    pairs = F.transform(F.array_sort(F.map_entries("labels")), lambda x: F.concat(x["key"], F.lit('="'), F.replace(F.replace(x["value"], F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"')))
    return metrics.select(F.concat("metric", F.when(F.size("labels") > 0, F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))).otherwise(""), F.lit(" "), F.col("value").cast("string")).alias("line"))


def histogram_lines(values: DataFrame, name: str, value: str = "seconds") -> DataFrame:
    """A histogram of HISTOGRAMS as lines of the text format: buckets with their bounds, the sum, and the count, by label."""
    (label,), bounds = HISTOGRAMS[name]
    v = F.col(value).cast("double")
    own = values.where(v.isNotNull()).groupBy(F.coalesce(F.col(label).cast("string"), F.lit("")).alias("label")).agg(F.array(*[F.sum((v <= b).cast("long")) for b in bounds], F.count("*")).alias("n"), F.sum(v).alias("sum"))
    said = F.replace(F.replace("label", F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    line = lambda what, more, count: F.concat(F.lit(f"{name}_{what}{{{label}=\""), said, F.lit(f'"{more}}} '), count)
    lines = [line("bucket", f',le="{le}"', F.col("n")[k].cast("string")) for k, le in enumerate([*map(_bound, bounds), "+Inf"])]
    lines += [line("sum", "", F.format_string("%.6f", "sum")), line("count", "", F.col("n")[len(bounds)].cast("string"))]
    return own.select(F.explode(F.array(*lines)).alias("line"))


def _bound(b: float) -> str:
    return f"{b:g}"


CELLS = 4096


def ranked(values: DataFrame, value: str, labels: list[str], place: Column) -> DataFrame:
    """(labels.., percentile): of each group the element at `place` (a function of n) of its sorted values.

    A group isn't sorted in one task: its range is cut into cells, counted, and only the cell that holds the place is
    looked at, cut again while it has many values of different size.
    """
    from spanveil.operators.tables import settled

    v = F.col(value).cast("double")
    rows = settled(values.select(*labels, F.col(value).alias("v"), v.alias("d")).where(F.col(value).isNotNull()))
    spans = rows.groupBy(*labels).agg(F.count("*").alias("n"), F.min("d").alias("lo"), F.max("d").alias("hi"))
    goal = settled(spans.select(*labels, place.cast("long").alias("at"), "lo", "hi"))
    same = lambda a, b: _all_same(a, b, labels)
    for _ in range(8):
        if goal.where("hi > lo").isEmpty():
            break
        cell = F.least(F.floor((F.col("d") - F.col("lo")) / (F.col("hi") - F.col("lo")) * CELLS), F.lit(CELLS - 1))
        near = rows.join(goal.withColumnsRenamed({k: f"g_{k}" for k in labels}), same("", "g_")).where("d >= lo and d <= hi")
        counts = near.groupBy(*labels, "at", F.when(F.col("hi") > F.col("lo"), cell).otherwise(0).alias("cell")).agg(F.count("*").alias("n"), F.min("d").alias("lo"), F.max("d").alias("hi"))
        w = _window(labels)
        upto = counts.withColumn("upto", F.sum("n").over(w)).where((F.col("upto") > F.col("at")) & (F.col("upto") - F.col("n") <= F.col("at")))
        goal = settled(upto.select(*labels, (F.col("at") - (F.col("upto") - F.col("n"))).alias("at"), "lo", "hi"))
    near = rows.join(goal.withColumnsRenamed({k: f"g_{k}" for k in labels}), same("", "g_")).where("d >= lo and d <= hi")
    from pyspark.sql import Window

    # Values of one cell whose ends agree are equal: what is left to rank is a handful, or all the same.
    number = F.row_number().over(Window.partitionBy(*labels).orderBy("v")) - 1
    equal = near.where("lo = hi").groupBy(*labels).agg(F.min("v").alias("percentile"))
    rest = near.where("lo < hi").withColumn("i", number).where("i = at").select(*labels, F.col("v").alias("percentile"))
    return equal.unionByName(rest)


def _window(labels: list[str]):
    from pyspark.sql import Window

    return Window.partitionBy(*labels).orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)


def _all_same(a: str, b: str, labels: list[str]) -> Column:
    out = F.lit(True)
    for k in labels:
        out = out & F.col(f"{a}{k}").eqNullSafe(F.col(f"{b}{k}"))
    return out


def percentile(values: DataFrame, value: str, labels: list[str], q: float) -> DataFrame:
    """The element at int(q (n - 1)) of each group's sorted values; nulls don't count."""
    return ranked(values, value, labels, F.floor(F.lit(q) * (F.col("n") - 1)))


class _Live:
    """Finds of one type that aren't used yet, in their order: the first that reaches into an interval, in logarithmic time.

    A tree over the finds holds the furthest end below each node. It answers for finds in order of their starts, as
    detection gives them; finds in another order are looked through one by one.
    """

    def __init__(self, finds: list[tuple[int, int, int]]):  # (start, end, number)
        self.finds = finds
        self.starts = [s for s, _, _ in finds]
        self.sorted = all(a <= b for a, b in zip(self.starts, self.starts[1:], strict=False))
        self.leaves = 1 << max(0, len(finds) - 1).bit_length()
        self.furthest = [-math.inf] * self.leaves + [e for _, e, _ in finds] + [-math.inf] * (self.leaves - len(finds))
        for k in range(self.leaves - 1, 0, -1):
            self.furthest[k] = max(self.furthest[2 * k], self.furthest[2 * k + 1])

    def take(self, start: int, end: int) -> int:
        """The number of the first find that overlaps, which is used from then on; -1 if none does."""
        if self.sorted:
            if self.furthest[1] <= start:
                return -1
            k = 1
            while k < self.leaves:
                k = 2 * k if self.furthest[2 * k] > start else 2 * k + 1
            at = k - self.leaves
            if self.starts[at] >= end:  # all later ones start further on
                return -1
        else:
            at = next((i for i, (s, _, _) in enumerate(self.finds) if s < end and start < self.furthest[self.leaves + i]), -1)
            if at < 0:
                return -1
            k = at + self.leaves
        self.furthest[k] = -math.inf
        while k > 1:
            k //= 2
            self.furthest[k] = max(self.furthest[2 * k], self.furthest[2 * k + 1])
        return self.finds[at][2]


def matched(labels, found) -> list[int] | None:
    """For each label in order the number of the first found entity of its type that overlaps it and isn't used; -1 if none."""
    if labels is None:
        return None
    by: dict[str, list[tuple[int, int, int]]] = {}
    for n, e in enumerate(() if found is None else found):
        by.setdefault(e["type"], []).append((e["start"], e["end"], n))
    live = {k: _Live(v) for k, v in by.items()}
    return [live[w["type"]].take(w["start"], w["end"]) if w["type"] in live else -1 for w in labels]


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def greedy_match(labels: pd.Series, found: pd.Series) -> pd.Series:
    """matched() of two columns of entities."""
    return pd.Series([matched(a, b) for a, b in zip(labels, found, strict=True)], dtype=object)


def detector_quality(cases: DataFrame, by: str | None = None) -> DataFrame:
    """(expect, found[, subset]) -> tp, fp, fn, precision, recall, f1 by type, by subset, or in all."""
    from spanveil.operators.tables import settled

    # Written, since both plans below read it, and since a function of Python can't stand inside their lambdas.
    matched = settled(cases.withColumn("m", greedy_match(F.col("expect"), F.col("found"))))
    key = (lambda e: e["type"]) if by == "type" else (lambda e: F.col(by) if by else F.lit("all"))
    wanted = matched.select(F.explode(F.zip_with("expect", "m", lambda e, i: F.struct(key(e).alias("k"), (i >= 0).alias("hit")))).alias("x")).groupBy("x.k").agg(F.sum(F.col("x.hit").cast("int")).alias("tp"), F.sum((~F.col("x.hit")).cast("int")).alias("fn"))
    extra = matched.select(F.explode(F.filter(F.transform("found", lambda e, i: F.struct(key(e).alias("k"), F.array_contains("m", i).alias("used"))), lambda x: ~x["used"])).alias("x")).groupBy("x.k").agg(F.count("*").alias("fp"))
    out = wanted.join(extra, "k", "full").select(F.col("k").alias(by or "scope"), *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("tp", "fp", "fn")])
    p, r = F.col("tp") / F.nullif(F.col("tp") + F.col("fp"), F.lit(0)), F.col("tp") / F.nullif(F.col("tp") + F.col("fn"), F.lit(0))
    return out.withColumn("precision", p).withColumn("recall", r).withColumn("f1", 2 * F.col("precision") * F.col("recall") / F.nullif(F.col("precision") + F.col("recall"), F.lit(0.0)))


def percentile_nearest(values: DataFrame, value: str, labels: list[str], p: float) -> DataFrame:
    """The other definition: the element at round(p / 100 n) - 1, halves to even, within the group."""
    return ranked(values, value, labels, F.least(F.greatest(F.bround(F.lit(p / 100) * F.col("n"), 0).cast("long") - 1, F.lit(0)), F.col("n") - 1))


def gate(scores: DataFrame, least: dict[str, float]) -> DataFrame:
    """Quality figures against least values: (figure, value, least, passed); a missing figure doesn't pass."""
    return scores.select(F.explode(F.array(*[F.struct(F.lit(k).alias("figure"), F.col(k).cast("double").alias("value"), F.lit(float(v)).alias("least")) for k, v in least.items()])).alias("x")).select("x.*", F.coalesce(F.col("x.value") >= F.col("x.least"), F.lit(False)).alias("passed"))


def entity_scores(expect: DataFrame, found: DataFrame, strict: bool = True) -> DataFrame:
    """(id, type, value, start, end) twice -> tp, fp, fn: strict needs all four equal; span needs the type and one value within the other."""
    if strict:
        same = ["id", "type", "value", "start", "end"]
        tp = expect.join(found, same, "left_semi").agg(F.count("*").alias("tp"))
        fn = expect.join(found, same, "left_anti").agg(F.count("*").alias("fn"))
        fp = found.join(expect, same, "left_anti").agg(F.count("*").alias("fp"))
    else:
        a, b = expect.alias("a"), found.alias("b")
        touch = (F.col("a.id") == F.col("b.id")) & (F.col("a.type") == F.col("b.type")) & (F.col("a.value").contains(F.col("b.value")) | F.col("b.value").contains(F.col("a.value")))
        tp, fn = a.join(b, touch, "left_semi").agg(F.count("*").alias("tp")), a.join(b, touch, "left_anti").agg(F.count("*").alias("fn"))
        fp = b.join(a, touch, "left_anti").agg(F.count("*").alias("fp"))
    one = F.lit(1).alias("one")
    return tp.select(one, "tp").join(fn.select(one, "fn"), "one").join(fp.select(one, "fp"), "one").drop("one")
