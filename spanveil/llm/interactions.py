"""How filters interact: every order of them, by executing the trie of their permutations.

Which filters a document fails is computed once, over the whole table, and written as a narrow table. The permutations'
trie is then walked depth first: a child's documents are its parent's without those that fail the edge's filter, persisted
while the walk is below it. Prefixes with the same filters in another order leave the same documents, so a state is
executed when it is first met and remembered by its set: 2^n states stand for n! orders. Every state counts what each
filter that is still to come removes from its survivors, for each part of the table.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import permutations
from math import factorial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanveil.llm.runtime import materialize, trimmed
from spanveil.llm.words import pieces

UPPER = bytes(range(65, 91))
SYMBOLS = b"#$%&*|"


def _measure(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        n_words, n_distinct, n_upper, n_chars, symbols = [], [], [], [], []
        for text in batch.column("text").to_pylist():
            raw = (text or "").encode()
            words = raw.split()
            n_words.append(len(words))
            n_distinct.append(len(set(words)))
            n_upper.append(len(raw) - len(raw.translate(None, UPPER)))
            n_chars.append(len(text or ""))
            symbols.append(len(raw.translate(None, SYMBOLS)) < len(raw))
        counts = [pa.array(x, pa.int64()) for x in (n_words, n_distinct, n_upper, n_chars)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), batch.column("digest"), *counts, pa.array(symbols, pa.bool_())], names=["doc_id", "part", "digest", "n_words", "n_distinct", "n_upper", "n_chars", "symbols"])


def text_failures(docs: DataFrame) -> DataFrame:
    """(doc_id, part, A to E) of docs (doc_id, text, source): a row each, and which filters it fails.

    A: under 200 words; B: less than half of the words are distinct; C: more than 2 % of the code points are A-Z; D: one of
    #$%&*| occurs; E: the same text stands under a smaller doc_id. A null text is empty; a null doc_id is smaller than none
    and none is smaller than it. part is the source, empty where it is null.
    """
    kind = dict(docs.dtypes)["doc_id"]
    own = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), "text", F.unhex(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)).alias("digest"))
    measured = materialize(own.mapInArrow(trimmed(_measure), f"doc_id {kind}, part string, digest binary, n_words long, n_distinct long, n_upper long, n_chars long, symbols boolean"))
    # by digest and id, so that a text that stands everywhere is not one key
    first = measured.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    again = F.col("doc_id").isNotNull() & F.col("first").isNull()
    return measured.join(first, ["digest", "doc_id"], "left").select(
        "doc_id", "part", (F.col("n_words") < 200).alias("A"), (100 * F.col("n_distinct") < 50 * F.col("n_words")).alias("B"),
        (100 * F.col("n_upper") > 2 * F.col("n_chars")).alias("C"), F.col("symbols").alias("D"), again.alias("E"),
    )


def audit(failures: DataFrame, filters: list[str], marks: list[str]) -> DataFrame:
    """Every order of the filters, step by step, for each part.

    failures: (part string, a boolean column for each filter: the row fails it; a boolean column for each mark). Gives part,
    filter_order (the filters' names in a row), step (from 1), kept (after the step), removed (by it), redundant (rows that
    fail its filter but went earlier), unique_fails (rows that fail no other), <mark>_lost (removed rows that bear the mark)
    and shapley (what the filter removes, summed over all orders), all counts long. Nulls count as false. A part without
    removals has zeros; an empty table gives no rows. Names of filters must differ; up to 8, since there are n! orders.
    """
    if len(set(filters)) < len(filters) or not 1 <= len(filters) <= 8:
        raise ValueError("one to eight filters of different names")
    n = len(filters)
    bit = [F.coalesce(F.col(f"`{f}`"), F.lit(False)).cast("int") * (1 << k) for k, f in enumerate(filters)]
    mark = [F.coalesce(F.col(f"`{m}`"), F.lit(False)).alias(f"mark{k}") for k, m in enumerate(marks)]
    rows = materialize(failures.select(F.coalesce("part", F.lit("")).alias("part"), reduce(Column.__add__, bit).alias("fails"), *mark))
    fails = lambda k: F.col("fails").bitwiseAND(1 << k) != 0
    count = lambda test: F.sum(test.cast("long"))

    def edge(k: int) -> Column:
        """What filter k removes from the survivors at hand."""
        lost = [count(fails(k) & F.col(f"mark{m}")).alias(f"lost{m}") for m in range(len(marks))]
        return F.struct(F.lit(k).alias("filter"), F.count("*").alias("here"), count(fails(k)).alias("removed"), *lost)

    of_part = F.array(*(F.struct(F.lit(k).alias("filter"), count(fails(k)).alias("failing"), count(F.col("fails") == 1 << k).alias("unique_fails")) for k in range(n)))
    parts = materialize(rows.groupBy("part").agg(of_part.alias("each")))
    edges: dict[int, DataFrame] = {}  # of each executed state, by its set of filters

    def walk(state: int, survivors: DataFrame) -> None:
        rest = [k for k in range(n) if not state >> k & 1]
        counted = survivors.groupBy("part").agg(F.array(*map(edge, rest)).alias("edges"))
        edges[state] = materialize(counted.select("part", F.lit(state).alias("state"), F.explode("edges").alias("e")).select("part", "state", "e.*"))
        for k in rest:
            if (child := state | 1 << k) not in edges and child != (1 << n) - 1:
                left = survivors.where(~fails(k))
                if all(child | 1 << j in edges or child | 1 << j == (1 << n) - 1 for j in rest if j != k):
                    walk(child, left)  # nothing is executed below it: read once, for its own counts
                else:
                    walk(child, left.persist())  # memory, then disk
                    left.unpersist()

    walk(0, rows)
    return _orders(rows.sparkSession, parts, reduce(DataFrame.unionByName, edges.values()), filters, marks)


def _orders(spark: SparkSession, parts: DataFrame, edges: DataFrame, filters: list[str], marks: list[str]) -> DataFrame:
    """A row for each part, order and step, from the counts at the trie's edges."""
    n = len(filters)
    steps = [("".join(filters[k] for k in order), at + 1, order[at], sum(1 << k for k in order[:at])) for order in permutations(range(n)) for at in range(n)]
    steps = F.broadcast(spark.createDataFrame(steps, "filter_order string, step int, filter int, state int"))  # n! * n rows, n is 8 at most
    orders = F.element_at(F.array(*(F.lit(factorial(k) * factorial(n - 1 - k)) for k in range(n))), F.bit_count("state") + 1)
    shares = edges.groupBy("part", "filter").agg(F.sum(F.col("removed") * orders).alias("shapley"))
    long = lambda x: F.coalesce(x, F.lit(0)).cast("long").alias(x)
    lost = [long(f"lost{m}").alias(f"{name}_lost") for m, name in enumerate(marks)]
    return (
        parts.select("part", F.explode("each").alias("e")).select("part", "e.*").join(shares, ["part", "filter"], "left").join(steps, "filter").join(edges, ["part", "state", "filter"], "left")
        .select("part", "filter_order", "step", (long("here") - long("removed")).alias("kept"), long("removed"), (F.col("failing") - long("removed")).alias("redundant"), "unique_fails", *lost, long("shapley"))
    )
