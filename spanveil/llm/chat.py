"""Reply trees to conversations: paths by self-joins, ranked by score, each formatted as one text that reads back.

A message knows its parent. Rounds of pointer doubling (a self-join of the links of 1, 2, 4, ... steps) give each
message its root, its depth and the score of its path in log2(depth) joins. Leaves are ranked a tree; the messages on a
chosen path are marked by going through the same links from the longest to the shortest.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanveil.llm.runtime import materialize, parts

START, SPEAKS, STOP = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
# Control strings of common chat templates; inside texts they are escaped.
CONTROL = (START, SPEAKS, STOP, "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
#: A control string, or one whose first character is followed by backslashes: escaping adds a backslash, reading takes one off.
_PLAIN = re.compile("|".join(f"{re.escape(c[0])}\\\\*{re.escape(c[1:])}" for c in CONTROL))
_ESCAPED = re.compile("|".join(f"{re.escape(c[0])}\\\\+{re.escape(c[1:])}" for c in CONTROL))
_TURN = re.compile(f"{re.escape(START)}(.*?){re.escape(SPEAKS)}(.*?){re.escape(STOP)}\n", re.DOTALL)


def escape(text: str) -> str:
    return _PLAIN.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[0][0] + m[0][2:], text)


def format_turns(turns: Iterable[tuple[str | None, str | None]]) -> tuple[str, list[tuple[int, int]]]:
    """(role, text) in order -> the text and the spans under the loss mask, those of what the assistant says."""
    out, at, mask = [], 0, []
    for role, text in turns:
        head, body = f"{START}{escape(role or '')}{SPEAKS}", escape(text or "")
        if role == "assistant":
            mask.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, f"{STOP}\n"]
        at += len(head) + len(body) + len(STOP) + 1
    return "".join(out), mask


def read_turns(text: str) -> list[tuple[str, str]]:
    """The turns of a formatted text."""
    return [(unescape(m[1]), unescape(m[2])) for m in _TURN.finditer(text)]


def paths(messages: DataFrame, top: int = 1) -> DataFrame:
    """(tree, id, parent, role, text, score) -> (tree, path, depth, role, text) for the top leaves of each tree.

    A leaf's score is the mean of its path's scores (null counts 0), ties go to the least id. A message whose parent is
    null or missing starts a tree of its own name. Messages that reply in a circle have no root and are on no path.
    Ids are distinct; of repeated ones, the first by role and text stays.
    """
    rows = messages.groupBy("id").agg(F.min(F.struct("parent", "role", "text", "score", "tree")).alias("x")).select("id", "x.*")
    rows = materialize(rows.select("tree", "id", "parent", "role", "text", F.coalesce("score", F.lit(0.0)).alias("score")))
    real = rows.select(F.col("id").alias("parent"))
    level = rows.select("id", "parent", "score").join(real.withColumn("there", F.lit(True)), "parent", "left")
    level = level.select("id", F.when(F.col("there"), F.col("parent")).alias("up"), F.lit(1).cast("long").alias("steps"), "score")
    state = materialize(level)
    levels = [state.where("up is not null")]
    longest = max(1, rows.count())
    # Only messages that haven't reached their root are joined again.
    while levels[-1].limit(1).count() and 2 ** (len(levels) - 1) < longest:
        far = state.select(F.col("id").alias("up"), F.col("up").alias("far"), F.col("steps").alias("more"), F.col("score").alias("also"))
        nearer = levels[-1].join(far, "up").select("id", F.col("far").alias("up"), (F.col("steps") + F.col("more")).alias("steps"), (F.col("score") + F.col("also")).alias("score"))
        state = materialize(state.where("up is null").union(nearer))
        levels.append(state.where("up is not null"))
    done = state.where("up is null").select("id", F.col("steps").alias("depth"), F.col("score").alias("total"))
    whole = rows.join(done, "id")
    inner = levels[0].select(F.col("up").alias("id")).distinct()
    leaves = whole.join(inner, "id", "left_anti").select("tree", "id", (F.col("total") / F.col("depth")).alias("rank"))
    if top == 1:
        chosen = leaves.groupBy("tree").agg(F.min(F.struct((-F.col("rank")).alias("rank"), "id")).alias("x")).select(F.col("x.id").alias("leaf"))
    else:  # in two steps, so that a tree's leaves are cut down before they meet
        from pyspark.sql import Window

        for by in (["tree", F.pmod(F.xxhash64("id"), F.lit(64))], ["tree"]):
            w = Window.partitionBy(*by).orderBy(F.desc("rank"), "id")
            leaves = leaves.withColumn("place", F.row_number().over(w)).where(F.col("place") <= top).drop("place")
        chosen = leaves.select(F.col("id").alias("leaf"))
    on = materialize(chosen.select("leaf", F.col("leaf").alias("id")))
    for step in reversed(levels):
        up = step.select("id", "up")
        on = on.union(on.join(up, "id").select("leaf", F.col("up").alias("id")))
        on = materialize(on)
    return on.join(whole, "id").select("tree", F.col("leaf").alias("path"), "depth", "role", "text")


def chain(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) as trees without branches: each row replies to the one before it by turn, then role and text.

    Nulls come first in each order; rows without a conv_id are one conversation, which isn't that of an empty id. Repeated
    rows are turns of their own. Other columns are left out; an empty table gives no rows.
    """
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    named = turns.select("conv_id", "turn", "role", "text").withColumn("place", F.row_number().over(w))
    # A null conversation isn't the one whose id is empty.
    name = lambda n: F.concat_ws(":", F.when(F.col("conv_id").isNull(), "null").otherwise(F.concat(F.lit("="), F.col("conv_id").cast("string"))), n.cast("string"))
    return named.select(F.col("conv_id").alias("tree"), name(F.col("place")).alias("id"), F.when(F.col("place") > 1, name(F.col("place") - 1)).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


FORMATTED = "text string, loss array<struct<start: int, stop: int>>"


def format_paths(chosen: DataFrame) -> DataFrame:
    """(tree, path, depth, role, text) -> (tree, path, text, loss): one text a path, with the spans under the loss mask.

    A task reads its rows in order of path and holds one path at a time.
    """
    kind = dict(chosen.dtypes)
    chosen = chosen.withColumn("tree", F.col("tree").cast("string"))  # pandas would make a float of a null among integers
    n = parts(chosen.sparkSession)
    ordered = chosen.repartition(n, "path").sortWithinPartitions("path", "depth")

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def one(key, turns):
            text, mask = format_turns(turns)
            return {"tree": key[1], "path": key[0], "text": text, "loss": [{"start": s, "stop": e} for s, e in mask]}

        key, turns = None, []
        for frame in frames:
            out = []
            for tree, path, role, text in zip(frame.tree, frame.path, frame.role, frame.text, strict=True):
                if key is None or path != key[0]:
                    if key is not None:
                        out.append(one(key, turns))
                    key, turns = (path, None if pd.isna(tree) else tree), []
                turns.append((role, text))
            if out:
                yield pd.DataFrame(out)
        if key is not None:
            yield pd.DataFrame([one(key, turns)])

    out = ordered.mapInPandas(run, f"tree string, path {kind['path']}, {FORMATTED}")
    return out.withColumn("tree", F.col("tree").cast(kind["tree"]))


def format_conversations(messages: DataFrame, top: int = 1) -> DataFrame:
    """Reply trees to one formatted text for each chosen path; null roles and texts count as empty."""
    return format_paths(paths(messages, top))
