"""Near-duplicate vectors by an exact metric range join.

Cosine >= t of two vectors is a distance <= e = sqrt(2 - 2t) of their unit vectors. Pivots (vectors picked by hash, at
most `max_pivots` in all) cut the vectors of a label into cells, each vector at home with its nearest pivot. If x is at
home in cell i and y in cell j, and |xy| <= e, the triangle inequality gives |y p_i| <= |y p_j| + 2e; so y goes, beside
its own cell, to the earlier cells for which that holds, and cells are joined independently. Cells are cut into blocks,
and pairs of blocks are compared by matrix products. Equal vectors are one vector with a weight; a task returns counts
a vector and the links that connect its vectors, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanveil.llm.components import components
from spanveil.llm.runtime import materialize

THRESHOLD = 0.93
CELL = 3000
MAX_PIVOTS = 4096
BLOCK = 4000


def _units(vectors: pd.Series) -> np.ndarray:
    x = np.stack(vectors.to_numpy()).astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _place(pivots, reach: float):
    """Vectors to their home cell and to the earlier cells that they may have partners in."""

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for label, part in frame.groupby("label", sort=False):
                p = pivots.value.get(label)
                if p is None:
                    yield part.assign(cell=0, home=True)
                    continue
                for lo in range(0, len(part), 1024):
                    some = part.iloc[lo : lo + 1024]
                    x = np.stack(some.vector.to_numpy()).astype(np.float64)
                    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
                    far = np.sqrt(np.maximum(2 - 2 * unit @ p.T, 0))
                    home = far.argmin(1)
                    to = far <= far[np.arange(len(far)), home][:, None] + reach
                    to &= np.arange(len(p))[None, :] <= home[:, None]
                    row, cell = np.nonzero(to)
                    yield some.iloc[row].assign(cell=cell, home=cell == home[row])

    return run


def _compare(threshold: float):
    """A pair of blocks of a cell: a from its homes; b the homes of another block, its guests, or a itself (side 2)."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        a = rows[rows.side != 1].sort_values("vec_id", ignore_index=True)
        b = rows[rows.side == 1].sort_values("vec_id", ignore_index=True)
        own = not len(b) and len(a) and (a.side == 2).all()
        if own:
            b = a
        if not len(a) or not len(b):
            return pd.DataFrame([], columns=["vec_id", "n", "other"])
        x, y = _units(a.vector), _units(b.vector)
        ca, cb = a["copies"].to_numpy(), b["copies"].to_numpy()
        na, nb = np.zeros(len(a), dtype=np.int64), np.zeros(len(b), dtype=np.int64)
        # Least vector linked on the other side: with it a vector's block falls into connected parts step by step.
        label_a, label_b = np.arange(len(a)), len(a) + np.arange(len(b)) if not own else np.arange(len(a))
        edges: list[tuple[int, int]] = []
        up = list(range(len(a) + (0 if own else len(b))))

        def find(v: int) -> int:
            while up[v] != v:
                up[v] = up[up[v]]
                v = up[v]
            return v

        for lo in range(0, len(a), 256):
            s = x[lo : lo + 256] @ y.T
            hit = s >= threshold
            near = np.argwhere(np.abs(s - threshold) < 1e-9)
            for i, j in near:  # too near to say from unit vectors: the cosine itself
                u, v = np.asarray(a.vector[lo + i], dtype=np.float64), np.asarray(b.vector[j], dtype=np.float64)
                hit[i, j] = u @ v / (np.linalg.norm(u) * np.linalg.norm(v)) >= threshold
            if own:
                hit[np.arange(len(hit)), lo + np.arange(len(hit))] = False
            na[lo : lo + 256] += hit @ cb
            if not own:
                nb += ca[lo : lo + 256] @ hit
            for i in np.flatnonzero(hit.any(1)).tolist():
                at = np.flatnonzero(hit[i])
                mine = find(int(label_a[lo + i]))
                # Only partners that aren't in the same part yet.
                for j in label_b[at].tolist():
                    r = find(j)
                    if r != mine:
                        edges.append((lo + i, j))
                        up[max(r, mine)] = min(r, mine)
                        mine = min(r, mine)
        ids = a.vec_id.to_list() + ([] if own else b.vec_id.to_list())
        # Ids are 64-bit hashes: columns of nullable integers, never of floats.
        linked = [(i, int(n)) for i, n in zip(a.vec_id, na, strict=True) if n]
        if not own:
            linked += [(i, int(n)) for i, n in zip(b.vec_id, nb, strict=True) if n]
        first = [ids[u] for u, _ in edges] + [i for i, _ in linked]
        other = [ids[v] for _, v in edges] + [None] * len(linked)
        return pd.DataFrame({"vec_id": pd.array(first, dtype="Int64"), "n": pd.array([0] * len(edges) + [n for _, n in linked], dtype="Int64"), "other": pd.array(other, dtype="Int64")})

    return run


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, cell: int = CELL, max_pivots: int = MAX_PIVOTS, block: int = BLOCK) -> DataFrame:
    """(vec_id, embedding, label) -> vec_id, n_links, component_id, kept.

    Only vectors with equal labels are compared. A vector that is null, zero, or holds null or non-finite components, and
    one without a label, links with nothing. Vectors of another length than most link with nothing of that length: they
    are compared among themselves. Rows that agree in all three columns are one vector; a vec_id with several vectors
    gives a row for each. vec_id and label may be of any type that has an order; other columns are left out. An empty
    table gives no rows. Vectors are told apart by their components, never by a hash. A cell over `block` vectors is sent
    to each pair of its blocks; in high dimensions, where pivots prune little, the cost is quadratic in a label's vectors.
    """
    spark = vectors.sparkSession
    rows = materialize(vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("vector"), F.col("label").cast("string").alias("label")).distinct())
    good = F.col("vector").isNotNull() & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    sound = ~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = good & F.coalesce(sound, F.lit(False)) & F.coalesce(F.exists("vector", lambda x: x != 0), F.lit(False))
    # Vectors of one length and label are compared; both go into the group's name.
    group = F.concat("label", F.lit(":"), F.size("vector").cast("string"))
    merged = rows.where(usable).groupBy(group.alias("group"), "vector").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies"))
    # A number of its own for each distinct vector, given as it is written: its least vec_id may stand for several vectors.
    merged = materialize(merged.withColumn("key", F.monotonically_increasing_id()))
    sizes = merged.groupBy("group").agg(F.count("*").alias("n")).where(F.col("n") > cell)
    large = sizes.agg(F.sum("n").alias("n")).head().n or 0
    share = min(1.0 / cell, max_pivots / large) if large else 0.0
    drawn = F.xxhash64(F.lit(5), "group", "vector")
    picked = merged.join(sizes, "group", "left_semi").where(F.pmod(drawn, F.lit(1 << 30)) < int(share * (1 << 30)))
    pivots: dict[str, list] = {}
    for r in picked.select("group", drawn.alias("h"), "vector").orderBy("group", "h").limit(2 * max_pivots).collect():
        v = np.array(r.vector)
        pivots.setdefault(r.group, []).append(v / np.linalg.norm(v))
    known = spark.sparkContext.broadcast({k: np.stack(v) for k, v in pivots.items()})
    reach = 2 * float(np.sqrt(2 - 2 * threshold)) + 1e-9
    source = merged.select(F.col("group").alias("label"), F.col("key").alias("vec_id"), "copies", "vector")
    placed = materialize(source.mapInPandas(_place(known, reach), "label string, vec_id long, copies long, vector array<double>, cell int, home boolean"))
    counts = placed.groupBy("label", "cell").agg(F.ceil(F.count(F.when(F.col("home"), 1)) / block).cast("int").alias("homes"), F.ceil(F.count(F.when(~F.col("home"), 1)) / block).cast("int").alias("guests"))
    chunk = F.when(F.col("home"), F.pmod(F.xxhash64("vec_id"), F.greatest("homes", F.lit(1)))).otherwise(F.pmod(F.xxhash64("vec_id"), F.greatest("guests", F.lit(1))))
    dealt = placed.join(counts, ["label", "cell"]).withColumn("chunk", chunk.cast("int"))
    # Tasks (i, j): home blocks i <= j, and home block i with guest block homes + j.
    last = F.col("homes") - 1
    seq = lambda lo, hi: F.when(hi >= lo, F.sequence(lo, hi)).otherwise(F.array().cast("array<int>"))
    task = lambda i, j, side: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), side.cast("int").alias("side"))
    home_tasks = F.concat(
        F.array(task(F.col("chunk"), F.col("chunk"), F.lit(2))),
        F.transform(seq(F.col("chunk") + 1, last), lambda j: task(F.col("chunk"), j, F.lit(0))),
        F.transform(seq(F.lit(0), F.col("chunk") - 1), lambda i: task(i, F.col("chunk"), F.lit(1))),
        F.transform(seq(F.lit(0), F.col("guests") - 1), lambda g: task(F.col("chunk"), F.col("homes") + g, F.lit(0))),
    )
    guest_tasks = F.transform(seq(F.lit(0), last), lambda i: task(i, F.col("homes") + F.col("chunk"), F.lit(1)))
    tasks = dealt.withColumn("x", F.explode(F.when(F.col("home"), home_tasks).otherwise(guest_tasks)))
    tasks = tasks.select("label", "cell", "x.i", "x.j", "x.side", "vec_id", "copies", "vector")
    found = materialize(tasks.groupBy("label", "cell", "i", "j").applyInPandas(_compare(threshold), "vec_id long, n long, other long"))
    links = found.where("other is null").groupBy("vec_id").agg(F.sum("n").alias("n"))
    roots = components(found.where("other is not null").select(F.col("vec_id").alias("u"), F.col("other").alias("v")))
    each = merged.join(links.withColumnRenamed("vec_id", "key"), "key", "left").join(roots.withColumnRenamed("node", "key"), "key", "left")
    each = each.select("group", "key", "vec_id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "key").alias("root"))
    least = each.groupBy("root").agg(F.min("vec_id").alias("component_id"))
    each = materialize(each.join(least, "root").select("key", "n_links", "component_id").join(merged.select("key", F.col("group").alias("g"), F.col("vector").alias("v")), "key"))
    same = (F.col("h") == F.xxhash64("g", "v")) & (F.col("group") == F.col("g")) & (F.col("vector") == F.col("v"))
    keyed = rows.withColumn("group", F.when(usable, group)).withColumn("h", F.when(usable, F.xxhash64("group", "vector")))
    out = keyed.join(each, same, "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
