"""Connected components of an edge table by randomised contraction.

Each round every node picks, of itself and its neighbours, the one with the least hash under that round's
seed; edges between picked nodes remain. A seed serves two rounds: after the first, the hub of a star stands at its least
leaf, and the second is done with it. The number of nodes falls by a constant factor a round on any graph,
only joins and min() are needed, and no node's neighbours meet in one task unaggregated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanveil.llm.runtime import materialize


def components(edges: DataFrame, rounds: int = 200) -> DataFrame:
    """edges (u long, v long), any direction, repeats and loops allowed -> (node, root): equal roots, same component.

    Nodes without an edge to another node don't appear.
    """
    left = edges.select("u", "v").where("u <> v")
    links = materialize(left.union(left.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    maps = []
    for turn in range(rounds):
        if links.isEmpty():
            break
        near = F.min(F.struct(F.xxhash64(F.lit(turn // 2), "v").alias("h"), F.col("v").alias("id"))).alias("near")
        own = F.struct(F.xxhash64(F.lit(turn // 2), "u").alias("h"), F.col("u").alias("id"))
        pick = materialize(links.groupBy("u").agg(near).select(F.col("u").alias("node"), F.least(own, "near")["id"].alias("root")))
        maps.append(pick)
        a = pick.select(F.col("node").alias("u"), F.col("root").alias("a"))
        b = pick.select(F.col("node").alias("v"), F.col("root").alias("b"))
        links = materialize(links.join(a, "u").join(b, "v").where("a <> b").select(F.col("a").alias("u"), F.col("b").alias("v")).distinct())
    else:
        raise RuntimeError("the graph did not contract")
    if not maps:
        return links.select(F.col("u").alias("node"), F.col("v").alias("root"))
    out = maps[0]
    for later in maps[1:]:
        nxt = later.select(F.col("node").alias("root"), F.col("root").alias("next"))
        out = out.join(nxt, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    return out
