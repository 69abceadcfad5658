"""Connected components of a large graph by alternating large and small stars.

Each round rewires every node's neighbours to the least label it has seen
(Kiveris et al., "Connected Components in MapReduce and Beyond", 2014); the
number of rounds grows with the logarithm of the longest path.  Minima are
partially aggregated, so a hub with a third of all links is combined before
the shuffle, and only joins touch its rows (adaptive execution splits those).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agrolens.llm.common import materialize, release



def _stamp(edges: DataFrame) -> tuple[int, int]:
    r = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return r["n"], r["x"] or 0


def _star(edges: DataFrame, least: DataFrame) -> DataFrame:
    """(u, v) and the least label m of u give (v, m)."""
    return edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Rows (node, root) for every node of ``edges`` (columns a, b; one type).

    root is the least node of the component.  Self links and repeated links
    are allowed; null ends are ignored.  An empty table gives an empty result.
    """
    e = (edges.where("a <> b")
         .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    e = last = materialize(e, "cc-edges")
    stamp = _stamp(e)
    for _ in range(max_rounds):
        if not stamp[0]:
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = _star(both.where("v > u"), least).where("u <> v").distinct()
        # small star: edges point downwards, (u, least) is kept beside the rewired neighbours
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        e = _star(down, low).where("u <> v").unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        before, e = last, materialize(e, "cc-edges")
        release(before)
        last, now = e, _stamp(e)
        if now == stamp:
            break
        stamp = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    nodes = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
