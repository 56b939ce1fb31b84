"""Connected components of an edge table, distributed, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessellar.llm.common import settle

#: Edges up to which the least neighbours are broadcast (16 bytes a node, at most two nodes an edge).
BROADCAST_EDGES = 250_000
#: Beyond, nodes with more than this many edges are split over SALTS keys; at most MAX_HOT nodes can be.
HOT, SALTS, MAX_HOT = 20_000, 64, 100_000


def _beside_least(pairs: DataFrame, edges: int) -> DataFrame:
    """``pairs`` (u, v) with m, the least v of each u; no hot u meets in one task.

    ``edges`` bounds the rows of ``pairs`` from above but for a factor of two.
    """
    least = pairs.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    if edges <= BROADCAST_EDGES:
        return pairs.join(F.broadcast(least.select("u", "m")), "u")
    least, bound = settle(least), max(HOT, 2 * edges // MAX_HOT)
    # at most 2 * edges / bound rows, so MAX_HOT
    hot = F.broadcast(least.filter(F.col("n") > bound).select("u", F.lit(True).alias("hot")))
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("v"), F.lit(SALTS))).otherwise(F.lit(0).cast("long"))
    salts = F.when(F.col("n") > bound, F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    salted = pairs.join(hot, "u", "left").select("u", "v", salt.alias("salt"))
    return salted.join(least.select("u", "m", F.explode(salts).alias("salt")), ["u", "salt"]).select("u", "v", "m")


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    both = edges.union(edges.select(F.col("v"), F.col("u")))
    return _beside_least(both, n).filter("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    moved = _beside_least(down, n).select(F.when(F.col("v") != F.col("m"), F.col("v")).otherwise(F.col("u")).alias("u"), F.col("m").alias("v"))
    linked = down.groupBy("u").agg(F.min("v").alias("v"))
    return moved.union(linked).distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, root (the component's least node) for every node of ``edges`` (u, v) but the roots.

    Each round contracts neighbourhoods onto their least node; the number of rounds grows
    with the logarithm of the longest path. Hot nodes are pre-aggregated before the
    shuffle, and joined by broadcast or salted.
    """
    state = settle(edges.filter("u <> v").select("u", "v").distinct())
    mark, n = None, state.count()
    for _ in range(rounds):
        state = settle(_small_star(_large_star(state, n), n))
        seen = state.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == mark:
            return state.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark, n = seen, seen["n"]
    raise RuntimeError("components did not settle")
