"""Connected components by alternating stars: every pass is a grouped minimum and a join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .exchange import Frozen


class Components:
    """(node, component) for every node, over a written table of stars (u, its smallest reachable node v)."""

    def __init__(self, stars: Frozen):
        self.stars = stars
        roots = stars.df.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
        self.df = stars.df.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)

    def drop(self) -> None:
        self.stars.drop()


def _marks(edges: DataFrame) -> tuple:
    """What tells one set of distinct edges from another: their number and 128 bits."""
    return tuple(edges.agg(F.count("*"), *[F.bit_xor(F.xxhash64("u", "v", F.lit(seed))) for seed in (1, 2)]).first())


def connected_components(edges: DataFrame, max_rounds: int = 60) -> Components:
    """(node, component) for every node of edges(a, b): component is the smallest node reachable.

    Large star: each node points its larger neighbours to its smallest neighbour. Small star: each
    node points its smaller neighbours and itself to the smallest. Both keep components and end,
    after O(log n) rounds in practice, in one star around each smallest node. Minima are partially
    aggregated and neighbours are joined, so a node with very many neighbours is no single task's.
    Self links and repeated links are allowed; links with a null end are ignored.
    """
    clean = edges.select("a", "b").where("a is not null and b is not null and a != b")
    now = Frozen(clean.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = _marks(now.df)
    for _ in range(max_rounds):
        both = now.df.unionByName(now.df.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        small_low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        after = Frozen(small)
        marks = _marks(after.df)
        now.drop()
        now = after
        if marks == before:
            break
        before = marks
    else:
        raise RuntimeError("components did not settle")
    return Components(now)
