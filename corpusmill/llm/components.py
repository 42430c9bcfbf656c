"""Connected components of an edge table by alternating star contractions; nothing is gathered on the driver but a count."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm._scratch import cut, drop

MAX_ROUNDS = 60


def _large_star(edges: DataFrame) -> DataFrame:
    """Links every larger neighbour of a vertex to the least vertex among the vertex and its neighbours."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("v"), F.least("a", "m").alias("m"))
    return both.join(least, F.col("a") == F.col("v")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Links a vertex and its smaller neighbours to the least of them. Edges run from the larger vertex a to the smaller b."""
    least = edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("v"), "m")
    joined = edges.join(least, F.col("a") == F.col("v"))
    onward = joined.where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return onward.union(least.select(F.col("v").alias("a"), F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """One row per vertex with an edge: vertex and component (its least vertex). Loops and repeated edges are harmless.

    Each round writes its edges in the shared folder, so lineage stays short and a lost executor costs one round at most.
    The number of rounds grows with the logarithm of the number of vertices.
    """
    x, y = F.col(a), F.col(b)
    now = cut(edges.where(x != y).select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b")).distinct(), "edges")
    seen = None
    for _ in range(MAX_ROUNDS):
        state = now.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 40)))).first()
        if state == seen or not state[0]:
            break
        seen = state
        before, now = now, cut(_small_star(_large_star(now)), "edges")
        drop(before)
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("vertex"), F.col("b").alias("component")).union(now.select("b", "b").distinct())
