"""Connected components of an edge table, by alternating large-star and small-star steps.

Every step finds the smallest neighbours by a partial aggregate and joins them back to the edges. The edges of a vertex that has
very many share a join key; they are independent rows, which Spark's adaptive joins part over tasks (the neighbours' side has one
row for the key). Each round halves what is left of long chains. Rounds are cut with
reliable checkpoints, as a lost executor would otherwise replay all of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import checkpoint

ROUNDS = 60
#: Edges of a part of a round's checkpoint, and parts at least: rounds are many and shrink, so their files are few.
PART_EDGES, LEAST_PARTS = 200_000, 8


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (a, b), a > b. Large: each neighbour greater than v goes to v's smallest; small: each smaller one, and v itself."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    if large:
        least = least.select("a", F.least("a", "m").alias("m"))
        moved = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = both.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return moved.where("a > b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(vertex, component) for every vertex of edges (a, b) in any order; component is the smallest vertex. Loops and nulls are ignored."""
    now = checkpoint(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct())
    state, parts = None, max(now.count() // PART_EDGES, LEAST_PARTS)
    for _ in range(ROUNDS):
        now = checkpoint(_star(_star(now, True), False).coalesce(parts))
        found = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if (found["n"], found["h"]) == state:
            break
        state = (found["n"], found["h"])
    else:
        raise RuntimeError(f"components did not settle in {ROUNDS} rounds")
    return now.select(F.col("a").alias("vertex"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("vertex"), F.col("b").alias("component")).distinct())
