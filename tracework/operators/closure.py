"""Transitive closures on the cluster, in rounds that are written, so that a lost executor costs one round.

* reach: any edges; each round joins only what the round before found new (semi-naive), so rounds are the longest shortest
  path.
* ancestors: one parent for each node; pointers double each round, so rounds are its logarithm.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracework.session import cut


def reach(edges: DataFrame, most_rounds: int = 1_000) -> DataFrame:
    """(a, b, distance) of edges(a, b): every node with what it reaches, itself too, and the fewest steps. Circles end where
    they meet; nulls are no nodes; repeated edges count once."""
    steps = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select("a", "b").distinct()
    nodes = steps.select("a").unionByName(steps.select(F.col("b").alias("a"))).distinct()
    known = cut(nodes.select("a", F.col("a").alias("b"), F.lit(0).alias("distance")), "reach")
    fresh = cut(steps.withColumn("distance", F.lit(1)), "reach")
    for distance in range(2, most_rounds + 2):
        known = known.unionByName(fresh)
        further = fresh.select("a", F.col("b").alias("m")).join(steps.select(F.col("a").alias("m"), F.col("b").alias("c")), "m").select("a", F.col("c").alias("b")).distinct()
        fresh = cut(further.join(known.select("a", "b"), ["a", "b"], "left_anti").withColumn("distance", F.lit(distance)), "reach")
        if fresh.isEmpty():
            return known
    raise RuntimeError(f"no end after {most_rounds} rounds")


def ancestors(parents: DataFrame, most_rounds: int = 40) -> DataFrame:
    """(state, ancestor, distance) of parents(state, parent): each state with itself and all above it. A circle is cut where
    it closes; a parent that is no state ends the line; of two parents of one state the least counts."""
    one = parents.where("state IS NOT NULL").groupBy("state").agg(F.min("parent").alias("parent"))
    known = cut(one.select("state", F.col("state").alias("ancestor"), F.lit(0).alias("distance")), "ancestors")
    # up is what stands `step` above a state; known has all that stands nearer
    up = cut(one.join(one.select(F.col("state").alias("parent")), "parent", "left_semi").select("state", F.col("parent").alias("up")), "pointers")
    size, step = known.count(), 1
    for _ in range(most_rounds):
        if up.isEmpty():
            return known
        above = up.join(known.select(F.col("state").alias("up"), "ancestor", (F.col("distance") + step).alias("distance")), "up")
        known = cut(known.unionByName(above.select("state", "ancestor", "distance")).groupBy("state", "ancestor").agg(F.min("distance").alias("distance")), "ancestors")
        now = known.count()
        if now == size:  # only circles are left
            return known
        up, size, step = cut(up.join(up.select(F.col("state").alias("up"), F.col("up").alias("next")), "up").select("state", F.col("next").alias("up")), "pointers"), now, 2 * step
    raise RuntimeError(f"no end after {most_rounds} rounds")
