"""Connected components over an edge table, without gathering any component in one task.

Rounds of large-star and small-star: every node links its larger neighbours, then its smaller ones, to the smallest
node it sees. A round is two aggregations (combined before the shuffle) and two joins; edges are at most as many as
before. Each round's edges, and what each node sees, are tables in the shared folder: so a join reads both sides plainly,
and the small one is broadcast by its size, or else adaptive execution splits what a hub has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """edges: a, b. A table that links the neighbours of each node that are larger (or, for small, not larger) than it to the smallest of it and its neighbours."""
    if small:
        near = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    else:
        near = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = common.staged(near.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m")), "least")
    met = near.join(common.sized(least), F.col("u") == F.col("k"))
    if small:
        out = met.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("k").alias("a"), F.col("m").alias("b")))
    else:
        out = met.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    out = common.staged(out.where("a <> b").distinct(), "edges")
    common.dropped(least)
    return out


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """edges: two columns of one orderable type. Gives node and component (the smallest node reachable) for every node
    that has an edge to another one; common.dropped() deletes its table. Nulls and self-links are left out; repeated edges
    count once."""
    a, b = edges.columns[:2]
    now = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, seen = common.staged(now, "edges"), None
    for _ in range(rounds):
        mark = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if mark.n == 0 or (mark.n, mark.h) == seen:
            out = now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
            out._notemill_path = now._notemill_path
            return out
        seen = (mark.n, mark.h)
        large = _star(now, False)
        common.dropped(now)
        now = _star(large, True)
        common.dropped(large)
    raise RuntimeError(f"components didn't settle in {rounds} rounds")
