"""Connected components by alternating large-star and small-star rounds.

Every round is two grouped minima and two joins over the edge list, written to
the shared folder; nothing but a count and a checksum reaches the driver. A
hub's minimum is combined before the shuffle; its edges meet in one join task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocking import BLOCK_ROWS, met
from .scratch import dropped, written

MAX_ROUNDS = 60


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def _with_least(edges: DataFrame, rows: int) -> DataFrame:
    """edges (u, v) with m, the least neighbour of u; the edges of a hub in blocks of `rows`."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    hubs = least.where(F.col("n") > rows).select("u", F.ceil(F.col("n") / rows).cast("int").alias("_left"), F.lit(1).alias("_right"))
    return met(edges, least.select("u", "m"), ["u"], "v", "m", rows, hubs)


def _large_star(edges: DataFrame, rows: int) -> DataFrame:
    """Every neighbour above u is tied to the least of u and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_least(both, rows).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()


def _small_star(edges: DataFrame, rows: int) -> DataFrame:
    """u and its neighbours below it are tied to the least of them."""
    tied = _with_least(edges, rows).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return tied.unionByName(edges.groupBy("u").agg(F.min("v").alias("v"))).distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", rows: int = BLOCK_ROWS) -> DataFrame:
    """(node, component) of every node that has an edge; component is the least node reachable.

    Self edges make a component of one, repeated edges and null ends do nothing.
    """
    pairs = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    pairs = written(pairs.distinct())  # the edges are worked out once
    loops, stars = pairs.where("u = v").select(F.col("u").alias("node")), pairs.where("u <> v")
    state = _state(stars)
    for _ in range(MAX_ROUNDS):
        if not state[0]:
            break
        after = written(_small_star(_large_star(stars, rows), rows))
        if hasattr(stars, "scratch_path"):
            dropped(stars)
        stars, before, state = after, state, _state(after)
        if state == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    roots = stars.select(F.col("v").alias("node")).unionByName(loops).distinct().withColumn("component", F.col("node"))
    members = stars.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return members.unionByName(roots.join(members, "node", "left_anti"))
