"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014), as DataFrame jobs.

Nothing is collected: each round reads and writes edge tables in the shared folder; the driver sees two checksums.
The minimum of each node is its own written table, so that both sides of the join below are plain shuffles and a
node with very many edges is split by adaptive skew handling.

Edge cases: repeated edges, loops and edges in either direction count once; edges with a null end join nothing; nodes
without an edge have no row; no edges give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage, unstage

MOST_ROUNDS = 60


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step. ``edges`` holds (u, v) with u > v, without repeats; so does the result."""
    if large:
        near = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        near = edges
    lowest = stage(near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "lowest")
    joined = near.join(lowest, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(lowest.select("u", F.col("m").alias("v")))
    done = stage(out.where("u > v").distinct(), "edges")
    unstage(lowest)
    return done


def _checksum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node with an edge; component is the smallest node reachable.

    ``edges``: integer columns u and v, in any order, repeats and loops allowed. No edges give no rows.
    """
    now = stage(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct(), "edges")
    before = _checksum(now)
    for _ in range(MOST_ROUNDS if before[0] else 0):
        grown = _star(now, large=True)
        unstage(now)
        now = _star(grown, large=False)
        unstage(grown)
        after = _checksum(now)
        if after == before:
            break
        before = after
    else:
        if before[0]:
            raise RuntimeError("connected components did not settle")
    # settled: every edge joins a node to the smallest of its component
    pairs = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return pairs.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
