"""The one semantic core: the newest version of each key, minus keys whose newest version is a tombstone.

Tombstones are filtered after the merge, never before, or deleted keys would come back. Predicates on ``key`` may be
applied to the result: they concern the grouping key, so the optimizer moves them below the merge to the scan.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LAYER = ["key", "value", "ts_ns", "is_deleted", "seq"]


def newest_wins(log: DataFrame, order: str = "seq") -> DataFrame:
    """One version of each key, tombstones included: that of the greatest ``order`` (ties: greatest value).

    ``row_number() = 1`` plans as a group limit on both sides of the exchange, so older versions leave before the
    shuffle; it beat ``max_by`` over structs (a sort aggregate) in bench.py.
    """
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.desc(order), F.desc("is_deleted"), F.desc("value")))
    return log.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def newest_wins_by_aggregate(log: DataFrame, order: str = "seq") -> DataFrame:
    """The same by ``max_by``; kept for comparison, and for logs with few versions a key and narrow values."""
    rest = [c for c in log.columns if c not in ("key", order)]
    best = log.groupBy("key").agg(F.max_by(F.struct(*rest), F.struct(F.col(order), F.col("is_deleted"), F.col("value"))).alias("_r"), F.max(order).alias(order))
    return best.select("key", *(F.col(f"_r.{c}").alias(c) for c in rest), order).select(*log.columns)


def live(log: DataFrame, merged: bool = False) -> DataFrame:
    """[key, value] of the live snapshot. ``merged``: the log holds one version a key already, so nothing is shuffled."""
    newest = log if merged else newest_wins(log)
    return newest.where(~F.col("is_deleted")).select("key", "value")


def live_keys(log: DataFrame, merged: bool = False) -> DataFrame:
    """[key] of the live snapshot, without touching values: a hash aggregate over key, seq and the flag."""
    if merged:
        return log.where(~F.col("is_deleted")).select("key")
    # of one seq, a tombstone outranks a value: the greatest (seq, flag) pair as one number orders like the merge
    newest = log.groupBy("key").agg(F.max_by("is_deleted", F.col("seq") * 2 + F.col("is_deleted").cast("long")).alias("is_deleted"))
    return newest.where(~F.col("is_deleted")).select("key")


def union_layers(*layers: DataFrame) -> DataFrame:
    """All versions of several layers; recency is in ``seq``, so their order does not matter."""
    return reduce(lambda a, b: a.unionByName(b), (x.select(*LAYER) for x in layers))


def merge_runs(runs: DataFrame) -> DataFrame:
    """Snapshot of rows with a ``run_id``: the newest run that holds a key wins, then seq within it."""
    ranked = runs.withColumn("_order", F.struct("run_id", "seq"))
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("_order")))
    return ranked.withColumn("_rank", rank).where("_rank = 1").where(~F.col("is_deleted")).select("key", "value")
