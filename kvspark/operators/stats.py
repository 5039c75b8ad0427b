"""Aggregates over logs and run metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import kilobytes
from ..schema import record_size

STATS_COLUMNS = ("mem_records", "mem_kb", "sst_files", "sst_records", "sst_kb", "wal_kb", "total_records", "memtable_max_size")


def versions_by_key(log: DataFrame) -> DataFrame:
    return log.groupBy("key").agg(F.count(F.lit(1)).alias("versions"), F.max("seq").alias("max_seq"))


def tombstones_by_key(log: DataFrame) -> DataFrame:
    return log.groupBy("key").agg(F.sum(F.col("is_deleted").cast("long")).alias("tombstones"))


def run_stats(runs: DataFrame) -> DataFrame:
    """Count, first and last key of each ``run_id``."""
    return runs.groupBy("run_id").agg(F.count(F.lit(1)).alias("record_count"), F.min("key").alias("min_key"), F.max("key").alias("max_key"))


def storage_totals(run_meta: DataFrame) -> DataFrame:
    """Runs, physical records (duplicates and tombstones included) and bytes; no run gives zeros."""
    zero = F.lit(0).cast("long")
    return run_meta.agg(F.countDistinct("run_id").alias("runs"), F.coalesce(F.sum("record_count"), zero).alias("records"), F.coalesce(F.sum("bytes"), zero).alias("bytes"))


def stats_row(run_meta: DataFrame, mem_records: int, mem_bytes: int, wal_bytes: int, memtable_max_size: int) -> DataFrame:
    """One row of storage statistics. ``total_records`` counts versions, not live keys."""
    totals = storage_totals(run_meta)
    return totals.select(
        F.lit(mem_records).cast("long").alias("mem_records"), F.lit(mem_bytes // 1024).cast("long").alias("mem_kb"), F.col("runs").alias("sst_files"), F.col("records").alias("sst_records"),
        kilobytes(F.col("bytes")).alias("sst_kb"), F.lit(wal_bytes // 1024).cast("long").alias("wal_kb"), (F.col("records") + mem_records).alias("total_records"),
        F.lit(memtable_max_size // 1024).cast("long").alias("memtable_max_size"),
    )


def stats_text(row: dict, cached: int, capacity: int) -> str:
    """Three lines; the cache is counted in blocks of the configured size."""
    return f"MemTable: {row['mem_records']} records, ~{row['mem_kb']} KB\nRuns: {row['sst_files']} files\nCache: {cached}/{capacity} blocks"


def fill_ratio(used: Column, most: Column) -> Column:
    """0 to 1; full beyond the limit."""
    return F.least(F.lit(1.0), used / most)


def fill_ratios(stats: DataFrame, most_runs: int = 20) -> DataFrame:
    return stats.select(fill_ratio(F.col("mem_kb"), F.col("memtable_max_size")).alias("memtable_fill"), fill_ratio(F.col("sst_files"), F.lit(float(most_runs))).alias("run_fill"))


def total_size(log: DataFrame) -> DataFrame:
    """Estimated bytes of a log."""
    return log.agg(F.coalesce(F.sum(record_size()), F.lit(0).cast("long")).alias("bytes"))


def size_by_key(log: DataFrame) -> DataFrame:
    return log.groupBy("key").agg(F.sum(record_size()).alias("bytes"))


def ops_rate(events: DataFrame, ts: str, width: str = "6 seconds", step: str | None = "250 milliseconds") -> DataFrame:
    """Operations a window. A batch form of the gauge; the stream has the same with a watermark."""
    return events.groupBy(F.window(F.col(ts).cast("timestamp"), width, step or width)).agg(F.count(F.lit(1)).alias("ops")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "ops")
