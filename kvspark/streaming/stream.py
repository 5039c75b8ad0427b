"""Streams into tables, and rates of streams.

``foreachBatch`` delivers at least once, so each micro-batch is written under the stream's name and the batch's number;
a replay finds in the manifest that the stream is past that number and adds nothing. The checkpoint takes the place of a write-ahead log.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..sources.store import KVTable


def batch_writer(table: KVTable, name: str, order: Column | None = None) -> Callable[[DataFrame, int], None]:
    """The function that writes one micro-batch: newest version a key, one run, once."""

    def write(rows: DataFrame, batch_id: int) -> None:
        table.write(rows, order=order, batch=(name, batch_id))

    return write


def into_table(rows: DataFrame, table: KVTable, name: str, checkpoint: str, order: Column | None = None) -> DataStreamWriter:
    """A writer, ready to start, of streaming rows (key, value, optionally is_deleted and ts_ns) into ``table``."""
    return rows.writeStream.foreachBatch(batch_writer(table, name, order)).option("checkpointLocation", checkpoint).queryName(name)


def sliding_rate(events: DataFrame, ts: str, width: str = "6 seconds", step: str = "250 milliseconds", late: str = "10 seconds") -> DataFrame:
    """Operations a sliding window; state is dropped once the watermark has passed a window's end."""
    stamped = events.select(F.col(ts).cast("timestamp").alias("ts")).withWatermark("ts", late)
    counts = stamped.groupBy(F.window("ts", width, step)).agg(F.count(F.lit(1)).alias("ops"))
    seconds = F.unix_micros("window.end") - F.unix_micros("window.start")
    return counts.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "ops", (F.col("ops") * 1_000_000 / seconds).alias("ops_per_second"))


def live_view(log: DataFrame) -> DataFrame:
    """Newest version of each key of a stream, for output mode ``update`` or ``complete``; state is one row a key.

    Values are small here by intent: for large ones, stream into a table.
    """
    newest = log.groupBy("key").agg(F.max_by(F.struct("value", "is_deleted"), "seq").alias("r"))
    return newest.select("key", "r.value", "r.is_deleted")
