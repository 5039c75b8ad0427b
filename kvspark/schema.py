"""Row shapes: versions of keys, and the metadata of runs."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: One version of a key. ``seq`` is the order of arrival and alone decides which version is newest; ``ts_ns`` is kept
#: but never compared. A tombstone has an empty value; an empty value without the flag is a live value.
RECORD_SCHEMA = T.StructType([
    T.StructField("key", T.StringType(), False),
    T.StructField("value", T.BinaryType(), False),
    T.StructField("ts_ns", T.LongType(), False),
    T.StructField("is_deleted", T.BooleanType(), False),
    T.StructField("seq", T.LongType(), False),
])

RUN_META_SCHEMA = T.StructType([
    T.StructField("run_id", T.LongType(), False),
    T.StructField("record_count", T.LongType(), False),
    T.StructField("min_key", T.StringType(), True),
    T.StructField("max_key", T.StringType(), True),
    T.StructField("min_seq", T.LongType(), False),
    T.StructField("max_seq", T.LongType(), False),
    T.StructField("bytes", T.LongType(), False),
    T.StructField("created_ns", T.LongType(), False),
    T.StructField("path", T.StringType(), False),
])

#: Fixed per-record overhead of the size estimate.
RECORD_OVERHEAD = 32


def put_row(key: str, value: bytes, seq: int, ts_ns: int | None = None) -> tuple:
    return (key, value, time.time_ns() if ts_ns is None else ts_ns, False, seq)


def tombstone_row(key: str, seq: int, ts_ns: int | None = None) -> tuple:
    return (key, b"", time.time_ns() if ts_ns is None else ts_ns, True, seq)


def as_log(df: DataFrame, key: Column, value: Column, seq: Column, is_deleted: Column | None = None, ts_ns: Column | None = None) -> DataFrame:
    """Any rows as a version log."""
    dead = F.lit(False) if is_deleted is None else F.coalesce(is_deleted, F.lit(False))
    return df.select(
        key.cast("string").alias("key"), F.when(dead, F.lit(b"")).otherwise(F.coalesce(value.cast("binary"), F.lit(b""))).alias("value"),
        (F.lit(0) if ts_ns is None else ts_ns).cast("long").alias("ts_ns"), dead.alias("is_deleted"), seq.cast("long").alias("seq"),
    )


def record_size(key: Column | str = "key", value: Column | str = "value") -> Column:
    """Estimated bytes of a record: key, value, and a fixed overhead."""
    return (F.octet_length(key) + F.octet_length(value) + RECORD_OVERHEAD).cast("long")
