"""Reads over a live snapshot [key, value]; every one is a lazy DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..functions.ranking import numbered
from ..functions.scalars import display, lossy_text

SYSTEM_PREFIX = "feature:"


def scan(snapshot: DataFrame) -> DataFrame:
    return snapshot.select("key", "value").orderBy("key")


def keys(snapshot: DataFrame) -> DataFrame:
    return snapshot.select("key").orderBy("key")


def count(snapshot: DataFrame) -> DataFrame:
    return snapshot.agg(F.count(F.lit(1)).alias("n"))


def get(snapshot: DataFrame, key: str) -> DataFrame:
    """No row if the key is missing or deleted."""
    return snapshot.where(F.col("key") == key)


def multi_get(snapshot: DataFrame, wanted: DataFrame) -> DataFrame:
    """(key, found, value) of each wanted key, once. The planner broadcasts ``wanted`` if its size allows."""
    wanted = wanted.select("key").distinct()
    hits = snapshot.select(F.col("key"), F.col("value"), F.lit(True).alias("found"))
    return wanted.join(hits, "key", "left").select("key", F.coalesce("found", F.lit(False)).alias("found"), "value")


def search(snapshot: DataFrame, pattern: str) -> DataFrame:
    """Keys that contain ``pattern``: literal, case-sensitive, never the value; an empty pattern matches all."""
    return scan(snapshot.where(F.col("key").contains(pattern)))


def search_prefix(snapshot: DataFrame, prefix: str) -> DataFrame:
    return scan(snapshot.where(F.col("key").startswith(prefix)))


def range_scan(snapshot: DataFrame, start: str | None = None, stop: str | None = None) -> DataFrame:
    """``start`` inclusive, ``stop`` exclusive."""
    if start is not None:
        snapshot = snapshot.where(F.col("key") >= start)
    if stop is not None:
        snapshot = snapshot.where(F.col("key") < stop)
    return scan(snapshot)


def seek(snapshot: DataFrame, key: str) -> DataFrame:
    """The first row at or after ``key``."""
    return snapshot.where(F.col("key") >= key).orderBy("key").limit(1)


def page_after(snapshot: DataFrame, last: str | None, size: int) -> DataFrame:
    """The next page in key order; ``last`` is the final key of the page before."""
    rest = snapshot if last is None else snapshot.where(F.col("key") > last)
    return rest.orderBy("key").limit(size)


def without_system(snapshot: DataFrame) -> DataFrame:
    return snapshot.where(~F.col("key").startswith(SYSTEM_PREFIX))


def first_rows(snapshot: DataFrame, n: int) -> DataFrame:
    """For display: ``n`` rows in key order (a top-k, not a sort)."""
    return snapshot.orderBy("key").limit(n)


def as_text(snapshot: DataFrame) -> DataFrame:
    return snapshot.select("key", lossy_text("value").alias("value"))


def table_view(snapshot: DataFrame, width: int = 20) -> DataFrame:
    return snapshot.select(display("key", width).alias("key"), display(lossy_text("value"), width).alias("value"))


def numbered_keys(snapshot: DataFrame) -> DataFrame:
    return numbered(snapshot.select("key"), "key", "n").select("n", "key")


def cursor(log: DataFrame, start: str | None = None) -> DataFrame:
    """Raw versions in key order, newest first within a key; tombstones are visible at this level."""
    rows = log if start is None else log.where(F.col("key") >= start)
    return rows.orderBy("key", F.desc("seq"))


def cursor_seek(log: DataFrame, key: str) -> DataFrame:
    """The first raw version at or after ``key``."""
    return log.where(F.col("key") >= key).orderBy("key", F.desc("seq")).limit(1)


class Cursor:
    """Raw versions in key order, one at a time, tombstones visible.

    ``rows`` makes the sorted rows from a key on; the driver holds one partition of them. ``seek`` goes either way, to
    the first version at or after a key. Past the end ``row`` is None, ``advance`` does nothing, and a failed read raises.
    """

    def __init__(self, rows: Callable[[str | None], DataFrame], start: str | None = None):
        self._from = rows
        self.seek(start)

    def seek(self, key: str | None) -> Row | None:
        self._rest = self._from(key).toLocalIterator()
        self.row: Row | None = next(self._rest, None)
        return self.row

    @property
    def valid(self) -> bool:
        return self.row is not None

    def advance(self) -> Row | None:
        if self.row is not None:
            self.row = next(self._rest, None)
        return self.row


def membership(run: DataFrame, wanted: DataFrame) -> DataFrame:
    """The wanted keys that a run holds, tombstones included: exact, where a filter would be probable."""
    return wanted.select("key").distinct().join(run.select("key").distinct(), "key", "left_semi")
