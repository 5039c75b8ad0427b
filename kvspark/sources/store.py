"""Persistent tables: immutable key-sorted Parquet runs, a manifest, a write buffer with a log.

    <root>/runs/run_id=<n>-<x>/part-*.parquet one version a key, range-partitioned and sorted by key, Bloom filter on key
    <root>/manifest/<n>.json                 the list of runs; the greatest number is current
    <root>/wal/<seq>.json                    single writes that no run holds yet

A run is written in full before the manifest that lists it, and a manifest is published by a rename that never
replaces, so readers see all of a run or none, and of two writers the second gets ``ConcurrentModification``. Runs that
no manifest lists are ignored. Readers prune runs by the key ranges in the manifest before Spark sees a path; inside
runs, Parquet's statistics and Bloom filters prune further.

Bulk writes (``write``) never pass the driver. ``put`` and ``delete`` are for single keys: a log entry, the buffer, and
a run when the buffer is full.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..errors import ConcurrentModification, CorruptedData, EmptyRun, InvalidRunFormat, RecordTooLarge, WalCorruption
from ..operators import query, stats
from ..operators.snapshot import live, live_keys, newest_wins, union_layers
from ..schema import RECORD_OVERHEAD, RECORD_SCHEMA, RUN_META_SCHEMA, put_row, record_size, tombstone_row
from .files import Files

WAL_ENTRY_LIMIT = 32 << 20
#: A row group's Bloom filter takes the smallest of this many sizes, each half the next, that holds its keys at the
#: configured rate: 256 bytes to 4 MB.
BLOOM_MOST, BLOOM_SIZES = 4 << 20, 15


@dataclass
class Memtable:
    """Newest version of each buffered key; the last insert wins, whatever its timestamp."""

    max_size: int
    rows: dict[str, tuple] = field(default_factory=dict)
    size_bytes: int = 0

    @staticmethod
    def estimate(row: tuple) -> int:
        return len(row[0].encode()) + len(row[1]) + RECORD_OVERHEAD

    def insert(self, row: tuple) -> None:
        old = self.rows.get(row[0])
        self.size_bytes += self.estimate(row) - (self.estimate(old) if old else 0)
        self.rows[row[0]] = row

    def get(self, key: str) -> tuple | None:
        """The buffered version, tombstones included."""
        return self.rows.get(key)

    def should_flush(self) -> bool:
        return self.size_bytes >= self.max_size

    def clear(self) -> int:
        n = len(self.rows)
        self.rows, self.size_bytes = {}, 0
        return n

    def ordered(self, start: str | None = None) -> list[tuple]:
        """Versions in the byte order of their keys, from ``start`` on."""
        floor = None if start is None else start.encode()
        return [self.rows[k] for k in sorted(self.rows, key=str.encode) if floor is None or k.encode() >= floor]


class KVTable:
    def __init__(self, spark: SparkSession, root: str, config: Config | None = None, skip_corrupt: bool = False):
        self.spark, self.config, self.skip_corrupt = spark, config or Config(), skip_corrupt
        self.files = Files(spark, root)
        for part in ("runs", "manifest", "wal"):
            self.files.mkdirs(self.files.at(part))
        self.version, self.state = self._current()
        if skip_corrupt:
            self.state["runs"] = [r for r in self.state["runs"] if self.files.exists(r["path"])]
        elif lost := [r["path"] for r in self.state["runs"] if not self.files.exists(r["path"])]:
            raise CorruptedData(f"the manifest lists runs that are gone: {lost}")
        self.memtable = Memtable(self.config.memtable_max_size)
        self._kept: DataFrame | None = None
        self._replay()

    @classmethod
    def open(cls, spark: SparkSession, root: str, config: Config | None = None, **options) -> KVTable:
        return cls(spark, root, config, **options)

    # -- manifest and log ------------------------------------------------------------------------------------------

    def _current(self) -> tuple[int, dict]:
        names = [n for n in self.files.names(self.files.at("manifest")) if n.endswith(".json")]
        if not names:
            return 0, {"runs": [], "next_run": 1, "next_seq": 1, "batches": {}, "wal": 0}
        try:
            state = json.loads(self.files.read(self.files.at("manifest", names[-1])))
            return int(names[-1][:-5]), {k: state[k] for k in ("runs", "next_run", "next_seq", "batches", "wal")}
        except (ValueError, KeyError, TypeError) as e:
            raise CorruptedData(f"manifest {names[-1]}: {e}") from e

    def _publish(self, state: dict) -> None:
        if not self.files.create(self.files.at("manifest", f"{self.version + 1:012d}.json"), json.dumps(state).encode()):
            raise ConcurrentModification(f"manifest {self.version + 1} exists already")
        self.version, self.state = self.version + 1, state

    def refresh(self) -> None:
        """See what other writers have published since."""
        self.version, self.state = self._current()
        self._past_buffer()

    def _past_buffer(self) -> None:
        """The next sequence number lies past what is buffered, which no manifest knows of."""
        if self.memtable.rows:
            self.state["next_seq"] = max(self.state["next_seq"], 1 + max(r[4] for r in self.memtable.rows.values()))

    def _replay(self) -> None:
        for name in self.files.names(self.files.at("wal")):
            if not name.endswith(".json"):
                continue  # a draft that was never published
            path = self.files.at("wal", name)
            try:
                if not 0 < self.files.size(path) <= WAL_ENTRY_LIMIT:
                    raise ValueError("empty or oversized entry")
                for key, value, ts, dead, seq in json.loads(self.files.read(path)):
                    if not self._flushed(seq):  # an entry that a crash kept from being removed after its run was published
                        self.memtable.insert((key, bytes.fromhex(value), ts, bool(dead), seq))
            except (ValueError, TypeError) as e:
                raise WalCorruption(f"{name}: {e}") from e
        self._past_buffer()

    def _flushed(self, seq: int) -> bool:
        return seq <= self.state["wal"]

    def _log(self, rows: list[tuple]) -> None:
        entry = [(k, v.hex(), ts, dead, seq) for k, v, ts, dead, seq in rows]
        if not self.files.create(self.files.at("wal", f"{rows[0][4]:020d}.json"), json.dumps(entry).encode()):
            raise ConcurrentModification(f"log entry {rows[0][4]} exists already")

    def _check(self, key: str, value: bytes) -> None:
        most = self.config.max_record_bytes
        if most is not None and (size := len(key.encode()) + len(value) + RECORD_OVERHEAD) > most:
            raise RecordTooLarge(f"key {key[:40]!r}: {size} bytes, at most {most} are allowed")

    def _write(self, rows: list[tuple]) -> None:
        self._log(rows)
        for row in rows:
            self.memtable.insert(row)
        self.state["next_seq"] = rows[-1][4] + 1
        if self.memtable.should_flush():
            self.flush()

    # -- writes ----------------------------------------------------------------------------------------------------

    def put(self, key: str, value: bytes | str) -> None:
        self.set_batch([(key, value)])

    def delete(self, key: str) -> None:
        """Writes a tombstone; a key that was never written is no error."""
        self.delete_batch([key])

    def set_batch(self, records: Iterable[tuple[str, bytes | str]]) -> int:
        """One log entry for all; returns how many were given, repeats included."""
        base, rows = self.state["next_seq"], []
        for key, value in records:
            value = value.encode() if isinstance(value, str) else bytes(value)
            self._check(key, value)
            rows.append(put_row(key, value, base + len(rows)))
        if rows:
            self._write(rows)
        return len(rows)

    def delete_batch(self, keys: Iterable[str]) -> int:
        base = self.state["next_seq"]
        rows = [tombstone_row(key, base + i) for i, key in enumerate(keys)]
        if rows:
            self._write(rows)
        return len(rows)

    def put_if(self, key: str, value: bytes | str, expected: bytes | None) -> None:
        """Write ``key`` in a run of its own if its published value is still ``expected`` (None: no value).

        Compare and swap between processes: of two writers that read the same manifest, one publishes the next, and the
        other gets ``ConcurrentModification``.
        """
        self.refresh()
        self.flush()
        if self.get(key) != expected:
            raise ConcurrentModification(f"{key!r} has changed")
        value = value.encode() if isinstance(value, str) else bytes(value)
        self._check(key, value)
        self._add_run(self.spark.createDataFrame([put_row(key, value, self.state["next_seq"])], RECORD_SCHEMA), None)

    def write(self, rows: DataFrame, order: Column | None = None, batch: tuple[str, int] | None = None) -> int | None:
        """Append rows (key, value, and optionally is_deleted and ts_ns) as one run, in bulk.

        ``order``: a Column that ranks rows of one key; the greatest wins. Without it, later rows of the input win.
        ``batch``: a stream's name and the number of one of its batches, which makes the write idempotent: batches of a
        stream come in ascending order, so the manifest holds the greatest number of each, and a number up to that
        changes nothing.
        Returns the run's id, or None if nothing was written.
        """
        if batch is not None and batch[1] <= self.state["batches"].get(batch[0], -1):
            return None
        self.flush()  # what is buffered is older than this
        base = self.state["next_seq"]
        have = set(rows.columns)
        log = rows.select(
            F.col("key").cast("string").alias("key"), F.coalesce(F.col("value").cast("binary"), F.lit(b"")).alias("value"),
            (F.col("ts_ns") if "ts_ns" in have else F.lit(time.time_ns())).cast("long").alias("ts_ns"), (F.col("is_deleted") if "is_deleted" in have else F.lit(False)).alias("is_deleted"),
            F.monotonically_increasing_id().alias("_row"), *([] if order is None else [order.alias("_order")]),
        )
        if self.config.max_record_bytes is not None:
            log = log.withColumn("value", F.when(record_size() > self.config.max_record_bytes, F.raise_error(F.concat(F.lit("record too large: "), F.col("key")))).otherwise(F.col("value")))
        if order is not None:
            log = newest_wins(log.withColumn("seq", F.struct("_order", "_row")))
        # sequence numbers follow the input's order; they need not be dense
        log = log.withColumn("seq", F.lit(base) + F.col("_row")).select("key", "value", "ts_ns", "is_deleted", "seq")
        return self._add_run(log if order is not None else newest_wins(log), batch)

    def flush(self) -> int | None:
        """Write the buffer as a run; nothing buffered, nothing written."""
        if not self.memtable.rows:
            return None
        rows = self.memtable.ordered()
        last = max(r[4] for r in rows)
        run = self._add_run(self.spark.createDataFrame(rows, RECORD_SCHEMA), None, wal=last)
        self.memtable.clear()
        for name in self.files.names(self.files.at("wal")):
            if not name.endswith(".json") or int(name[:-5]) <= last:
                self.files.delete(self.files.at("wal", name))
        return run

    def write_run(self, log: DataFrame, run_id: int) -> dict:
        """Write the one-version-a-key ``log`` as a run and describe it. Of two writers, neither touches the other's files."""
        path = self.files.at("runs", f"run_id={run_id}-{uuid.uuid4().hex[:12]}")
        (
            log.repartitionByRange("key").sortWithinPartitions("key").write.option("compression", "lz4_raw")
            .option("parquet.bloom.filter.enabled#key", "true").option("parquet.bloom.filter.fpp#key", str(self.config.bloom_false_positive_rate))
            .option("parquet.bloom.filter.adaptive.enabled", "true").option("parquet.bloom.filter.candidates.number#key", BLOOM_SIZES).option("parquet.bloom.filter.max.bytes", BLOOM_MOST)
            .option("parquet.page.size", str(max(self.config.block_size, 64 << 10)))
            .option("parquet.page.write-checksum.enabled", "true").parquet(path)
        )
        row = self.spark.read.schema(RECORD_SCHEMA).parquet(path).agg(F.count(F.lit(1)), F.min("key"), F.max("key"), F.min("seq"), F.max("seq")).first()
        if not row[0]:
            self.files.delete(path)
            raise EmptyRun("a run needs at least one record")
        return {"run_id": run_id, "record_count": row[0], "min_key": row[1], "max_key": row[2], "min_seq": row[3], "max_seq": row[4], "bytes": self.files.size(path), "created_ns": time.time_ns(), "path": path}

    def _add_run(self, log: DataFrame, batch: tuple[str, int] | None, wal: int | None = None) -> int | None:
        run_id = self.state["next_run"]
        state = self.state | {"next_run": run_id + 1}
        try:
            meta = self.write_run(log, run_id)
            state |= {"runs": [*self.state["runs"], meta], "next_seq": max(self.state["next_seq"], meta["max_seq"] + 1)}
        except EmptyRun:
            meta = None
        if batch is not None:
            state["batches"] = self.state["batches"] | {batch[0]: batch[1]}
        if wal is not None:
            state["wal"] = wal
        try:
            self._publish(state)
        except ConcurrentModification:
            if meta:
                self.files.delete(meta["path"])
            raise
        return meta and meta["run_id"]

    def replace_runs(self, old: list[int], new: dict | None) -> None:
        """Publish a manifest in which ``new`` stands in for the neighbouring runs ``old``."""
        runs = [r for r in self.state["runs"] if r["run_id"] not in old]
        if new is not None:
            at = next(i for i, r in enumerate(self.state["runs"]) if r["run_id"] in old)
            runs.insert(at, new)
        self._publish(self.state | {"runs": runs, "next_run": self.state["next_run"] + 1})

    # -- reads -----------------------------------------------------------------------------------------------------

    @property
    def runs(self) -> list[dict]:
        return list(self.state["runs"])

    def run_meta(self) -> DataFrame:
        return self.spark.createDataFrame([tuple(r[f.name] for f in RUN_META_SCHEMA) for r in self.runs], RUN_META_SCHEMA)

    def pruned(self, start: str | None = None, stop: str | None = None) -> list[dict]:
        """Runs whose key range meets [start, stop]; both ends inclusive, None is open."""
        low = None if start is None else start.encode()
        high = None if stop is None else stop.encode()
        return [r for r in self.runs if (low is None or r["max_key"].encode() >= low) and (high is None or r["min_key"].encode() <= high)]

    def read_run(self, run_id: int) -> DataFrame:
        """All versions of one run, tombstones included."""
        path = next((r["path"] for r in self.runs if r["run_id"] == run_id), None)
        if path is None:
            raise InvalidRunFormat(f"no run {run_id}")
        return self.spark.read.schema(RECORD_SCHEMA).parquet(path)

    def log(self, runs: list[dict] | None = None) -> DataFrame:
        """All versions of the given (else all) runs and of the buffer."""
        runs = self.runs if runs is None else runs
        layers = []
        if runs:
            layers.append(self.spark.read.schema(RECORD_SCHEMA).parquet(*[r["path"] for r in runs]))
        if self.memtable.rows or not layers:
            layers.append(self.spark.createDataFrame(self.memtable.ordered(), RECORD_SCHEMA))
        return union_layers(*layers)

    def persist(self, level: StorageLevel = StorageLevel.MEMORY_AND_DISK) -> DataFrame:
        """Keep the live snapshot of now in the executors' memory; ``cached`` tells how, ``unpersist`` lets it go."""
        self.unpersist()
        self._kept = self.snapshot().persist(level)
        return self._kept

    def cached(self) -> StorageLevel | None:
        return None if self._kept is None else self._kept.storageLevel

    def cached_bytes(self) -> int:
        """What the kept snapshot takes in the executors' memory and on their disks by now."""
        if self._kept is None:
            return 0
        held = self.spark._jsparkSession.sharedState().cacheManager().lookupCachedData(self._kept._jdf)
        if held.isEmpty():
            return 0
        rdd = held.get().cachedRepresentation().cacheBuilder().cachedColumnBuffers().id()
        return sum(i.memSize() + i.diskSize() for i in self.spark.sparkContext._jsc.sc().getRDDStorageInfo() if i.id() == rdd)

    def unpersist(self) -> None:
        if self._kept is not None:
            self._kept.unpersist()
        self._kept = None

    def _merged(self, runs: list[dict]) -> bool:
        """One layer holds one version a key: no merge, hence no shuffle."""
        return len(runs) + bool(self.memtable.rows) <= 1

    def snapshot(self, start: str | None = None, stop: str | None = None) -> DataFrame:
        """[key, value] of live keys; ``start`` and ``stop`` (inclusive) only prune runs and rows."""
        runs = self.pruned(start, stop)
        log = self.log(runs)
        if start is not None:
            log = log.where(F.col("key") >= start)
        if stop is not None:
            log = log.where(F.col("key") <= stop)
        return live(log, merged=self._merged(runs))

    def get(self, key: str) -> bytes | None:
        held = self.memtable.get(key)
        if held is not None:
            return None if held[3] else held[1]
        row = query.get(self.snapshot(key, key), key).first()
        return None if row is None else bytes(row["value"])

    def get_from_run(self, run_id: int, key: str) -> DataFrame:
        return self.read_run(run_id).where(F.col("key") == key)

    def multi_get(self, wanted: DataFrame) -> DataFrame:
        return query.multi_get(self.snapshot(), wanted)

    def scan(self) -> DataFrame:
        return query.scan(self.snapshot())

    def live_keys(self) -> DataFrame:
        return live_keys(self.log(), merged=self._merged(self.runs))

    def keys(self) -> DataFrame:
        return self.live_keys().orderBy("key")

    def count(self) -> int:
        return self.live_keys().count()

    def search(self, pattern: str) -> DataFrame:
        return query.search(self.snapshot(), pattern)

    def search_prefix(self, prefix: str) -> DataFrame:
        low = prefix.encode()
        runs = [r for r in self.runs if r["max_key"].encode() >= low and r["min_key"].encode()[: len(low)] <= low]
        return query.search_prefix(live(self.log(runs), merged=self._merged(runs)), prefix)

    def range_scan(self, start: str | None = None, stop: str | None = None) -> DataFrame:
        return query.range_scan(self.snapshot(start, stop), start, stop)

    def seek(self, key: str) -> DataFrame:
        return query.seek(self.snapshot(key), key)

    def page_after(self, last: str | None, size: int) -> DataFrame:
        return query.page_after(self.snapshot(last), last, size)

    def cursor(self, start: str | None = None) -> DataFrame:
        return query.cursor(self.log(self.pruned(start)), start)

    def pull(self, start: str | None = None) -> query.Cursor:
        """A cursor over raw versions that the caller advances row by row."""
        return query.Cursor(self.cursor, start)

    def records(self, start: str | None = None, stop: str | None = None) -> Iterator[tuple[str, bytes]]:
        """Live records in key order, ``stop`` exclusive; the driver holds one partition at a time."""
        return ((r["key"], bytes(r["value"])) for r in self.range_scan(start, stop).toLocalIterator())

    def wal_bytes(self) -> int:
        return self.files.size(self.files.at("wal"))

    def stats_all(self) -> DataFrame:
        return stats.stats_row(self.run_meta(), len(self.memtable.rows), self.memtable.size_bytes, self.wal_bytes(), self.config.memtable_max_size)

    def stats(self) -> str:
        block = self.config.block_size
        return stats.stats_text(self.stats_all().first().asDict(), math.ceil(self.cached_bytes() / block), max(1, self.config.block_cache_size_mb * (1 << 20) // block))

    def verify(self) -> None:
        """Read every run whole and compare it with the manifest."""
        for r in self.runs:
            try:
                n = self.read_run(r["run_id"]).select(F.count(F.lit(1)), F.sum(F.octet_length("value"))).first()[0]
            except Exception as e:
                raise CorruptedData(f"run {r['run_id']}: {e}") from e
            if n != r["record_count"]:
                raise CorruptedData(f"run {r['run_id']} holds {n} records, not {r['record_count']}")
