"""The command line as an operator's console: listings cut short, every command timed, a gauge of operations a second."""

from __future__ import annotations

import time
from collections import deque
from typing import TextIO

from pyspark.sql import functions as F

from ..operators import query
from ..operators.stats import fill_ratios
from ..sources.store import KVTable
from .repl import Repl

LISTED, LISTED_KEYS = 20, 30
#: Samples of the gauge, and the least seconds between two.
SAMPLES, STEP_S = 24, 0.25
DEMO_KEYS = 100


class Gauge:
    """Operations a second, over the samples of about the last six seconds."""

    def __init__(self, clock=time.monotonic):
        self.clock, self.total, self.history = clock, 0, deque(maxlen=SAMPLES)
        self._at, self._seen = clock(), 0

    def add(self, n: int = 1) -> None:
        self.total += n
        now = self.clock()
        if now - self._at >= STEP_S:
            self.history.append((self.total - self._seen) / (now - self._at))
            self._at, self._seen = now, self.total

    @property
    def rate(self) -> float:
        return self.history[-1] if self.history else 0.0


class Dashboard(Repl):
    def __init__(self, table: KVTable, out: TextIO | None = None):
        super().__init__(table, out, limit=LISTED)
        self.gauge = Gauge()
        self.verbs["FILL"] = self._fill

    def execute(self, line: str) -> bool:
        began = time.monotonic()
        more = super().execute(line)
        if line.strip():
            self.gauge.add()
            self._say(f"({(time.monotonic() - began) * 1000:.0f} ms, {self.gauge.rate:.1f} operations a second)")
        return more

    def _all(self, _: list[str]) -> None:
        self._list(self.table.scan(), "The table is empty", "{n} records:")

    def _keys(self, _: list[str]) -> None:
        n = self.table.count()
        self._say(f"{n} keys" if n else "No keys found")
        for i, r in enumerate(query.first_rows(self.table.live_keys(), LISTED_KEYS).collect(), 1):
            self._say(f"  {i}. {r.key}")
        if n > LISTED_KEYS:
            self._say(f"  ... and {n - LISTED_KEYS} more")

    def _fill(self, _: list[str]) -> None:
        row = fill_ratios(self.table.stats_all()).select(*(F.round(F.col(c) * 100, 1) for c in ("memtable_fill", "run_fill"))).first()
        self._say(f"Buffer {row[0]} % full, runs {row[1]} %")

    def _demo(self, _: list[str]) -> None:
        """Writes, reads and deletes of ``demo:`` keys, as batches: a log entry each, one read of many keys."""
        began = time.monotonic()
        names = [f"demo:{i:04d}" for i in range(DEMO_KEYS)]
        self.table.set_batch((k, f"demo-value-{i}") for i, k in enumerate(names))
        self._say(f"  {DEMO_KEYS} SET done")
        found = self.table.multi_get(self.table.spark.createDataFrame([(k,) for k in names[::10]], "key string")).where("found").count()
        self._say(f"  {found} GET done")
        self._say(f"  {self.table.delete_batch(names[:10])} DEL done")
        self.gauge.add(DEMO_KEYS + 20)
        self._say(f"Demo done in {time.monotonic() - began:.2f} s, {self.table.count()} live keys")
