"""Command line: one verb a line, case-insensitive; at most three parts, so that only the value may hold spaces."""

from __future__ import annotations

import itertools
import json
import sys
import time
from collections.abc import Callable
from typing import TextIO

from pyspark.sql import functions as F

from ..errors import KVError
from ..operators import query
from ..sources.ingest import import_text, synthetic
from ..sources.store import KVTable

HELP = """Commands:
  SET <key> <value>          write a key
  GET <key>                  read a key
  DELETE <key> | DEL <key>   remove a key
  SEARCH <text> [--prefix]   keys that contain, or start with, a text
  SCAN <prefix>              records whose key starts with a prefix
  ALL | KEYS | COUNT         all records, all keys, how many
  STATS [ALL]                storage statistics
  BATCH <n>                  write n synthetic records
  BATCH SET <file>           import key=value lines
  DEMO                       a scripted tour
  CLEAR, HELP or ?, EXIT, QUIT or Q"""
SHOWN = 20


def _text(value: bytes) -> str:
    return bytes(value).decode("utf-8", "replace")


class Repl:
    def __init__(self, table: KVTable, out: TextIO | None = None, limit: int | None = None):
        """``limit``: rows that listings show at most; the rest is counted. None shows all, read a partition at a time."""
        self.table, self.out, self.limit = table, out or sys.stdout, limit
        self.verbs: dict[str, Callable[[list[str]], None]] = {
            "SET": self._set, "GET": self._get, "DELETE": self._delete, "DEL": self._delete, "SEARCH": self._search, "SCAN": self._scan, "ALL": self._all, "KEYS": self._keys,
            "COUNT": lambda _: self._say(f"{self.table.count()} live records"), "STATS": self._stats, "BATCH": self._batch, "DEMO": self._demo,
            "HELP": lambda _: self._say(HELP), "?": lambda _: self._say(HELP), "CLEAR": lambda _: self._say("\x1b[2J\x1b[H"),
        }

    def _say(self, text: str) -> None:
        print(text, file=self.out)

    def run(self, lines: TextIO | None = None) -> None:
        for line in lines or sys.stdin:
            if not self.execute(line):
                return

    def execute(self, line: str) -> bool:
        """Run one line; False if it ends the session."""
        line = line.strip()
        if not line:
            return True
        parts = line.split(" ", 2)
        verb = parts[0].upper()
        if verb in ("EXIT", "QUIT", "Q"):
            self.table.flush()
            self._say("Bye")
            return False
        run = self.verbs.get(verb)
        if run is None:
            self._say(f"Unknown command '{verb}'; HELP lists them")
            return True
        try:
            run(parts[1:])
        except (KVError, OSError, ValueError) as e:
            self._say(f"Error: {e}")
        return True

    def _needs(self, args: list[str], n: int, usage: str) -> bool:
        if len(args) < n:
            self._say(f"Usage: {usage}")
        return len(args) >= n

    def _set(self, args: list[str]) -> None:
        if self._needs(args, 2, "SET <key> <value>"):
            self.table.put(args[0], args[1])
            self._say(f"'{args[0]}' set")

    def _get(self, args: list[str]) -> None:
        if self._needs(args, 1, "GET <key>"):
            value = self.table.get(args[0])
            self._say(f"'{args[0]}' not found" if value is None else f"'{args[0]}' = '{_text(value)}'")

    def _delete(self, args: list[str]) -> None:
        if self._needs(args, 1, "DELETE <key>"):
            self.table.delete(args[0])
            self._say(f"'{args[0]}' deleted")

    def _list(self, rows, none: str, head: str) -> None:
        n = rows.count()
        if not n:
            self._say(none)
            return
        self._say(head.format(n=n))
        for i, r in enumerate(rows.toLocalIterator() if self.limit is None else rows.limit(self.limit).collect(), 1):
            self._say(self._line(i, r))
        if self.limit is not None and n > self.limit:
            self._say(f"  ... and {n - self.limit} more")

    def _line(self, number: int, row) -> str:
        return "  " + " = ".join(_text(x) if isinstance(x, (bytes, bytearray)) else str(x) for x in row)

    def _search(self, args: list[str]) -> None:
        if self._needs(args, 1, "SEARCH <text> [--prefix]"):
            by_prefix = len(args) > 1 and args[1] == "--prefix"
            self._list(self.table.search_prefix(args[0]) if by_prefix else self.table.search(args[0]), "No records found", "{n} records found:")

    def _scan(self, args: list[str]) -> None:
        if self._needs(args, 1, "SCAN <prefix>"):
            self._list(self.table.search_prefix(args[0]), f"No records with prefix '{args[0]}'", "{n} records with prefix '" + args[0].replace("{", "{{").replace("}", "}}") + "':")

    def _all(self, _: list[str]) -> None:
        rows = query.table_view(self.table.scan(), SHOWN).toLocalIterator()
        first = next(rows, None)
        if first is None:
            self._say("The table is empty")
            return
        bar = "+" + "-" * (SHOWN + 2) + "+" + "-" * (SHOWN + 2) + "+"
        self._say(bar)
        for key, value in itertools.chain([("Key", "Value"), first], rows):
            self._say(f"| {key:<{SHOWN}} | {value:<{SHOWN}} |")
        self._say(bar)

    def _keys(self, _: list[str]) -> None:
        n = self.table.count()
        self._say(f"{n} keys" if n else "No keys found")
        for i, r in enumerate(self.table.keys().toLocalIterator(), 1):
            self._say(f"  {i}. {r.key}")

    def _stats(self, args: list[str]) -> None:
        if args and args[0].upper() == "ALL":
            self._say(json.dumps(self.table.stats_all().first().asDict(), indent=2))
        else:
            self._say(self.table.stats())

    def _batch(self, args: list[str]) -> None:
        if len(args) >= 2 and args[0].upper() == "SET":
            records, errors = import_text(self.table.spark, args[1])
            n, bad = records.count(), errors.orderBy("seq").collect()
            for r in bad:
                self._say(f"Line {r.seq} is not key=value")
            if n:
                self.table.write(records.select("key", "value", "seq"), order=F.col("seq"))
            self._say(f"{n} records imported" + (f", {len(bad)} errors" if bad else ""))
        elif args:
            if not args[0].isdigit():
                self._say("The count must be a whole number")
                return
            n, began = int(args[0]), time.monotonic()
            if n:
                self.table.write(synthetic(self.table.spark, n).select("key", "value"))
            took = max(time.monotonic() - began, 1e-9)
            self._say(f"{n} records written in {took:.2f} s ({n / took:.0f} a second)")
        else:
            self._say("Usage: BATCH <n> | BATCH SET <file>")

    def _demo(self, _: list[str]) -> None:
        for line in ("SET user:alice Alice", "SET user:bob Bob", "SET user:carol Carol", "GET user:alice", "SET user:alice Alice B.", "GET user:alice", "DEL user:bob", "GET user:bob", "BATCH 10", "SEARCH user:", "SEARCH user: --prefix", "COUNT", "STATS", "STATS ALL"):
            self._say(f"> {line}")
            self.execute(line)
