"""Feature flags: one JSON document in the table, under a fixed key."""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ConcurrentModification, DeserializationFailed, KVError
from ..functions.scalars import lossy_text
from ..sources.store import KVTable

KEY = "feature:all"
DOCUMENT = "version bigint, flags map<string, struct<enabled: boolean, description: string>>"
RETRIES, BACKOFF_S = 5, 0.01


def parse(documents: DataFrame, column: str = "value") -> DataFrame:
    """(version, name, enabled, description) of flag documents, one row a flag."""
    doc = documents.select(F.from_json(lossy_text(column), DOCUMENT).alias("d"))
    flags = doc.select("d.version", F.explode("d.flags").alias("name", "flag"))
    return flags.select("version", "name", F.coalesce("flag.enabled", F.lit(False)).alias("enabled"), F.coalesce("flag.description", F.lit("")).alias("description"))


def enabled(documents: DataFrame, name: str, column: str = "value") -> DataFrame:
    """(enabled) of one flag; an unknown flag is off."""
    doc = documents.select(F.from_json(lossy_text(column), DOCUMENT).alias("d"))
    return doc.select(F.coalesce(F.element_at("d.flags", F.lit(name))["enabled"], F.lit(False)).alias("enabled"))


class FeatureClient:
    """Reads through a cache of ``ttl_s`` seconds. Updates read, change, and swap the document if it is still the one read.

    The swap is the table's (``KVTable.put_if``), so it holds between processes too; a lost race is tried again.
    """

    def __init__(self, table: KVTable, ttl_s: float = 10.0):
        self.table, self.ttl_s = table, ttl_s
        self._cached: tuple[dict, float] | None = None

    def _stored(self) -> dict | None:
        raw = self.table.get(KEY)
        return None if raw is None else self._parse(raw)

    @staticmethod
    def _parse(raw: bytes) -> dict:
        try:
            doc = json.loads(raw)
            return {"version": int(doc.get("version", 0)), "flags": {k: {"enabled": bool(f["enabled"]), "description": f.get("description", "")} for k, f in doc.get("flags", {}).items()}}
        except (ValueError, KeyError, TypeError, AttributeError) as e:
            raise DeserializationFailed(f"feature document: {e}") from e

    def load(self) -> dict:
        if self._cached and time.monotonic() - self._cached[1] < self.ttl_s:
            return self._cached[0]
        doc = self._stored()
        if doc is None:  # the default is written, but not cached
            doc = {"version": 0, "flags": {}}
            self.table.put(KEY, json.dumps(doc))
            return doc
        self._cached = (doc, time.monotonic())
        return doc

    def is_enabled(self, name: str) -> bool:
        return self.load()["flags"].get(name, {"enabled": False})["enabled"]

    def list_all(self) -> dict[str, dict]:
        return dict(self.load()["flags"])

    def _change(self, change) -> bool:
        for attempt in range(RETRIES):
            try:
                self.table.refresh()
                raw = self.table.get(KEY)
                doc = {"version": 0, "flags": {}} if raw is None else self._parse(raw)
                flags = dict(doc["flags"])
                done = change(flags)
                if done:
                    self.table.put_if(KEY, json.dumps({"version": doc["version"] + 1, "flags": flags}), raw)
                    self._cached = None
                return done
            except KVError:
                if attempt == RETRIES - 1:
                    raise
                time.sleep(BACKOFF_S * 2**attempt)
        raise ConcurrentModification("unreachable")

    def set_flag(self, name: str, on: bool, description: str | None = None) -> None:
        """Without a description, that of an existing flag stays."""

        def change(flags: dict) -> bool:
            kept = flags.get(name, {}).get("description", "") if description is None else description
            flags[name] = {"enabled": on, "description": kept}
            return True

        self._change(change)

    def remove_flag(self, name: str) -> bool:
        return self._change(lambda flags: flags.pop(name, None) is not None)
