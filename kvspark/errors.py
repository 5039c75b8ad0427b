"""Errors of the engine. ``KVError`` is the root; messages say what was wrong with what."""

from __future__ import annotations


class KVError(Exception):
    """Root of all errors raised by the engine."""


class SerializationFailed(KVError):
    pass


class DeserializationFailed(KVError):
    pass


class CorruptedData(KVError):
    """A run whose files are missing or do not match the manifest."""


class InvalidRunFormat(KVError):
    """Files in a run's place that are no run."""


class WalCorruption(KVError):
    """A log entry that cannot be replayed; opening fails rather than lose writes."""


class ConcurrentModification(KVError):
    """Another writer has committed first."""


class RecordTooLarge(KVError):
    """A record over ``max_record_bytes``."""


class EmptyRun(KVError):
    """A run without a record was asked for."""


class InvalidBlockSize(KVError):
    pass


class InvalidCacheSize(KVError):
    pass


class InvalidIndexInterval(KVError):
    pass


class InvalidBloomRate(KVError):
    pass


class InvalidMemtableSize(KVError):
    pass
