"""Validated settings, and settings from the environment."""

from __future__ import annotations

import os
import warnings
from collections.abc import Mapping
from dataclasses import dataclass, replace

from .errors import InvalidBlockSize, InvalidBloomRate, InvalidCacheSize, InvalidIndexInterval, InvalidMemtableSize

KIB, MIB, GIB = 1 << 10, 1 << 20, 1 << 30


@dataclass(frozen=True)
class Config:
    """Bounds are checked on creation; values that are legal but doubtful warn.

    memtable_max_size: bytes buffered before a run is written. block_size: Parquet page size. block_cache_size_mb:
    kept for callers that size caches. sparse_index_interval: accepted; Parquet's column index has no such knob.
    bloom_false_positive_rate: of the filter on key in every run. max_record_bytes: optional limit of one record.
    """

    memtable_max_size: int = 4 * MIB
    block_size: int = 4096
    block_cache_size_mb: int = 64
    sparse_index_interval: int = 16
    bloom_false_positive_rate: float = 0.01
    max_record_bytes: int | None = None

    def __post_init__(self) -> None:
        if not KIB <= self.memtable_max_size <= GIB:
            raise InvalidMemtableSize(f"memtable_max_size {self.memtable_max_size} is not within {KIB} and {GIB}")
        if not 256 <= self.block_size <= MIB:
            raise InvalidBlockSize(f"block_size {self.block_size} is not within 256 and {MIB}")
        if self.block_cache_size_mb < 1:
            raise InvalidCacheSize("block_cache_size_mb must be 1 or more")
        if self.block_cache_size_mb > 10240:
            warnings.warn(f"block_cache_size_mb {self.block_cache_size_mb} is very large", stacklevel=2)
        if self.sparse_index_interval < 1:
            raise InvalidIndexInterval("sparse_index_interval must be 1 or more")
        if self.sparse_index_interval > 1000:
            warnings.warn(f"sparse_index_interval {self.sparse_index_interval} is very large", stacklevel=2)
        if not 0.0 < self.bloom_false_positive_rate < 1.0:
            raise InvalidBloomRate(f"bloom_false_positive_rate {self.bloom_false_positive_rate} is not within 0 and 1")
        if self.bloom_false_positive_rate > 0.1:
            warnings.warn(f"bloom_false_positive_rate {self.bloom_false_positive_rate} makes the filter weak", stacklevel=2)

    def with_(self, **changes) -> Config:
        return replace(self, **changes)


@dataclass(frozen=True)
class ServerConfig:
    host: str = "0.0.0.0"
    port: int = 8080
    max_json_payload_size: int = 50 * MIB
    max_raw_payload_size: int = 50 * MIB
    feature_cache_ttl_secs: int = 10
    auth_enabled: bool = False
    token_expiry_days: int | None = 30
    page_size: int = 10_000

    @classmethod
    def from_env(cls, env: Mapping[str, str] | None = None) -> ServerConfig:
        """Unparsable values fall back to the defaults; a missing expiry means that tokens do not expire."""
        env = os.environ if env is None else env

        def number(name: str, default: int | None) -> int | None:
            try:
                return int(env[name])
            except (KeyError, ValueError):
                return default

        return cls(
            host=env.get("HOST", cls.host), port=number("PORT", cls.port), max_json_payload_size=number("MAX_JSON_PAYLOAD_SIZE", cls.max_json_payload_size),
            max_raw_payload_size=number("MAX_RAW_PAYLOAD_SIZE", cls.max_raw_payload_size), feature_cache_ttl_secs=number("FEATURE_CACHE_TTL", cls.feature_cache_ttl_secs),
            auth_enabled=env.get("API_AUTH_ENABLED", "false") == "true", token_expiry_days=number("API_TOKEN_EXPIRY_DAYS", None),
            page_size=max(1, number("PAGE_SIZE", cls.page_size)),
        )
