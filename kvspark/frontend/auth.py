"""Bearer tokens: created once, stored as hashes in process memory, checked with permissions."""

from __future__ import annotations

import base64
import hashlib
import hmac
import secrets
import threading
import time
import uuid
from dataclasses import dataclass

READ, WRITE, DELETE, ADMIN = "Read", "Write", "Delete", "Admin"
PERMISSIONS = (READ, WRITE, DELETE, ADMIN)
PREFIX = "kvs_"
DAY_NS = 86_400 * 10**9


class AuthError(Exception):
    status = 500


class MissingToken(AuthError):
    status = 401


class InvalidToken(AuthError):
    status = 401


class TokenExpired(AuthError):
    status = 401


class InsufficientPermissions(AuthError):
    status = 403


class TokenNotFound(AuthError):
    status = 404


def generate_token() -> str:
    return PREFIX + base64.b64encode(secrets.token_bytes(32)).decode()


def hash_token(token: str) -> str:
    return hashlib.sha256(token.encode()).hexdigest()


@dataclass(frozen=True)
class Token:
    id: str
    name: str
    token_hash: str
    created_at: int
    expires_at: int | None
    permissions: tuple[str, ...]

    def is_expired(self, now_ns: int | None = None) -> bool:
        return self.expires_at is not None and (time.time_ns() if now_ns is None else now_ns) > self.expires_at

    def has_permission(self, wanted: str) -> bool:
        """Admin implies all; Write does not imply Read."""
        return ADMIN in self.permissions or wanted in self.permissions

    def matches(self, raw: str) -> bool:
        return hmac.compare_digest(hash_token(raw), self.token_hash)

    def public(self) -> dict:
        return {"id": self.id, "name": self.name, "created_at": self.created_at, "expires_at": self.expires_at, "permissions": list(self.permissions)}


class TokenManager:
    def __init__(self):
        self._tokens: dict[str, Token] = {}
        self._lock = threading.Lock()

    def create(self, name: str, permissions: list[str], expires_in_days: int | None = None) -> tuple[str, Token]:
        """(raw token, record); the raw token is not kept."""
        if unknown := [p for p in permissions if p not in PERMISSIONS]:
            raise ValueError(f"unknown permissions: {unknown}")
        raw, now = generate_token(), time.time_ns()
        token = Token(str(uuid.uuid4()), name, hash_token(raw), now, None if expires_in_days is None else now + expires_in_days * DAY_NS, tuple(permissions))
        with self._lock:
            self._tokens[token.id] = token
        return raw, token

    def validate(self, raw: str) -> Token:
        with self._lock:
            tokens = list(self._tokens.values())
        found = next((t for t in tokens if t.matches(raw)), None)
        if found is None:
            raise InvalidToken("invalid token")
        if found.is_expired():
            raise TokenExpired("token expired")
        return found

    def authorize(self, header: str | None, permission: str) -> Token:
        """The token of an ``Authorization`` header, if it grants ``permission``."""
        if not header or not header.startswith("Bearer "):
            raise MissingToken("missing bearer token")
        token = self.validate(header[7:].strip())
        if not token.has_permission(permission):
            raise InsufficientPermissions(f"{permission} permission needed")
        return token

    def list(self) -> list[Token]:
        with self._lock:
            return sorted(self._tokens.values(), key=lambda t: t.created_at)

    def get(self, token_id: str) -> Token:
        with self._lock:
            if token_id not in self._tokens:
                raise TokenNotFound("token not found")
            return self._tokens[token_id]

    def delete(self, token_id: str) -> None:
        with self._lock:
            if self._tokens.pop(token_id, None) is None:
                raise TokenNotFound("token not found")

    def count(self) -> int:
        return len(self._tokens)
