"""HTTP edge on the standard library: the table's operations as JSON routes, with permissions enforced.

Fixed paths are matched before ``/keys/{key}``, so a key may have any name but searching still works. One lock guards
the table's writer; reads run in parallel. Listings come in pages of at most ``page_size`` rows (``?limit=`` asks for
fewer): a page that is not the last names the key to go on after as ``next``, for ``?after=``.
"""

from __future__ import annotations

import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, unquote, urlsplit

from pyspark.sql import DataFrame

from ..config import ServerConfig
from ..errors import KVError
from ..operators import query
from ..sources.sinks import envelope
from ..sources.store import KVTable
from .auth import ADMIN, DELETE, READ, WRITE, AuthError, TokenManager, TokenNotFound
from .features import FeatureClient


class BadRequest(Exception):
    pass


def _need(body: object, name: str, kind: type):
    if not isinstance(body, dict) or not isinstance(body.get(name), kind):
        raise BadRequest(f"'{name}' must be given, as {kind.__name__}")
    return body[name]


class Api:
    """Routes without the socket: ``handle`` returns (status, body)."""

    def __init__(self, table: KVTable, config: ServerConfig | None = None, tokens: TokenManager | None = None):
        self.table, self.config = table, config or ServerConfig()
        self.features = FeatureClient(table, self.config.feature_cache_ttl_secs)
        self.tokens = tokens or TokenManager()
        self.write_lock = threading.RLock()

    def handle(self, method: str, target: str, body: bytes = b"", authorization: str | None = None) -> tuple[int, dict]:
        url = urlsplit(target)
        parts = [unquote(p) for p in url.path.split("/")[1:]]
        ask = {k: v[-1] for k, v in parse_qs(url.query, keep_blank_values=True).items()}
        try:
            found = self._route(method, parts)
            if found is None:
                return 404, envelope(False, f"no route {method} {url.path}")
            permission, run, takes_body = found
            if permission and self.config.auth_enabled:
                self.tokens.authorize(authorization, permission)
            given = None
            if takes_body:
                if len(body) > self.config.max_json_payload_size:
                    return 413, envelope(False, "the body is too large")
                try:
                    given = json.loads(body)
                except ValueError as e:
                    raise BadRequest(f"the body is no JSON: {e}") from e
            return run(ask, given)
        except BadRequest as e:
            return 400, envelope(False, str(e))
        except AuthError as e:
            return e.status, {"error": str(e), "status": e.status}
        except KVError as e:
            return 500, envelope(False, f"Error: {e}")

    def _route(self, method: str, p: list[str]):
        """(permission, function, takes a body) of a path."""
        fixed = {
            ("GET", "health"): (None, self._health, False),
            ("GET", "stats"): (READ, lambda a, b: (200, envelope(True, "Stats retrieved", {"stats": self.table.stats()})), False),
            ("GET", "stats", "all"): (READ, lambda a, b: (200, envelope(True, "Stats retrieved", self.table.stats_all().first().asDict())), False),
            ("GET", "keys"): (READ, self._keys, False),
            ("POST", "keys"): (WRITE, self._put, True),
            ("POST", "keys", "batch"): (WRITE, self._put_batch, True),
            ("DELETE", "keys", "batch"): (DELETE, self._delete_batch, True),
            ("GET", "keys", "search"): (READ, self._search, False),
            ("GET", "scan"): (READ, self._scan, False),
            ("GET", "features"): (READ, self._features, False),
            ("POST", "admin", "tokens"): (ADMIN, self._create_token, True),
            ("GET", "admin", "tokens"): (ADMIN, self._list_tokens, False),
        }
        if (found := fixed.get((method, *p))) is not None:
            return found
        if len(p) == 2 and p[0] == "keys":
            if method == "GET":
                return READ, lambda a, b: self._get(p[1]), False
            if method == "DELETE":
                return DELETE, lambda a, b: self._delete(p[1]), False
        if len(p) == 2 and p[0] == "features" and method == "POST":
            return WRITE, lambda a, b: self._set_feature(p[1], b), True
        if len(p) == 3 and p[:2] == ["admin", "tokens"] and method == "DELETE":
            return ADMIN, lambda a, b: self._delete_token(p[2]), False
        return None

    def _health(self, ask, body):
        return 200, envelope(True, "kvspark is running")

    def _get(self, key: str):
        value = self.table.get(key)
        if value is None:
            return 404, envelope(False, f"Key '{key}' not found")
        return 200, envelope(True, "Key found", {"key": key, "value": value.decode("utf-8", "replace")})

    def _put(self, ask, body):
        key, value = _need(body, "key", str), _need(body, "value", str)
        with self.write_lock:
            self.table.put(key, value)
        return 200, envelope(True, f"Key '{key}' set", {"key": key})

    def _put_batch(self, ask, body):
        records = [(_need(r, "key", str), _need(r, "value", str)) for r in _need(body, "records", list)]
        with self.write_lock:
            n = self.table.set_batch(records)
        return 200, envelope(True, f"{n} keys inserted", {"count": n})

    def _delete(self, key: str):
        with self.write_lock:
            self.table.delete(key)
        return 200, envelope(True, f"Key '{key}' deleted")

    def _delete_batch(self, ask, body):
        keys = _need(body, "keys", list)
        if not all(isinstance(k, str) for k in keys):
            raise BadRequest("'keys' must hold strings")
        with self.write_lock:
            n = self.table.delete_batch(keys)
        return 200, envelope(True, f"{n} keys deleted", {"count": n})

    def _page(self, rows: DataFrame, ask: dict) -> tuple[list, dict]:
        """The rows of one page, and where the next one starts."""
        most = self.config.page_size
        if "limit" in ask:
            if not ask["limit"].isdigit() or int(ask["limit"]) < 1:
                raise BadRequest("parameter limit must be a whole number from 1 on")
            most = min(most, int(ask["limit"]))
        got = query.page_after(rows, ask.get("after"), most + 1).collect()
        return got[:most], {"next": got[most - 1].key} if len(got) > most else {}

    def _keys(self, ask, body):
        rows, more = self._page(query.without_system(self.table.live_keys()), ask)
        return 200, envelope(True, f"{len(rows)} keys found", {"keys": [r.key for r in rows]} | more)

    def _records(self, rows: DataFrame, ask: dict, message: str):
        got, more = self._page(query.as_text(rows), ask)
        return 200, envelope(True, message.format(n=len(got)), {"records": [{"key": r.key, "value": r.value} for r in got]} | more)

    def _search(self, ask, body):
        if "q" not in ask:
            raise BadRequest("parameter q is missing")
        by_prefix = ask.get("prefix", "false").lower() == "true"
        found = self.table.search_prefix(ask["q"]) if by_prefix else self.table.search(ask["q"])
        return self._records(found, ask, "{n} keys found")

    def _scan(self, ask, body):
        rows = self.table.search_prefix(ask["prefix"]) if ask.get("prefix") else self.table.scan()
        return self._records(query.without_system(rows), ask, "{n} records found")

    def _features(self, ask, body):
        doc = self.features.load()
        flags = [{"name": k, **v} for k, v in sorted(doc["flags"].items())]
        return 200, envelope(True, f"{len(flags)} features found", {"version": doc["version"], "features": flags})

    def _set_feature(self, name: str, body):
        on = _need(body, "enabled", bool)
        with self.write_lock:
            self.features.set_flag(name, on, body.get("description"))  # a missing description keeps the old one
        return 200, envelope(True, f"Feature '{name}' updated")

    def _create_token(self, ask, body):
        days = body.get("expires_in_days", self.config.token_expiry_days) if isinstance(body, dict) else None
        try:
            raw, token = self.tokens.create(_need(body, "name", str), _need(body, "permissions", list), days)
        except ValueError as e:
            raise BadRequest(str(e)) from e
        return 200, envelope(True, "Token created", token.public() | {"token": raw})

    def _list_tokens(self, ask, body):
        tokens = [t.public() for t in self.tokens.list()]
        return 200, envelope(True, f"{len(tokens)} tokens found", {"tokens": tokens})

    def _delete_token(self, token_id: str):
        try:
            self.tokens.delete(token_id)
        except TokenNotFound as e:
            return 404, envelope(False, f"Error: {e}")
        return 200, envelope(True, "Token deleted")


def serve(api: Api, host: str | None = None, port: int | None = None) -> ThreadingHTTPServer:
    """A server, ready for ``serve_forever``."""

    class Handler(BaseHTTPRequestHandler):
        def _answer(self) -> None:
            size = int(self.headers.get("Content-Length") or 0)
            if size > max(api.config.max_json_payload_size, api.config.max_raw_payload_size):
                status, body = 413, envelope(False, "the body is too large")
                self.close_connection = True
            else:
                status, body = api.handle(self.command, self.path, self.rfile.read(size), self.headers.get("Authorization"))
            data = json.dumps(body).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        do_GET = do_POST = do_DELETE = _answer

        def log_message(self, *args) -> None:
            pass

    return ThreadingHTTPServer((api.config.host if host is None else host, api.config.port if port is None else port), Handler)
