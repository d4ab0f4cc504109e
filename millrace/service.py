"""The engine's tools by name, and an HTTP front for them."""

from __future__ import annotations

import hmac
import json
import secrets
import threading
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import Any

from .engine import CURSOR_LIFE, Engine
from .plans.catalog import Scope
from .plans.errors import Refusal, refuse
from .plans.grammar import LIMITS
from .plans.json_schema import schema
from .sources import decode, sinks

TOOLS = ("search_catalog", "describe_catalog", "lookup_values", "explain_query", "run_query", "put_records", "save_query")
ROUTES = {
    "/v0/catalog/search": "search_catalog",
    "/v0/catalog/describe": "describe_catalog",
    "/v0/catalog/values": "lookup_values",
    "/v0/query/explain": "explain_query",
    "/v0/query/run": "run_query",
    "/v0/records": "put_records",
    "/v0/queries": "save_query",
}
#: Answers that can still be saved, and results that can still be opened, at once.
HELD = 1_000


@dataclass(frozen=True)
class Caller:
    """Who asks: resolved by the server from a credential, never from a request's body."""

    scope: Scope
    channel: str = "model"


@dataclass
class Service:
    engine: Engine
    callers: dict[str, Caller] = field(default_factory=dict)  # bearer token -> caller

    def __post_init__(self) -> None:
        self._answers: dict[str, dict] = {}
        self._handles: dict[str, dict] = {}
        self._lock = threading.Lock()

    def caller(self, header: str | None) -> Caller | None:
        given = (header or "").removeprefix("Bearer ").encode()
        found = None
        for key, who in self.callers.items():  # all are compared, in equal time
            if hmac.compare_digest(key.encode(), given):
                found = who
        return found

    def _keep(self, kept: dict[str, dict], name: str, x: dict) -> None:
        """Hold x for as long as a cursor lives; what is older goes, and of more than HELD the oldest."""
        now = self.engine.now()
        with self._lock:
            for k in [k for k, v in kept.items() if v["until"] <= now]:
                del kept[k]
            while len(kept) >= HELD:
                del kept[next(iter(kept))]
            kept[name] = {**x, "until": now + CURSOR_LIFE}

    def _held(self, kept: dict[str, dict], name: str) -> dict | None:
        found = kept.get(name)
        return found if found and found["until"] > self.engine.now() else None

    # -- tools -----------------------------------------------------------------------

    def call(self, tool: str, args: dict, who: Caller, anchor: str | None = None) -> Any:
        run: dict[str, Callable[[dict, Caller, str | None], Any]] = {t: getattr(self, f"_{t}") for t in TOOLS}
        try:
            if tool not in run:
                raise refuse("REFERENCE_NOT_AVAILABLE", "/tool", sorted(TOOLS))
            if not isinstance(args, dict):
                raise refuse("SCHEMA_TYPE_MISMATCH", "", ["Use a JSON object."])
            return run[tool](args, who, anchor)
        except Refusal as e:
            return Engine._refused(e, who.channel, None)  # noqa: SLF001

    @staticmethod
    def _members(args: dict, needed: tuple[str, ...], more: tuple[str, ...] = ()) -> None:
        for name in needed:
            if name not in args:
                raise refuse("SCHEMA_REQUIRED_MEMBER", f"/{name}", [name])
        if unknown := sorted(set(args) - set(needed) - set(more)):
            raise refuse("SCHEMA_UNKNOWN_MEMBER", f"/{unknown[0]}", [*needed, *more])

    def _search_catalog(self, args: dict, who: Caller, _: str | None) -> Any:
        self._members(args, ("query",), ("source", "limit"))
        limit = args.get("limit", 20)
        if isinstance(limit, bool) or not isinstance(limit, int) or not 1 <= limit <= 100:
            raise refuse("LIMIT_OUT_OF_RANGE", "/limit", ["Use an integer from 1 through 100."])
        return {"items": self.engine.search_catalog(str(args["query"]), who.scope, who.channel)[:limit]}

    def _describe_catalog(self, args: dict, who: Caller, _: str | None) -> Any:
        self._members(args, ("refs",), ("source",))
        return {"items": [self.engine.describe(str(r), who.scope, who.channel) for r in args["refs"]], "querySchema": schema()}

    def _lookup_values(self, args: dict, who: Caller, _: str | None) -> Any:
        self._members(args, ("field",), ("source", "query", "limit"))
        out = self.engine.lookup_values(str(args["field"]), who.scope, who.channel)
        if "values" in out:
            needle = str(args.get("query", "")).lower()
            out["values"] = [v for v in out["values"] if needle in f"{v['code']} {v['label']}".lower()][: args.get("limit", 20)]
        return out

    def _explain_query(self, args: dict, who: Caller, anchor: str | None) -> Any:
        self._members(args, ("query",), ("source",))
        return self.engine.explain(args["query"], who.scope, who.channel, anchor)

    def _run_query(self, args: dict, who: Caller, anchor: str | None) -> Any:
        self._members(args, ("query",), ("source", "afterWrite", "pageSize", "pageCursor"))
        query = args["query"]
        if "afterWrite" in args and isinstance(query, dict):
            query = {**query, "afterWrite": args["afterWrite"]}
        out = self.engine.run(query, who.scope, who.channel, anchor, args.get("pageSize"), args.get("pageCursor"))
        if out["status"] == "success":
            receipt = self.engine.execution_receipt(out)
            self._keep(self._answers, receipt, {"channel": out["channel"], "provenance": out["provenance"]})
            out = {**(sinks.for_model(out) if who.channel == "model" else out), "executionReceipt": receipt}
        return out

    def _put_records(self, args: dict, who: Caller, _: str | None) -> Any:
        return self.engine.put({k: v for k, v in args.items() if k != "source"}, who.scope)

    def _save_query(self, args: dict, who: Caller, anchor: str | None) -> Any:
        self._members(args, ("name", "query", "executionReceipt"), ("source",))
        answer = self._held(self._answers, str(args["executionReceipt"]))
        if answer is None:
            raise refuse("RECEIPT_INVALID", "/executionReceipt", details={"receipt": str(args["executionReceipt"])})
        return self.engine.save_query(str(args["name"]), args["query"], answer, args["executionReceipt"], who.scope, who.channel, anchor)

    # -- results that only principals open --------------------------------------------

    def open_result(self, args: dict, who: Caller, anchor: str | None = None) -> dict:
        if who.channel != "principal":
            return Engine._refused(refuse("POLICY_DENIED", "/channel", []), who.channel, None)  # noqa: SLF001
        out = self.engine.run(args.get("query"), who.scope, who.channel, anchor, args.get("pageSize", 100))
        if out["status"] != "success":
            return out
        handle = secrets.token_urlsafe(24)
        self._keep(self._handles, handle, {"first": out, "query": args["query"], "anchor": anchor, "size": args.get("pageSize", 100), "who": who})
        return {"status": "opened", "handle": handle}

    def page(self, handle: str, who: Caller, cursor: str | None = None) -> dict:
        held = self._held(self._handles, handle)
        if held is None or held["who"].scope.fingerprint != who.scope.fingerprint or who.channel != "principal":
            return Engine._refused(refuse("CURSOR_INVALID", "/handle", details={"queryRequired": True}), who.channel, None)  # noqa: SLF001
        if cursor is None:
            return held["first"]
        return self.engine.run(held["query"], who.scope, who.channel, held["anchor"], held["size"], cursor)

    def stream(self, handle: str, who: Caller) -> Iterator[str]:
        out = self.page(handle, who)
        lines = sinks.ndjson(out)
        yield next(lines)
        while True:
            yield from lines
            cursor = out.get("page", {}).get("nextCursor")
            if not cursor:
                return
            out = self.page(handle, who, cursor)
            lines = sinks.ndjson(out)
            next(lines)

    def ready(self) -> bool:
        return self.engine.spark.range(1).count() == 1

    # -- HTTP ------------------------------------------------------------------------

    def server(self, host: str = "127.0.0.1", port: int = 0) -> ThreadingHTTPServer:
        service = self

        class Handler(BaseHTTPRequestHandler):
            def log_message(self, *_: Any) -> None:
                pass

            def _send(self, code: int, body: Any, kind: str = "application/json") -> None:
                data = body.encode() if isinstance(body, str) else json.dumps(body, ensure_ascii=False).encode()
                self.send_response(code)
                self.send_header("Content-Type", kind)
                self.send_header("Content-Length", str(len(data)))
                self.end_headers()
                self.wfile.write(data)

            def _who(self) -> Caller | None:
                who = service.caller(self.headers.get("Authorization"))
                if who is None:
                    self._send(401, {"status": "refused"})
                return who

            def do_GET(self) -> None:
                if self.path == "/health/live":
                    return self._send(200, {"status": "live"})
                if self.path == "/health/ready":
                    return self._send(200 if service.ready() else 503, {"status": "ready"})
                if (who := self._who()) is None:
                    return None
                path, _, query = self.path.partition("?")
                parts = path.strip("/").split("/")
                if parts[:2] != ["v0", "principal-results"] or len(parts) not in (3, 4):
                    return self._send(404, {"status": "refused"})
                if len(parts) == 4 and parts[3] == "stream":
                    return self._send(200, "\n".join(service.stream(parts[2], who)) + "\n", "application/x-ndjson")
                return self._send(200, service.page(parts[2], who, query.removeprefix("cursor=") or None))

            def do_POST(self) -> None:
                if (who := self._who()) is None:
                    return
                length = self.headers.get("Content-Length", "")
                if not length.isascii() or not length.isdigit():
                    self._send(411, {"status": "refused"})
                    return
                if int(length) > LIMITS["bytes"]:
                    self.close_connection = True
                    self.rfile.read(min(int(length), 1 << 20))  # so that a caller that is little over gets the answer
                    too_long = refuse("STRUCTURAL_LIMIT_EXCEEDED", "", [f"Use at most {LIMITS['bytes']} UTF-8 bytes."])
                    self._send(413, Engine._refused(too_long, who.channel, None))  # noqa: SLF001
                    return
                try:
                    body = decode.decode(self.rfile.read(int(length)))
                except Refusal as e:
                    self._send(200, Engine._refused(e, who.channel, None))  # noqa: SLF001
                    return
                anchor = self.headers.get("X-Request-Anchor")
                if self.path == "/v0/principal-results":
                    self._send(200, service.open_result(body if isinstance(body, dict) else {}, who, anchor))
                elif self.path in ROUTES:
                    self._send(200, service.call(ROUTES[self.path], body, who, anchor))
                else:
                    self._send(404, {"status": "refused"})

        return ThreadingHTTPServer((host, port), Handler)
