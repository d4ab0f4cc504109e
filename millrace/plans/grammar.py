"""The closed query grammar: safety pre-scan, structural validation, limits."""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import Any

from ..functions.civil import GRAINS
from .catalog import AGGREGATES
from .errors import Refusal, error, pointer, refuse
from .values import INTEGER_LIMIT

ORDER = ("version", "mode", "from", "select", "where", "dimensions", "metrics", "having", "search", "order", "afterWrite", "take")
MEMBERS = {
    "records": (("version", "mode", "from", "select", "order", "take"), ("where", "afterWrite")),
    "aggregate": (("version", "mode", "from", "dimensions", "metrics", "order", "take"), ("where", "having", "afterWrite")),
    "retrieve": (("version", "mode", "from", "search", "take"), ("select", "where", "afterWrite")),
}
COMPARE = ("eq", "ne", "lt", "lte", "gt", "gte")
OPS = (*COMPARE, "in", "notIn", "isNull", "isNotNull", "contains", "startsWith", "inLast", "inCurrent", "inPrevious")
HAVING_OPS = (*COMPARE, "isNull", "isNotNull")
UNITS = ("day", "week", "month")
OUTPUT_ID = re.compile(r"[A-Za-z][A-Za-z0-9_]{0,63}")
RESERVED_IDS = ("__proto__", "prototype", "constructor")
LIMITS = {"bytes": 65_536, "depth": 32, "nodes": 64, "nesting": 2, "items": 16, "values": 100, "select": 64, "dimensions": 16, "metrics": 32, "order": 16, "take": 1000, "retrieveTake": 100, "text": 4096, "require": 32, "timeoutMs": 30_000}

# -- pre-scan ------------------------------------------------------------------------

_DEFERRED = ("credential", "derive", "edges", "joins", "materialize", "privacy", "publish")
_NATIVE = ("rawPipeline", "rawSql")
_WRITES = ("insertOnly", "replace", "delete", "update", "upsert")


def prescan(query: dict) -> None:
    """The first reserved or unsafe construct, in schema order, ends the request with its own refusal."""

    def mode(x: Any) -> None:
        if x in ("merge", "artifact"):
            raise refuse("UNSUPPORTED_IN_V0", "/mode")
        if x in _WRITES:
            raise refuse("QUERY_WRITE_FORBIDDEN", "/mode")

    def from_(x: Any) -> None:
        if isinstance(x, list):
            raise refuse("UNSUPPORTED_IN_V0", "/from")

    def predicate(x: Any, path: str) -> None:
        if not isinstance(x, dict):
            return
        if x.get("op") == "regex" or x.get("kind") == "regex":
            raise refuse("REGEX_FORBIDDEN", f"{path}/{'op' if x.get('op') == 'regex' else 'kind'}")
        for name, code in (("udf", "UDF_FORBIDDEN"), ("expression", "EVALUABLE_CONSTRUCT_FORBIDDEN")):
            for member in ("kind", "op"):
                if x.get(member) == name:
                    raise refuse(code, f"{path}/{member}")
        if "query" in x:
            raise refuse("UNSUPPORTED_IN_V0", f"{path}/query")
        for i, item in enumerate(x["items"] if isinstance(x.get("items"), list) else ()):
            predicate(item, f"{path}/items/{i}")
        predicate(x.get("item"), f"{path}/item")

    def metrics(x: Any) -> None:
        for i, m in enumerate(x if isinstance(x, list) else ()):
            if isinstance(m, dict):
                if m.get("op") == "percentile":
                    raise refuse("UNSUPPORTED_IN_V0", f"/metrics/{i}/op")
                predicate(m.get("where"), f"/metrics/{i}/where")

    def search(x: Any) -> None:
        if isinstance(x, dict):
            if isinstance(x.get("using"), list):
                raise refuse("UNSUPPORTED_IN_V0", "/search/using")
            if "rerank" in x:
                raise refuse("UNSUPPORTED_IN_V0", "/search/rerank")

    scans: dict[str, Callable[[Any], None]] = {"mode": mode, "from": from_, "where": lambda x: predicate(x, "/where"), "metrics": metrics, "having": lambda x: predicate(x, "/having"), "search": search}
    for name in (*ORDER, *sorted(set(query) - set(ORDER))):
        if name not in query:
            continue
        if name in scans:
            scans[name](query[name])
        elif name in _DEFERRED:
            raise refuse("UNSUPPORTED_IN_V0", pointer(name))
        elif name in _NATIVE:
            raise refuse("NATIVE_PASSTHROUGH_FORBIDDEN", pointer(name))


# -- structure -----------------------------------------------------------------------


class _Check:
    def __init__(self) -> None:
        self.errors: list[dict] = []

    def add(self, code: str, path: str, *alternatives: str) -> None:
        self.errors.append(error(code, path, list(alternatives)))

    def string(self, x: Any, path: str, legal: tuple[str, ...] | None = None) -> bool:
        if not isinstance(x, str):
            self.add("SCHEMA_TYPE_MISMATCH", path, "Use a JSON string.")
            return False
        if legal is not None and x not in legal:
            self.add("SCHEMA_INVALID_VALUE", path, *legal)
            return False
        if any(0xD800 <= ord(c) <= 0xDFFF for c in x):
            self.add("SCHEMA_INVALID_VALUE", path, "Use Unicode scalar values.")
            return False
        return True

    def integer(self, x: Any, path: str, low: int, high: int) -> bool:
        if isinstance(x, bool) or not isinstance(x, int):
            self.add("SCHEMA_TYPE_MISMATCH", path, "Use a JSON integer.")
            return False
        if not low <= x <= high:
            self.add("LIMIT_OUT_OF_RANGE", path, f"Use an integer from {low} through {high}.")
            return False
        return True

    def array(self, x: Any, path: str, most: int, least: int = 0, phrase: str = "Use a JSON array.") -> bool:
        if not isinstance(x, list):
            self.add("SCHEMA_TYPE_MISMATCH", path, phrase)
            return False
        if len(x) < least:
            self.add("STRUCTURAL_LIMIT_EXCEEDED", path, f"Use at least {least} item.")
        if len(x) > most:
            self.add("STRUCTURAL_LIMIT_EXCEEDED", path, f"Use at most {most} items.")
        return True

    def closed(self, x: Any, path: str, needed: tuple[str, ...], more: tuple[str, ...], schema: str, order: tuple[str, ...] | None = None) -> list[str]:
        """Reports missing members in schema order; returns known present ones.  Unknown ones are left to `unknown`."""
        if not isinstance(x, dict):
            self.add("SCHEMA_TYPE_MISMATCH", path, f"Use one closed {schema} object.")
            return []
        out = []
        for name in order or (*needed, *more):
            if name not in needed and name not in more:
                continue
            if name in x:
                out.append(name)
            elif name in needed:
                self.add("SCHEMA_REQUIRED_MEMBER", f"{path}/{name}", name)
        return out

    def unknown(self, x: dict, path: str, legal: tuple[str, ...]) -> None:
        for name in sorted(set(x) - set(legal)):
            self.add("SCHEMA_UNKNOWN_MEMBER", path + pointer(name), *legal)

    def predicate(self, x: Any, path: str, having: bool = False) -> None:
        nodes, deep = _shape(x)
        if nodes > LIMITS["nodes"]:
            self.add("STRUCTURAL_LIMIT_EXCEEDED", path, f"Use at most {LIMITS['nodes']} predicate nodes.")
        if deep > LIMITS["nesting"]:
            self.add("STRUCTURAL_LIMIT_EXCEEDED", path, f"Use at most {LIMITS['nesting']} boolean levels below the root.")
        if nodes <= LIMITS["nodes"]:
            self._node(x, path, having)

    def _node(self, x: Any, path: str, having: bool) -> None:
        if not isinstance(x, dict):
            self.add("SCHEMA_TYPE_MISMATCH", path, "Use one closed Predicate object.")
            return
        kind = x.get("kind")
        if kind in ("and", "or"):
            if "items" not in x:
                self.add("SCHEMA_REQUIRED_MEMBER", f"{path}/items", "items")
            elif self.array(x["items"], f"{path}/items", LIMITS["items"], 1):
                for i, item in enumerate(x["items"]):
                    self._node(item, f"{path}/items/{i}", having)
            self.unknown(x, path, ("kind", "items"))
            return
        if kind == "not":
            if "item" not in x:
                self.add("SCHEMA_REQUIRED_MEMBER", f"{path}/item", "item")
            else:
                self._node(x["item"], f"{path}/item", having)
            self.unknown(x, path, ("kind", "item"))
            return
        if kind != "predicate":
            if "kind" not in x:
                self.add("SCHEMA_REQUIRED_MEMBER", f"{path}/kind", "kind")
            else:
                self.string(kind, f"{path}/kind", ("predicate", "and", "or", "not"))
            return
        name = "metric" if having else "field"
        if name not in x:
            self.add("SCHEMA_REQUIRED_MEMBER", f"{path}/{name}", name)
        else:
            self.string(x[name], f"{path}/{name}")
        op = x.get("op")
        if "op" not in x:
            self.add("SCHEMA_REQUIRED_MEMBER", f"{path}/op", "op")
            return
        if not self.string(op, f"{path}/op", HAVING_OPS if having else OPS):
            return
        legal: tuple[str, ...] = ("kind", name, "op")
        if op in ("in", "notIn"):
            legal += ("values",)
            if "values" not in x:
                self.add("SCHEMA_REQUIRED_MEMBER", f"{path}/values", "values")
            elif self.array(x["values"], f"{path}/values", LIMITS["values"], 1):
                for i, v in enumerate(x["values"]):
                    self.scalar(v, f"{path}/values/{i}")
        elif op in ("inLast", "inCurrent", "inPrevious"):
            legal += ("amount", "unit") if op == "inLast" else ("unit",)
            if op == "inLast":
                if "amount" not in x:
                    self.add("SCHEMA_REQUIRED_MEMBER", f"{path}/amount", "amount")
                else:
                    self.integer(x["amount"], f"{path}/amount", 1, 100_000)
            if "unit" not in x:
                self.add("SCHEMA_REQUIRED_MEMBER", f"{path}/unit", "unit")
            else:
                self.string(x["unit"], f"{path}/unit", UNITS)
        elif op not in ("isNull", "isNotNull"):
            legal += ("value",)
            if "value" not in x:
                self.add("SCHEMA_REQUIRED_MEMBER", f"{path}/value", "value")
            elif op in ("contains", "startsWith"):
                if self.string(x["value"], f"{path}/value") and len(x["value"].encode()) > LIMITS["text"]:
                    self.add("STRUCTURAL_LIMIT_EXCEEDED", f"{path}/value", f"Use at most {LIMITS['text']} UTF-8 bytes.")
            else:
                self.scalar(x["value"], f"{path}/value")
        self.unknown(x, path, legal)

    def scalar(self, x: Any, path: str) -> None:
        if isinstance(x, dict):
            for name in self.closed(x, path, ("amount", "currency"), (), "Money"):
                self.string(x[name], f"{path}/{name}")
            self.unknown(x, path, ("amount", "currency"))
        elif isinstance(x, (list, float)):
            self.add("SCHEMA_TYPE_MISMATCH", path, "Use one JSON scalar.")
        elif isinstance(x, int) and not isinstance(x, bool) and abs(x) > INTEGER_LIMIT:
            self.add("LIMIT_OUT_OF_RANGE", path, f"Use an integer from {-INTEGER_LIMIT} through {INTEGER_LIMIT}.")

    def fields(self, x: Any, path: str, most: int, least: int) -> None:
        if self.array(x, path, most, least, "Use a JSON array of field ids."):
            for i, f in enumerate(x):
                self.string(f, f"{path}/{i}")

    def order(self, x: Any) -> None:
        if self.array(x, "/order", LIMITS["order"], 1, "Use a JSON array of order items."):
            for i, o in enumerate(x):
                at = f"/order/{i}"
                for name in self.closed(o, at, ("by", "dir"), (), "Order"):
                    self.string(o[name], f"{at}/{name}", ("asc", "desc") if name == "dir" else None)
                if isinstance(o, dict):
                    self.unknown(o, at, ("by", "dir"))

    def dimensions(self, x: Any) -> None:
        if self.array(x, "/dimensions", LIMITS["dimensions"]):
            for i, d in enumerate(x):
                at = f"/dimensions/{i}"
                bucket = isinstance(d, dict) and d.get("kind") == "timeBucket"
                needed = ("kind", "field", "grain", "id") if bucket else ("kind", "field", "id")
                for name in self.closed(d, at, needed, (), "Dimension"):
                    self.string(d[name], f"{at}/{name}", {"kind": ("field", "timeBucket"), "grain": GRAINS}.get(name))
                if isinstance(d, dict):
                    self.unknown(d, at, needed)

    def metrics(self, x: Any) -> None:
        if self.array(x, "/metrics", LIMITS["metrics"], 1):
            for i, m in enumerate(x):
                at = f"/metrics/{i}"
                op = m.get("op") if isinstance(m, dict) else None
                needed = ("id", "op", "numerator", "denominator") if op == "ratio" else ("id", "op") if op == "count" else ("id", "op", "field")
                more = () if op == "ratio" else ("where",)
                for name in self.closed(m, at, needed, more, "Metric"):
                    if name == "where":
                        self.predicate(m["where"], f"{at}/where")
                    else:
                        self.string(m[name], f"{at}/{name}", (*AGGREGATES, "ratio") if name == "op" else None)
                if isinstance(m, dict):
                    self.unknown(m, at, (*needed, *more))

    def search(self, x: Any) -> None:
        if not isinstance(x, dict):
            self.add("SCHEMA_TYPE_MISMATCH", "/search", "Use one closed Search object.")
            return
        if x.get("kind") == "hybrid":
            needed = ("kind", "semantic", "lexical", "fusion", "quality")
            for name in self.closed(x, "/search", needed, (), "Search"):
                if name in ("semantic", "lexical"):
                    own = ("using", "text", "accuracy") if name == "semantic" else ("field", "text")
                    for k in self.closed(x[name], f"/search/{name}", own, (), "Search"):
                        self._text(x[name][k], f"/search/{name}/{k}", ("approximate",) if k == "accuracy" else None)
                    if isinstance(x[name], dict):
                        self.unknown(x[name], f"/search/{name}", own)
                else:
                    self.string(x[name], f"/search/{name}", ("rrf-v0",) if name == "fusion" else None)
        else:
            needed = ("kind", "using", "text", "accuracy", "quality")
            for name in self.closed(x, "/search", needed, (), "Search"):
                self._text(x[name], f"/search/{name}", {"kind": ("semantic", "hybrid"), "accuracy": ("exact", "approximate")}.get(name))
        self.unknown(x, "/search", needed)

    def _text(self, x: Any, path: str, legal: tuple[str, ...] | None) -> None:
        if self.string(x, path, legal) and path.endswith("/text") and len(x.encode()) > LIMITS["text"]:
            self.add("STRUCTURAL_LIMIT_EXCEEDED", path, f"Use at most {LIMITS['text']} UTF-8 bytes.")

    def after_write(self, x: Any) -> None:
        needed = ("receipt", "require", "timeoutMs")
        for name in self.closed(x, "/afterWrite", needed, (), "AfterWrite"):
            at = f"/afterWrite/{name}"
            if name == "receipt":
                self.string(x[name], at)
            elif name == "timeoutMs":
                self.integer(x[name], at, 0, LIMITS["timeoutMs"])
            elif self.array(x[name], at, LIMITS["require"], 1):
                for i, r in enumerate(x[name]):
                    if self.string(r, f"{at}/{i}") and not (r in ("record", "lexical") or r.startswith("embedding:")):
                        self.add("SCHEMA_INVALID_VALUE", f"{at}/{i}", "record", "lexical", "embedding:<spec>")
        if isinstance(x, dict):
            self.unknown(x, "/afterWrite", needed)


def _shape(x: Any, depth: int = 0) -> tuple[int, int]:
    """(nodes, deepest boolean node below the root)."""
    if not isinstance(x, dict) or x.get("kind") not in ("and", "or", "not"):
        return 1, 0
    items = x.get("items") if x["kind"] != "not" else [x.get("item")]
    nodes, deep = 1, depth
    for item in items if isinstance(items, list) else ():
        n, d = _shape(item, depth + 1)
        nodes, deep = nodes + n, max(deep, d)
    return nodes, deep


def depth(x: Any) -> int:
    most, stack = 0, [(x, 1)]
    while stack:
        v, d = stack.pop()
        most = max(most, d)
        stack += [(w, d + 1) for w in (v.values() if isinstance(v, dict) else v if isinstance(v, list) else ())]
    return most


def validate(query: Any) -> None:
    """Raises one refusal with all structural errors, in schema order."""
    if not isinstance(query, dict):
        raise refuse("SCHEMA_TYPE_MISMATCH", "", ["Use one closed Query object."])
    if depth(query) > LIMITS["depth"]:
        raise refuse("STRUCTURAL_LIMIT_EXCEEDED", "", [f"Use at most {LIMITS['depth']} levels."])
    prescan(query)
    check = _Check()
    mode = query.get("mode")
    needed, more = MEMBERS.get(mode if isinstance(mode, str) else "", (("version", "mode", "from", "take"), tuple(ORDER)))
    known = MEMBERS.get(mode) is not None if isinstance(mode, str) else False
    for name in ORDER:
        if name not in needed and name not in more:
            continue
        if name not in query:
            if name in needed:
                check.add("SCHEMA_REQUIRED_MEMBER", pointer(name), name)
            continue
        x, at = query[name], pointer(name)
        if name == "version":
            if not isinstance(x, str):
                check.add("SCHEMA_TYPE_MISMATCH", at, 'Use the JSON string "0".')
            elif x != "0":
                check.add("VERSION_UNSUPPORTED", at, "0")
        elif name == "mode":
            check.string(x, at, tuple(MEMBERS))
        elif name == "from":
            check.string(x, at)
        elif name == "select":
            check.fields(x, at, LIMITS["select"], 1 if mode == "records" else 0)
        elif name in ("where", "having"):
            check.predicate(x, at, name == "having")
        elif name == "dimensions":
            check.dimensions(x)
        elif name == "metrics":
            check.metrics(x)
        elif name == "search":
            check.search(x)
        elif name == "order":
            check.order(x)
        elif name == "afterWrite":
            check.after_write(x)
        else:
            check.integer(x, at, 1, LIMITS["retrieveTake" if mode == "retrieve" else "take"])
    if known:
        check.unknown(query, "", tuple(n for n in ORDER if n in needed or n in more))
    else:
        check.unknown(query, "", ORDER)
    if check.errors:
        raise Refusal(*check.errors)
