"""Semantic compilation: a structurally valid query becomes a typed, scoped logical plan.

Pure: no clock, no randomness, no backend.  The first semantic error in schema
order is the only one reported.
"""

from __future__ import annotations

import copy
import datetime as dt
from dataclasses import dataclass, field, replace
from typing import Any

from ..functions import civil
from . import canon, grammar
from .catalog import Catalog, Dataset, EmbeddingSpec, Field, Policy, Scope
from .errors import Refusal, refuse
from .values import literal, ordered, parse_instant


@dataclass(frozen=True)
class Leaf:
    field: Field
    op: str
    value: Any = None


@dataclass(frozen=True)
class Node:
    kind: str  # and, or, not
    items: tuple


@dataclass(frozen=True)
class Key:
    by: str
    descending: bool


@dataclass(frozen=True)
class Dimension:
    id: str
    field: Field
    grain: str | None = None


@dataclass(frozen=True)
class Metric:
    id: str
    op: str
    field: Field | None
    where: Any
    kind: str
    scale: int | None
    path: str
    numerator: str | None = None
    denominator: str | None = None
    currencies: tuple[str, ...] = ()


@dataclass(frozen=True)
class Plan:
    mode: str
    dataset: Dataset
    channel: str
    take: int
    scope: dict[str, list[Any]] | None
    where: Any
    cohort: int | None
    calendar: civil.Calendar
    select: tuple[Field, ...] = ()
    dimensions: tuple[Dimension, ...] = ()
    metrics: tuple[Metric, ...] = ()
    having: Any = None
    order: tuple[Key, ...] = ()
    search: dict | None = None
    spec: EmbeddingSpec | None = None
    lexical: Field | None = None
    after_write: dict | None = None
    anchor: str | None = None
    identities: dict = field(default_factory=dict)
    canonical: dict = field(default_factory=dict)
    exact_limit: int = 100_000


def compile_query(query: dict, catalog: Catalog, policy: Policy, scope: Scope, channel: str = "principal", anchor: str | None = None, now: dt.datetime | None = None, exact_limit: int = 100_000) -> Plan:
    grammar.validate(query)
    scope.check(now)
    return _Compiler(query, catalog, policy, scope, channel, anchor, exact_limit).plan()


class _Compiler:
    def __init__(self, query, catalog, policy, scope, channel, anchor, exact_limit):
        self.query, self.catalog, self.policy, self.scope = copy.deepcopy(query), catalog, policy, scope
        self.channel, self.anchor, self.exact_limit = channel, anchor, exact_limit
        self.relative = False
        self.at = parse_instant(anchor, "/execution/anchor") if anchor is not None else None

    # -- references ------------------------------------------------------------------

    def visible(self, operation: str, keep=lambda f: True) -> list[str]:
        d = self.dataset
        return sorted(f.id for f in d.fields.values() if self.policy.allows(d.id, f.id, operation, self.channel) and keep(f))

    def field(self, name: str, operation: str, path: str, keep=lambda f: True) -> Field:
        legal = self.visible(operation, keep)
        if name not in legal:
            raise refuse("REFERENCE_NOT_AVAILABLE", path, legal)
        return self.dataset.fields[name]

    def available(self, dataset: Dataset) -> bool:
        return self.policy.visible(dataset.id) and set(dataset.tags) <= self.scope.capabilities

    # -- predicates ------------------------------------------------------------------

    def predicate(self, x: dict, path: str, trusted: bool = False) -> Any:
        kind = x["kind"]
        if kind in ("and", "or"):
            return Node(kind, tuple(self.predicate(item, f"{path}/items/{i}", trusted) for i, item in enumerate(x["items"])))
        if kind == "not":
            return Node("not", (self.predicate(x["item"], f"{path}/item", trusted),))
        name, op = x["field"], x["op"]
        keep = {"contains": lambda f: f.kind == "text", "startsWith": lambda f: f.kind == "text"}.get(op, lambda f: True)
        if op in ("inLast", "inCurrent", "inPrevious"):
            keep = lambda f: f.kind == "instant"
        f = self.dataset.fields[name] if trusted else self.field(name, "filter", f"{path}/field", keep)
        return self.leaf(f, x, path)

    def leaf(self, f: Field, x: dict, path: str) -> Leaf:
        op = x["op"]
        if op in ("isNull", "isNotNull"):
            return Leaf(f, op)
        if op in ("inLast", "inCurrent", "inPrevious"):
            self.relative = True
            if self.at is None:
                raise refuse("SCHEMA_REQUIRED_MEMBER", "/execution/anchor", ["anchor"])
            return Leaf(f, "window", civil.relative(op, x.get("amount"), x["unit"], self.at, self.catalog.calendar))
        if op in ("in", "notIn"):
            values = []
            for i, v in enumerate(x["values"]):
                typed, wire = literal(f, v, f"{path}/values/{i}")
                values.append(typed)
                x["values"][i] = wire
            return Leaf(f, op, tuple(values))
        if op in ("lt", "lte", "gt", "gte") and not ordered(f.kind):
            raise refuse("SCHEMA_INVALID_VALUE", f"{path}/op", ["eq", "ne", "in", "notIn", "isNull", "isNotNull"])
        if op in ("contains", "startsWith") or op not in ("eq", "ne"):
            f_ = replace(f, nullable=False)  # a null operand has no order and no text
        else:
            f_ = f
        typed, wire = literal(f_, x["value"], f"{path}/value")
        x["value"] = wire
        return Leaf(f, op, typed)

    def having(self, x: dict, path: str, metrics: dict[str, Metric]) -> Any:
        if x["kind"] in ("and", "or"):
            return Node(x["kind"], tuple(self.having(item, f"{path}/items/{i}", metrics) for i, item in enumerate(x["items"])))
        if x["kind"] == "not":
            return Node("not", (self.having(x["item"], f"{path}/item", metrics),))
        if x["metric"] not in metrics:
            raise refuse("REFERENCE_NOT_AVAILABLE", f"{path}/metric", sorted(metrics))
        return self.leaf(output_field(metrics[x["metric"]]), x, path)

    # -- modes -----------------------------------------------------------------------

    def plan(self) -> Plan:
        q = self.query
        names = sorted(d.id for d in self.catalog.datasets.values() if self.available(d))
        if q["from"] not in names:
            raise refuse("REFERENCE_NOT_AVAILABLE", "/from", names)
        self.dataset = d = self.catalog.datasets[q["from"]]
        mode = q["mode"]
        profile = profile_of(q)
        if d.profiles and profile not in d.profiles:
            other = mode == "retrieve" and any(p.startswith("retrieve.") for p in d.profiles)
            raise refuse("PROFILE_UNSUPPORTED", "/search/kind" if other else "/mode", details={"requiredProfile": profile})
        visible = self.scope.values(d)
        if visible:
            visible = {k: [literal(d.fields[k], v, f"/scope/partitions/{k}/{i}")[0] for i, v in enumerate(vs)] for k, vs in visible.items()}
        base = Plan(mode, d, self.channel, q["take"], visible, None, self.policy.minimum_cohort(d.id, self.channel), self.catalog.calendar, exact_limit=min(self.exact_limit, self.scope.budget("exactEligibleRecords", self.exact_limit)))
        select: tuple[Field, ...] = ()
        if mode != "aggregate":
            select = self.select(q.get("select"), mode)
        where = self.predicate(q["where"], "/where") if "where" in q else None
        extra = [self.predicate(copy.deepcopy(p), "/defaultFilters", True) for p in d.default_filters]
        if extra:
            where = Node("and", (*extra, *([where] if where is not None else ())))
        base = replace(base, select=select, where=where)
        out = {"records": self.records, "aggregate": self.aggregate, "retrieve": self.retrieve}[mode](base)
        if "afterWrite" in q:
            out = replace(out, after_write=self.after_write(q["afterWrite"]))
        if self.anchor is not None and not self.relative:
            out = replace(out, anchor=None)
        elif self.relative:
            out = replace(out, anchor=self.anchor)
        source = canon.digest(q)
        identities = {"sourceQueryHash": source, "scopeFingerprint": self.scope.fingerprint, "effectivePlanHash": canon.effective_plan_hash(self.catalog.version, self.policy.version, self.scope.fingerprint, source)}
        return replace(out, identities=identities, canonical=q)

    def select(self, names: list[str] | None, mode: str) -> tuple[Field, ...]:
        out, seen = [], set()
        for i, name in enumerate(names or []):
            f = self.field(name, "select", f"/select/{i}")
            if name in seen:
                raise refuse("SCHEMA_INVALID_VALUE", f"/select/{i}", ["Select each field once."])
            seen.add(name)
            out.append(f)
        if mode == "retrieve":  # the id is always there; naming it first is allowed
            key = self.dataset.fields[self.dataset.id_field]
            out = [key, *(f for f in out if f.id != key.id)]
        return tuple(out)

    def records(self, plan: Plan) -> Plan:
        key, order, seen = self.dataset.id_field, [], set()
        items = self.query["order"]
        for i, o in enumerate(items):
            name = self.field(o["by"], "order", f"/order/{i}/by", lambda f: f.kind != "null").id
            if name in seen or (name == key and i < len(items) - 1):
                raise refuse("SCHEMA_INVALID_VALUE", f"/order/{i}/by", ["Order by each field once, the id last."])
            seen.add(name)
            order.append(Key(name, o["dir"] == "desc"))
        if not order or order[-1].by != key:
            order.append(Key(key, False))
        return replace(plan, order=tuple(order))

    def aggregate(self, plan: Plan) -> Plan:
        q, names = self.query, set()
        dimensions, metrics = [], {}

        def claim(name: str, path: str) -> None:
            if not grammar.OUTPUT_ID.fullmatch(name) or name in grammar.RESERVED_IDS:
                raise refuse("OUTPUT_ID_INVALID", path)
            if name in names:
                raise refuse("OUTPUT_ID_COLLISION", path)
            names.add(name)

        for i, x in enumerate(q["dimensions"]):
            bucket = x["kind"] == "timeBucket"
            f = self.field(x["field"], "group", f"/dimensions/{i}/field", (lambda f: f.kind == "instant") if bucket else (lambda f: True))
            claim(x["id"], f"/dimensions/{i}/id")
            dimensions.append(Dimension(x["id"], f, x["grain"] if bucket else None))
        for i, x in enumerate(q["metrics"]):
            metric = self.metric(x, f"/metrics/{i}", metrics)
            claim(x["id"], f"/metrics/{i}/id")
            metrics[x["id"]] = metric
        having = self.having(q["having"], "/having", metrics) if "having" in q else None
        order, seen = [], set()
        for i, o in enumerate(q["order"]):
            if o["by"] not in names:
                raise refuse("REFERENCE_NOT_AVAILABLE", f"/order/{i}/by", sorted(names))
            if o["by"] in seen:
                raise refuse("SCHEMA_INVALID_VALUE", f"/order/{i}/by", ["Order by each output once."])
            seen.add(o["by"])
            order.append(Key(o["by"], o["dir"] == "desc"))
        order += [Key(x.id, False) for x in dimensions if x.id not in seen]
        return replace(plan, dimensions=tuple(dimensions), metrics=tuple(metrics.values()), having=having, order=tuple(order))

    def metric(self, x: dict, path: str, earlier: dict[str, Metric]) -> Metric:
        op = x["op"]
        if op == "ratio":
            legal = sorted(m.id for m in earlier.values() if m.op != "ratio" and m.kind in ("integer", "decimal"))
            for side in ("numerator", "denominator"):
                if x[side] not in legal:
                    raise refuse("REFERENCE_NOT_AVAILABLE", f"{path}/{side}", legal)
            return Metric(x["id"], op, None, None, "decimal", 9, path, x["numerator"], x["denominator"])
        where = self.predicate(x["where"], f"{path}/where") if "where" in x else None
        if op == "count":
            key = self.dataset.id_field
            if not self.policy.allows(self.dataset.id, key, "aggregate:count", self.channel):
                raise refuse("POLICY_DENIED", f"{path}/op", [])
            return Metric(x["id"], op, None, where, "integer", None, path)
        kinds = {"sum": ("integer", "decimal", "money"), "avg": ("integer", "decimal", "money")}.get(op)
        keep = (lambda f: f.kind in kinds) if kinds else (lambda f: f.kind not in (("boolean", "null") if op in ("min", "max") else ("null",)))
        f = self.field(x["field"], f"aggregate:{op}", f"{path}/field", keep)
        if op == "countDistinct":
            return Metric(x["id"], op, f, where, "integer", None, path)
        scale = f.scale
        kind = f.kind
        if op == "avg":
            kind, scale = ("decimal" if kind == "integer" else kind), max(f.scale or 0, 9)
        return Metric(x["id"], op, f, where, kind, scale, path, currencies=f.currencies)

    def retrieve(self, plan: Plan) -> Plan:
        s, d = self.query["search"], self.dataset
        semantic = s if s["kind"] == "semantic" else s["semantic"]
        at = "/search" if s["kind"] == "semantic" else "/search/semantic"
        legal = sorted(x for x in d.embeddings.values() if self.policy.searches(d, self.catalog.specs[x], self.channel))
        if semantic["using"] not in legal:
            raise refuse("REFERENCE_NOT_AVAILABLE", f"{at}/using", legal)
        spec = self.catalog.specs[semantic["using"]]
        lexical = None
        if s["kind"] == "hybrid":
            lexical = self.field(s["lexical"]["field"], "lexicalSearch", "/search/lexical/field", lambda f: f.kind == "text")
        exact = semantic["accuracy"] == "exact"
        if exact and s["quality"] != "exact-oracle-v0":
            raise refuse("SCHEMA_INVALID_VALUE", "/search/quality", ["exact-oracle-v0"])
        if not exact:
            profile = self.catalog.quality.get(s["quality"])
            kinds = sorted(p for p, v in self.catalog.quality.items() if s["kind"] in v.get("searchKinds", ("semantic", "hybrid")))
            if profile is None or s["quality"] not in kinds:
                raise refuse("REFERENCE_NOT_AVAILABLE", "/search/quality", kinds)
        return replace(plan, search=s, spec=spec, lexical=lexical)

    def after_write(self, x: dict) -> dict:
        names = {"record", "lexical", *(f"embedding:{s}" for s in self.dataset.embeddings.values())}
        for i, r in enumerate(x["require"]):
            if r not in names:
                raise unindexed(r, f"/afterWrite/require/{i}")
        return x


def profile_of(query: dict) -> str:
    """The capability profile a query needs."""
    return f"retrieve.{query['search']['kind']}.v0" if query["mode"] == "retrieve" else f"{query['mode']}.v0"


def unindexed(name: str, path: str) -> Refusal:
    """The dataset has no such representation to wait for."""
    if name.startswith("embedding:"):
        return refuse("EMBEDDING_UNINDEXED", path, details={"embeddingSpec": name.removeprefix("embedding:")})
    return refuse("FRESHNESS_UNAVAILABLE", path)


def output_field(metric: Metric) -> Field:
    """A metric's result as a field, for typing having operands."""
    precision = 38 if metric.kind in ("decimal", "money") and metric.scale is not None else None
    source = metric.field
    if metric.op in ("min", "max") and source is not None:
        return replace(source, id=metric.id, nullable=True)
    return Field(metric.id, metric.kind, True, precision=precision, scale=metric.scale if metric.kind in ("decimal", "money") else None, currencies=metric.currencies)
