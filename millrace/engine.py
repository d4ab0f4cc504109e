"""The engine: documents in, envelopes out.

A query is decoded, validated, compiled against catalog, policy and scope, and
run as one lazy DataFrame; every failure leaves as a structured refusal.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import hmac
import re
import secrets
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from . import __version__
from .functions import vectors
from .operators import aggregate, records, retrieve
from .operators.predicates import holds, shapes
from .plans import canon, cost, errors
from .plans.catalog import CHANNELS, Catalog, Policy, Scope
from .plans.compile import Plan, compile_query, profile_of
from .plans.errors import Refusal, refuse
from .plans.quality import Certification
from .plans.values import print_instant
from .sources import decode, sinks
from .sources.bindings import Binding
from .streaming.ingest import Ingest, observe, timeout, token

_RAISED = re.compile(r"([A-Z][A-Z_]+)@(/[^@\s]*)@")
PREVIEW = {"model": 20, "operator": 100}
CURSOR_LIFE = dt.timedelta(minutes=15)


@dataclass
class Engine:
    spark: SparkSession
    catalog: Catalog
    bindings: dict[str, Binding] = field(default_factory=dict)
    policy: Policy = field(default_factory=Policy)
    embedder: Callable[[str, int], tuple] = vectors.hashed
    store: str | None = None  # folder of managed tables
    exact_limit: int = 100_000
    certifications: tuple[Certification, ...] = ()
    bound: dict = field(default_factory=dict)  # what certifications are held against: digests and versions in force
    now: Callable[[], dt.datetime] = lambda: dt.datetime.now(dt.UTC)
    secret: bytes = field(default_factory=lambda: secrets.token_bytes(32))

    def __post_init__(self) -> None:
        self._pages: dict[str, dict] = {}
        self._saved: dict[str, dict] = {}

    # -- compile ---------------------------------------------------------------------

    def compile(self, query: Any, scope: Scope, channel: str = "principal", anchor: str | None = None) -> Plan:
        tree = decode.decode(query) if isinstance(query, (str, bytes)) else query
        plan = compile_query(tree, self.catalog, self.policy, scope, channel, anchor, self.now(), self.exact_limit)
        self.certification(plan)
        cost.admit(plan, scope)
        return plan

    def certification(self, plan: Plan) -> dict | None:
        """The reference an approximate retrieval carries; refuses where a profile with thresholds has no valid one."""
        s = plan.search
        if s is None or (s["kind"] == "semantic" and s["accuracy"] == "exact"):
            return None
        profile, now = self.catalog.quality[s["quality"]], self.now()
        own = [c for c in self.certifications if (c.profile, c.spec, c.revision) == (s["quality"], plan.spec.id, plan.spec.revision)]
        if profile.get("thresholds") is None:
            return own[0].reference("measurementRequired") if own else {"certificationId": "unmeasured", "version": "0", "status": "measurementRequired"}
        valid = [c for c in own if c.status(now, self.bound) == "valid"]
        if not valid:
            raise refuse("QUALITY_UNCERTIFIED", "/search/quality", details={"qualityProfile": s["quality"], "status": own[0].status(now, self.bound) if own else "measurementRequired"})
        covering = [c for c in valid if c.covers(shapes(plan.where))]
        if not covering:
            raise refuse("FILTER_SHAPE_UNCERTIFIED", "/where" if "where" in plan.canonical else "", details={"qualityProfile": s["quality"], "status": "valid"})
        return covering[0].reference("valid")

    def binding(self, plan: Plan) -> Binding:
        name = plan.dataset.id
        if name in self.bindings:
            return self.bindings[name]
        if self.store is None:
            raise refuse("PROFILE_UNSUPPORTED", "/mode", details={"requiredProfile": profile_of(plan.canonical)})
        table = self.writer(name).table
        pinned = table.manifest()
        return Binding(lambda _: table.rows(pinned), snapshot=lambda: f"manifest-{pinned['number']}", version="managed-1")

    def vector(self, plan: Plan) -> list[float]:
        s = plan.search if plan.search["kind"] == "semantic" else plan.search["semantic"]
        return vectors.f32(list(self.embedder(s["text"], plan.spec.dimension)))

    def dataframe(self, query: Any, scope: Scope | None = None, channel: str = "principal", anchor: str | None = None, extra: int = 0) -> DataFrame:
        """The query's lazy result; retrieval ranks eagerly, over at most `take` ids."""
        scope = scope or Scope.open()
        return self.frame(self.compile(query, scope, channel, anchor), extra)

    def frame(self, plan: Plan, extra: int = 0) -> DataFrame:
        binding = self.binding(plan)
        if plan.mode == "retrieve":
            if not binding.indexed(self.spark, plan.spec.id):
                raise refuse("EMBEDDING_UNINDEXED", "/search/using", details={"embeddingSpec": plan.spec.id})
            return retrieve.build(self.spark, plan, binding, self.vector(plan))
        return (records if plan.mode == "records" else aggregate).build(self.spark, plan, binding, extra)

    # -- run -------------------------------------------------------------------------

    def run(self, query: Any, scope: Scope, channel: str = "principal", anchor: str | None = None, page_size: int | None = None, cursor: str | None = None) -> dict:
        plan = None
        try:
            if channel not in CHANNELS:
                raise refuse("SCHEMA_INVALID_VALUE", "/channel", list(CHANNELS))
            plan = self.compile(query, scope, channel, anchor)
            if cursor is not None or page_size is not None:
                return self._page(plan, scope, page_size, cursor)
            return self._envelope(plan, scope, *self._rows(plan, scope), cap=PREVIEW.get(channel, plan.take))
        except Refusal as e:
            return self._refused(e, channel, plan)
        except (PySparkException, OSError) as e:  # backend text never leaves
            return self._refused(self._mapped(e), channel, plan)

    @staticmethod
    def _mapped(e: Exception) -> Refusal:
        text = str(e)
        if (m := _RAISED.search(text)) and m[1] in errors.MESSAGES:
            return refuse(m[1], m[2])
        if "ARITHMETIC_OVERFLOW" in text or "NUMERIC_VALUE_OUT_OF_RANGE" in text:
            return refuse("NUMERIC_OVERFLOW", "")
        return refuse("BACKEND_FAILED", "", [])

    def _rows(self, plan: Plan, scope: Scope) -> tuple[list[dict], list[dict] | None, str | None]:
        seen = self._visible(plan, scope) if plan.after_write else None
        if plan.scope is None:  # nothing is visible: no source is touched
            empty = [] if plan.mode != "aggregate" or plan.dimensions or plan.cohort else self._no_input(plan)
            return empty, seen, None
        binding = self.binding(plan)
        collected = self.frame(plan).collect()  # at most `take` rows
        rows = sinks.rows(collected, plan)
        cost.check_result(rows, scope)
        return rows, seen, binding.snapshot()

    @staticmethod
    def _no_input(plan: Plan) -> list[dict]:
        row = {m.id: 0 if m.op in ("count", "countDistinct") else None for m in plan.metrics}
        return [row] if plan.having is None or holds(plan.having, row) else []

    def _visible(self, plan: Plan, scope: Scope) -> list[dict]:
        if self.store is None or plan.dataset.id in self.bindings:
            raise refuse("FRESHNESS_UNAVAILABLE", "/afterWrite")
        writer, want = self.writer(plan.dataset.id), plan.after_write
        deadline = time.monotonic() + want["timeoutMs"] / 1000
        while True:
            found = observe(want["receipt"], want["require"], writer.standing(want["receipt"], writer.table.manifest()), scope, self.now())
            if found is not None:
                return found
            if time.monotonic() >= deadline:
                raise timeout(want["receipt"], want["require"])
            time.sleep(0.025)

    # -- envelopes -------------------------------------------------------------------

    def _provenance(self, plan: Plan, scope: Scope, seen: list[dict] | None, snapshot: str | None, page: dict | None = None) -> dict:
        binding = self.bindings.get(plan.dataset.id)
        spec = {"id": plan.spec.id, "modelRevision": plan.spec.revision} if plan.spec else None
        after = {"receipt": plan.after_write["receipt"], "require": plan.after_write["require"], "observed": seen} if plan.after_write else None
        profile = plan.search["quality"] if plan.search else None
        common = {"bindingVersion": binding.version if binding else "managed-1", "adapterVersion": "spark-1", "engineVersion": __version__}
        fingerprint = canon.execution_fingerprint(
            **common, afterWrite=after, anchor=plan.anchor, channel=plan.channel, channelPolicyHash=self.policy.hash(plan.dataset.id, plan.channel), effectivePlanHash=plan.identities["effectivePlanHash"], embeddingSpec=spec, page=page, qualityProfile=profile, snapshotOrWatermark=snapshot
        )
        retrieval = None
        if plan.search:
            retrieval = {"embeddingSpec": plan.spec.id, "modelRevision": plan.spec.revision, "metric": plan.spec.metric, "queryVectorDigest": canon.vector_digest(self.vector(plan)), "qualityProfile": profile, "qualityCertification": self.certification(plan), "indexWatermark": snapshot, "fusion": plan.search.get("fusion")}
        return {
            **{k: plan.identities[k] for k in ("sourceQueryHash", "effectivePlanHash")},
            "executionFingerprint": fingerprint,
            "catalogVersion": self.catalog.version,
            "policyVersion": self.policy.version,
            **common,
            "scopeFingerprint": scope.fingerprint,
            "anchor": plan.anchor,
            "snapshotOrWatermark": snapshot,
            "afterWrite": after,
            "retrieval": retrieval,
            "replayTier": "reevaluable" if snapshot else "auditable",
        }

    def _envelope(self, plan: Plan, scope: Scope, rows: list[dict], seen: list[dict] | None, snapshot: str | None, cap: int, next_cursor: str | None = None, page: dict | None = None, more: bool | None = None) -> dict:
        shown = rows[:cap]
        approximate = bool(plan.search) and (plan.search["kind"] == "hybrid" or plan.search["accuracy"] == "approximate")
        return {
            "version": "0",
            "status": "success",
            "mode": plan.mode,
            "channel": plan.channel,
            "schema": sinks.result_schema(plan),
            "data": {"groups" if plan.mode == "aggregate" else "rows": shown},
            "page": {"returned": len(shown), "truncated": len(rows) > cap if more is None else more, "nextCursor": next_cursor},
            "determinism": {"semantics": "approximate" if approximate else "exact", "writeVisibility": "afterWrite" if plan.after_write else "unconstrained", "executionSnapshot": "transaction" if snapshot else "none", "replay": "reevaluable" if snapshot else "auditable"},
            "provenance": self._provenance(plan, scope, seen, snapshot, page),
            "release": {"minimumCohort": plan.cohort},
            "principalResultAvailable": plan.channel == "model" and plan.cohort is None,
            "timings": None,
        }

    @staticmethod
    def _refused(e: Refusal, channel: str, plan: Plan | None) -> dict:
        known = plan.identities if plan else {}
        return {"version": "0", "status": e.status, "channel": channel, "errors": e.errors, "identities": {k: known.get(k) for k in ("sourceQueryHash", "effectivePlanHash")}}

    # -- pages -----------------------------------------------------------------------

    def _page(self, plan: Plan, scope: Scope, size: int | None, cursor: str | None) -> dict:
        """The bounded result is kept once, under an unguessable handle; pages are slices of it."""
        if plan.channel != "principal":
            raise refuse("POLICY_DENIED", "/execution/pageCursor", [])
        size = size or min(plan.take, 100)
        if not 1 <= size <= 100:
            raise refuse("LIMIT_OUT_OF_RANGE", "/execution/pageSize", ["Use an integer from 1 through 100."])
        bound = canon.digest([plan.identities, scope.fingerprint, plan.channel, plan.anchor])
        now = self.now()
        self._pages = {k: v for k, v in self._pages.items() if v["until"] + CURSOR_LIFE > now}
        if cursor is None:
            rows, seen, snapshot = self._rows(plan, scope)
            held = {"bound": bound, "rows": rows, "seen": seen, "snapshot": snapshot, "at": 0, "until": now + CURSOR_LIFE, "pin": secrets.token_hex(16)}
        else:
            held = self._pages.get(cursor)
            if held is None or held["bound"] != bound:
                raise refuse("CURSOR_INVALID", "/execution/pageCursor", details={"queryRequired": True})
            if held["until"] <= now:
                raise refuse("CURSOR_EXPIRED", "/execution/pageCursor", details={"queryRequired": True})
        at = held["at"]
        rows = held["rows"][at : at + size]
        more = at + size < len(held["rows"])
        following = None
        if more:
            following = token("cursor:")
            self._pages[following] = {**held, "at": at + size}
        page = {"snapshot": held["pin"], "position": at, "pageSize": size}
        return self._envelope(plan, scope, rows, held["seen"], held["snapshot"], size, following, page, more)

    # -- explain, catalog, saved queries ---------------------------------------------

    def explain(self, query: Any, scope: Scope, channel: str = "principal", anchor: str | None = None) -> dict:
        """What would run; no source is touched, and physical plans go to operators only."""
        plan = None
        try:
            plan = self.compile(query, scope, channel, anchor)
            out = {"version": "0", "status": "explained", "mode": plan.mode, "channel": channel, "schema": sinks.result_schema(plan), "identities": plan.identities, "effectiveFilter": plan.where is not None, "take": plan.take, "order": [{"by": k.by, "dir": "desc" if k.descending else "asc"} for k in plan.order]}
            if channel == "operator" and plan.mode != "retrieve" and plan.scope is not None:
                out["physicalPlan"] = self.frame(plan)._jdf.queryExecution().toString()  # noqa: SLF001
            return out
        except Refusal as e:
            return self._refused(e, channel, plan)

    def _seen(self, scope: Scope) -> list:
        return [d for d in sorted(self.catalog.datasets.values(), key=lambda d: d.id) if self.policy.visible(d.id) and set(d.tags) <= scope.capabilities]

    def describe(self, dataset: str, scope: Scope, channel: str = "principal") -> dict:
        found = {d.id: d for d in self._seen(scope)}
        if dataset not in found:
            return self._refused(refuse("REFERENCE_NOT_AVAILABLE", "/dataset", sorted(found)), channel, None)
        d = found[dataset]
        operations = ("select", "filter", "group", "order", "lexicalSearch")
        fields = []
        for f in sorted(d.fields.values(), key=lambda f: f.id):
            allowed = [o for o in operations if self.policy.allows(d.id, f.id, o, channel)]
            if allowed:
                fields.append({"id": f.id, "kind": f.kind, "nullable": f.nullable, "description": f.description, "operations": allowed})
        specs = sorted(s for s in d.embeddings.values() if self.policy.searches(d, self.catalog.specs[s], channel))
        return {"id": d.id, "description": d.description, "idField": d.id_field, "profiles": list(d.profiles), "fields": fields, "embeddings": specs}

    def search_catalog(self, words: str, scope: Scope, channel: str = "principal") -> list[dict]:
        """Visible datasets and fields whose id or description holds the words, without case."""
        needle, out = words.lower(), []
        for d in self._seen(scope):
            if needle in f"{d.id} {d.description}".lower():
                out.append({"kind": "dataset", "id": d.id})
            for f in self.describe(d.id, scope, channel)["fields"]:
                if needle in f"{f['id']} {f['description']}".lower():
                    out.append({"kind": "field", "id": f["id"]})
        return out

    def lookup_values(self, name: str, scope: Scope, channel: str = "principal") -> dict:
        """The declared codes of an enum field."""
        d = next((d for d in self._seen(scope) if name in d.fields), None)
        legal = sorted(f.id for x in self._seen(scope) for f in x.fields.values() if f.kind == "enum" and self.policy.allows(x.id, f.id, "filter", channel))
        if d is None or name not in legal:
            return self._refused(refuse("REFERENCE_NOT_AVAILABLE", "/field", legal), channel, None)
        f = d.fields[name]
        return {"field": name, "values": [{"code": c, "label": x} for c, x in sorted(zip(f.codes, f.labels, strict=True))]}

    def resources(self, scope: Scope) -> list[str]:
        """Names under which parts of the catalog can be read."""
        return ["catalog://source", *(f"catalog://source/datasets/{d.id}" for d in self._seen(scope))]

    def read_resource(self, name: str, scope: Scope, channel: str = "principal") -> Any:
        if name == "catalog://source":
            return {"version": self.catalog.version, "datasets": [d.id for d in self._seen(scope)]}
        return self.describe(name.removeprefix("catalog://source/datasets/"), scope, channel)

    def documentation(self, scope: Scope, channel: str = "principal") -> str:
        """The visible catalog as text: datasets, fields with kinds and operations, embeddings."""
        out = []
        for d in self._seen(scope):
            told = self.describe(d.id, scope, channel)
            out += [f"# {d.id}", d.description, ""]
            out += [f"- {f['id']} ({f['kind']}{', nullable' if f['nullable'] else ''}): {f['description']} [{', '.join(f['operations'])}]" for f in told["fields"]]
            out += [f"- search with {s}" for s in told["embeddings"]] + [""]
        return "\n".join(out)

    def execution_receipt(self, envelope: dict) -> str:
        """Proof that this engine has answered a query; needed to save it."""
        p = envelope["provenance"]
        body = canon.jcs([p["sourceQueryHash"], p["effectivePlanHash"], p["executionFingerprint"], envelope["channel"]])
        return "ex_" + hmac.new(self.secret, body.encode(), hashlib.sha256).hexdigest()

    def save_query(self, name: str, query: dict, envelope: dict, receipt: str, scope: Scope, channel: str = "principal", anchor: str | None = None) -> dict:
        try:
            plan = self.compile(query, scope, channel, anchor)
            same = plan.identities["effectivePlanHash"] == envelope["provenance"]["effectivePlanHash"] and channel == envelope["channel"]
            if not same or not hmac.compare_digest(receipt, self.execution_receipt(envelope)):
                raise refuse("RECEIPT_INVALID", "/receipt", details={"receipt": receipt})
            self._saved[name] = {"query": plan.canonical, "hash": plan.identities["sourceQueryHash"], "savedAt": print_instant(self.now())}
            return {"status": "saved", "name": name, "sourceQueryHash": plan.identities["sourceQueryHash"]}
        except Refusal as e:
            return self._refused(e, channel, None)

    def run_saved(self, name: str, scope: Scope, channel: str = "principal", anchor: str | None = None) -> dict:
        if name not in self._saved:
            return self._refused(refuse("REFERENCE_NOT_AVAILABLE", "/name", sorted(self._saved)), channel, None)
        return self.run(self._saved[name]["query"], scope, channel, anchor)

    # -- writes ----------------------------------------------------------------------

    def writer(self, dataset: str) -> Ingest:
        return Ingest(self.spark, self.store, self.catalog.datasets[dataset], self.catalog, self.embedder, self.now)

    def put(self, request: Any, scope: Scope) -> dict:
        try:
            tree = decode.decode(request) if isinstance(request, (str, bytes)) else request
            scope.check(self.now())
            names = sorted(d.id for d in self._seen(scope))
            if not isinstance(tree, dict) or tree.get("dataset") not in names:
                raise refuse("REFERENCE_NOT_AVAILABLE", "/dataset", names)
            d = self.catalog.datasets[tree["dataset"]]
            if self.store is None or (d.profiles and "ingest.canonical.v0" not in d.profiles):
                raise refuse("PROFILE_UNSUPPORTED", "/dataset", details={"requiredProfile": "ingest.canonical.v0"})
            return self.writer(d.id).put(tree, scope)
        except Refusal as e:
            return self._refused(e, "principal", None)
        except (PySparkException, OSError) as e:
            return self._refused(self._mapped(e), "principal", None)
