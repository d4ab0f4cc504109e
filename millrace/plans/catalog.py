"""Catalog, policy and scope: frozen documents that queries are compiled against."""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass, field
from typing import Any

from ..functions.civil import DAYS, Calendar
from . import canon
from .errors import pointer, refuse
from .values import CURRENCIES, DIGITS, parse_instant

KINDS = ("id", "boolean", "integer", "decimal", "money", "text", "enum", "date", "instant", "null")
PROFILES = ("records.v0", "aggregate.v0", "retrieve.semantic.v0", "retrieve.hybrid.v0", "ingest.canonical.v0", "retrieval-index.v0")
METRICS = {"cosine": "cosine", "dotProduct": "dotProduct", "dot": "dotProduct", "squaredEuclidean": "squaredEuclidean", "euclidean": "squaredEuclidean"}
CHANNELS = ("model", "principal", "operator")
AGGREGATES = ("count", "countDistinct", "sum", "avg", "min", "max")
CATALOG_ID = re.compile(r"[A-Za-z][A-Za-z0-9_]{0,62}")


class CatalogError(ValueError):
    """The catalog document itself is wrong; its author has to mend it."""


@dataclass(frozen=True)
class Field:
    id: str
    kind: str
    nullable: bool = False
    description: str = ""
    precision: int | None = None
    scale: int | None = None
    currencies: tuple[str, ...] = ()
    codes: tuple[str, ...] = ()
    labels: tuple[str, ...] = ()
    instant_precision: str | None = None

    @property
    def local(self) -> str:
        return self.id.partition(".")[2]


@dataclass(frozen=True)
class EmbeddingSpec:
    id: str
    source_fields: tuple[str, ...]
    transform: str
    model: str
    revision: str
    dimension: int
    metric: str
    privacy: str = "public"


@dataclass(frozen=True)
class Dataset:
    id: str
    description: str
    id_field: str
    fields: dict[str, Field]
    profiles: tuple[str, ...]
    embeddings: dict[str, str] = field(default_factory=dict)
    default_filters: tuple[dict, ...] = ()
    partitions: tuple[str, ...] | None = None  # None: no row scope
    tags: tuple[str, ...] = ()


@dataclass(frozen=True)
class Catalog:
    version: str
    datasets: dict[str, Dataset]
    specs: dict[str, EmbeddingSpec]
    quality: dict[str, dict]
    calendar: Calendar

    @staticmethod
    def load(doc: dict) -> Catalog:
        """From the document's array form, or the older one with maps by id."""
        listed = lambda x: [v if "id" in v else {"id": k, **v} for k, v in x.items()] if isinstance(x, dict) else list(x or [])
        c = doc.get("calendar") or {}
        calendar = Calendar(c.get("timezone", "UTC"), c.get("weekStart", "monday"), c.get("fiscalDayStart", "00:00:00"), c.get("timezoneDatabase", "fixed-offset"))
        if calendar.week_start not in DAYS:
            raise CatalogError("unknown weekStart")
        calendar.zone()
        specs = {}
        for s in listed(doc.get("embeddingSpecs")):
            metric = METRICS.get(s["metric"])
            if metric is None or not 1 <= s["dimension"] <= 4096:
                raise CatalogError(f"{s['id']}: metric or dimension")
            specs[s["id"]] = EmbeddingSpec(s["id"], tuple(s["sourceFields"]), s.get("inputTransform", ""), s["model"]["id"], s["model"]["revision"], s["dimension"], metric, s.get("privacyClass", "public"))
        datasets: dict[str, Dataset] = {}
        for d in listed(doc["datasets"]):
            if d["id"] in datasets or not CATALOG_ID.fullmatch(d["id"]):
                raise CatalogError(f"{d['id']}: repeated or malformed dataset id")
            fields: dict[str, Field] = {}
            for f in listed(d["fields"]):
                if f["id"] in fields or not f["id"].startswith(d["id"] + ".") or not CATALOG_ID.fullmatch(f["id"].partition(".")[2]):
                    raise CatalogError(f"{f['id']}: repeated or malformed field id")
                fields[f["id"]] = _field(f)
            key = fields.get(d["idField"])
            if key is None or key.kind != "id" or key.nullable:
                raise CatalogError(f"{d['id']}: idField must name a field of kind id that is never null")
            scope = d.get("rowScope", {"kind": "none"})
            partitions = tuple(scope["dimensions"]) if scope["kind"] == "partition" else None
            for ref in [*(partitions or ()), *(x for s in d.get("embeddings", {}).values() for x in specs[s].source_fields if s in specs)]:
                if ref not in fields:
                    raise CatalogError(f"{ref}: no such field")
            if missing := [s for s in d.get("embeddings", {}).values() if s not in specs]:
                raise CatalogError(f"{missing[0]}: no such embedding spec")
            if unknown := [p for p in d.get("profiles", ()) if p not in PROFILES]:
                raise CatalogError(f"{unknown[0]}: no such profile")
            datasets[d["id"]] = Dataset(d["id"], d.get("description", ""), d["idField"], fields, tuple(d.get("profiles", ())), dict(d.get("embeddings", {})), tuple(d.get("defaultFilters") or ()), partitions, tuple(d.get("capabilityTags", ())))
        return Catalog(doc["version"], datasets, specs, {q["id"]: q for q in listed(doc.get("qualityProfiles"))}, calendar)


def _field(f: dict) -> Field:
    kind = f["kind"]
    if kind not in KINDS:
        raise CatalogError(f"{f['id']}: no such kind")
    precision, scale = f.get("precision"), f.get("scale")
    at = None
    if kind == "instant":
        at, precision = precision, None
        if at not in DIGITS:
            raise CatalogError(f"{f['id']}: instants need a precision of second, millisecond or microsecond")
    elif (precision is None) != (scale is None) or (precision is not None and not (1 <= precision <= 38 and 0 <= scale <= precision)):
        raise CatalogError(f"{f['id']}: precision and scale")
    values = f.get("values", ())
    codes = tuple(v["code"] for v in values)
    if kind == "enum" and (not codes or len(set(codes)) < len(codes)):
        raise CatalogError(f"{f['id']}: enum codes")
    currencies = tuple(f.get("currencies", ()))
    if set(currencies) - CURRENCIES:
        raise CatalogError(f"{f['id']}: unknown currency")
    return Field(f["id"], kind, f.get("nullable", False), f.get("description", ""), precision, scale, currencies, codes, tuple(v.get("label", "") for v in values), at)


@dataclass(frozen=True)
class Policy:
    """Per dataset, field, operation and channel; what is not written down is denied once a dataset is listed.

    A short form ``{version, fields: {field: {operation: bool}}}`` and no policy at
    all (everything allowed) serve trusted settings.
    """

    doc: dict | None = None

    @property
    def version(self) -> str:
        return (self.doc or {}).get("version", "allow-all")

    def _dataset(self, dataset: str) -> dict | None:
        return None if self.doc is None or "datasets" not in self.doc else self.doc["datasets"].get(dataset, {"visible": False})

    def visible(self, dataset: str) -> bool:
        entry = self._dataset(dataset)
        return True if entry is None else bool(entry.get("visible", False))

    def allows(self, dataset: str, name: str, operation: str, channel: str) -> bool:
        """operation: select, filter, group, order, lexicalSearch or aggregate:<op>."""
        if self.doc is None:
            return True
        entry = self._dataset(dataset)
        if entry is None or "fields" not in entry:
            rules = self.doc.get("fields", {}).get(name)
            return True if rules is None else bool(rules.get(operation, True))
        rules = entry["fields"].get(name, {}).get(channel, {})
        if operation.startswith("aggregate:"):
            return operation.partition(":")[2] in rules.get("aggregate", ())
        return bool(rules.get(operation, False))

    def searches(self, dataset: Dataset, spec: EmbeddingSpec, channel: str) -> bool:
        """An explicit entry decides; else every source field has to allow lexical search."""
        entry = self._dataset(dataset.id)
        if entry is not None and spec.id in entry.get("embeddings", {}):
            return bool(entry["embeddings"][spec.id].get(channel, False))
        return all(self.allows(dataset.id, f, "lexicalSearch", channel) for f in spec.source_fields)

    def minimum_cohort(self, dataset: str, channel: str) -> int | None:
        entry = self._dataset(dataset)
        found = [r["minimum"] for r in (entry or self.doc or {}).get("release", {}).get(channel, []) if r["kind"] == "minimumCohort"]
        return max(found, default=None)

    def hash(self, dataset: str, channel: str) -> str:
        return canon.digest({"channel": channel, "datasetPolicy": self._dataset(dataset) or (self.doc or {}).get("fields", {})})


@dataclass(frozen=True)
class Scope:
    doc: dict

    @staticmethod
    def open(partitions: dict | None = None, **budgets: int) -> Scope:
        """A scope for trusted callers in this process."""
        limits = {"queries": 1000, "rows": 100_000, "intermediateBytes": 64_000_000, "exactEligibleRecords": 100_000} | budgets
        return Scope({"version": "0", "principal": "local", "capabilities": [], "partitions": partitions or {}, "budgets": limits, "expiresAt": "9999-12-31T00:00:00Z"})

    def check(self, now: dt.datetime | None) -> None:
        expires = parse_instant(self.doc["expiresAt"], pointer("scope", "expiresAt"))
        if now is not None and expires <= now:
            raise refuse("SCOPE_EXPIRED")

    @property
    def fingerprint(self) -> str:
        return canon.scope_fingerprint(self.doc)

    @property
    def capabilities(self) -> set[str]:
        return set(self.doc.get("capabilities", ()))

    def budget(self, name: str, default: int) -> int:
        return int(self.doc.get("budgets", {}).get(name, default))

    def values(self, dataset: Dataset) -> dict[str, list[Any]] | None:
        """Allowed values of each partition dimension; {} without row scope; None if nothing is visible."""
        given = self.doc.get("partitions", {})
        if dataset.partitions is None:
            return {}
        if set(given) - set(dataset.partitions):
            raise refuse("SCOPE_INVALID")
        out = {d: given.get(d) or [] for d in dataset.partitions}
        return None if any(not v for v in out.values()) else out
