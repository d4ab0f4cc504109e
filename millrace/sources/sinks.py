"""From rows to the wire: canonical scalars, result schemas, NDJSON."""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Iterator
from decimal import Decimal
from typing import Any

from ..functions import civil
from ..plans.catalog import Field
from ..plans.compile import Dimension, Plan, output_field
from ..plans.values import print_decimal, print_instant
from .bindings import join_limbs


def _number(x: Any) -> Decimal:
    return x if isinstance(x, Decimal) else join_limbs(x)


def scalar(value: Any, f: Field, minimal: bool = False) -> Any:
    if value is None:
        return None
    if f.kind == "decimal":
        return print_decimal(_number(value), f.scale)
    if f.kind == "money":
        return {"amount": print_decimal(_number(value["amount"]), f.scale), "currency": value["currency"]}
    if f.kind == "instant":
        return print_instant(value if value.tzinfo else value.replace(tzinfo=dt.UTC), f.instant_precision)
    return value.isoformat() if f.kind == "date" else value


def bucket(key: dt.date | None, d: Dimension, calendar: civil.Calendar) -> dict | None:
    if key is None:
        return None
    start, end = civil.boundary(key, d.grain, calendar), civil.boundary(civil.following(key, d.grain), d.grain, calendar)
    return civil.wire_period(start, end, civil.label(key, d.grain), d.grain, calendar.timezone)


def rows(collected: list, plan: Plan) -> list[dict]:
    if plan.mode != "aggregate":
        out = [{f.id: scalar(r[f.id], f) for f in plan.select} for r in collected]
        return [{**o, "rank": r["rank"]} for o, r in zip(out, collected, strict=True)] if plan.mode == "retrieve" else out
    made = []
    for r in collected:
        row = {d.id: bucket(r[f"d_{d.id}"], d, plan.calendar) if d.grain else scalar(r[f"d_{d.id}"], d.field) for d in plan.dimensions}
        made.append(row | {m.id: scalar(r[f"m_{m.id}"], output_field(m)) for m in plan.metrics})
    return made


def _column(name: str, f: Field, grain: str | None = None, timezone: str = "UTC") -> dict:
    number = f.kind in ("decimal", "money")
    return {
        "id": name,
        "kind": "calendarPeriod" if grain else f.kind,
        "nullable": f.nullable,
        "precision": (f.precision or 38) if number else None,
        "scale": f.scale if number else None,
        "enumCodes": sorted(f.codes) if f.kind == "enum" else None,
        "currencies": sorted(f.currencies) if f.currencies else None,
        "collation": "unicode-codepoint-v0" if f.kind in ("text", "enum") else None,
        "instantPrecision": f.instant_precision if f.kind == "instant" and not grain else None,
        "calendar": {"grain": grain, "timezone": timezone} if grain else None,
    }


def result_schema(plan: Plan) -> list[dict]:
    if plan.mode == "aggregate":
        dims = [_column(d.id, d.field, d.grain, plan.calendar.timezone) for d in plan.dimensions]
        return dims + [_column(m.id, output_field(m)) for m in plan.metrics]
    out = [_column(f.id, f) for f in plan.select]
    if plan.mode == "retrieve":
        out.append(_column("rank", Field("rank", "integer")) | {"kind": "rank"})
    return out


#: What of an answer crosses to the model channel; anything else, whatever comes to be added, stays.
MODEL = {
    "": ("version", "status", "mode", "channel", "page", "determinism", "release", "principalResultAvailable"),
    "provenance": ("sourceQueryHash", "effectivePlanHash", "executionFingerprint", "catalogVersion", "policyVersion", "bindingVersion", "engineVersion", "adapterVersion", "scopeFingerprint", "anchor", "replayTier"),
    "retrieval": ("embeddingSpec", "queryVectorDigest", "qualityProfile", "qualityCertification", "fusion"),
    "schema": ("id", "kind", "nullable", "precision", "scale", "enumCodes", "currencies", "collation", "instantPrecision", "calendar"),
    "money": ("amount", "currency"),
    "calendarPeriod": ("start", "endExclusive", "timezone", "grain", "label"),
}


def _only(part: str, x: dict) -> dict:
    return {k: x[k] for k in MODEL[part] if k in x}


def for_model(envelope: dict) -> dict:
    """A successful answer rebuilt from the members that may cross; rows hold the schema's fields alone."""
    columns = [_only("schema", c) for c in envelope["schema"]]

    def value(kind: str, x: Any) -> Any:
        if isinstance(x, (dict, list)) and (kind not in MODEL or not isinstance(x, dict)):
            raise TypeError(f"a {kind} is no object")
        return _only(kind, x) if isinstance(x, dict) else x

    shown = {k: [{c["id"]: value(c["kind"], r[c["id"]]) for c in columns if c["id"] in r} for r in rows] for k, rows in envelope["data"].items() if k in ("rows", "groups")}
    provenance = _only("provenance", envelope["provenance"])
    if envelope["provenance"].get("retrieval"):
        provenance["retrieval"] = _only("retrieval", envelope["provenance"]["retrieval"])
    return {**_only("", envelope), "schema": columns, "data": shown, "provenance": provenance}


def ndjson(envelope: dict) -> Iterator[str]:
    """A line of metadata, then one for each row."""
    data = envelope.get("data", {})
    yield json.dumps({k: v for k, v in envelope.items() if k != "data"}, ensure_ascii=False)
    for row in data.get("rows", data.get("groups", [])):
        yield json.dumps(row, ensure_ascii=False)
