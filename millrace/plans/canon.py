"""Canonical JSON (RFC 8785) and the identities made from it."""

from __future__ import annotations

import hashlib
import json
import struct
from typing import Any

from . import errors


def jcs(value: Any) -> str:
    """Canonical JSON text; keys in UTF-16 code unit order.  Query trees hold no fractions."""
    if isinstance(value, dict):
        keys = sorted(value, key=lambda k: k.encode("utf-16-be", "surrogatepass"))
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{jcs(value[k])}" for k in keys) + "}"
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(jcs, value)) + "]"
    if isinstance(value, float):
        if value != value or value in (float("inf"), float("-inf")):
            raise ValueError("not a JSON number")
        return str(int(value)) if value == int(value) and abs(value) < 1e21 else repr(value)
    return json.dumps(value, ensure_ascii=False)


def digest(value: Any) -> str:
    return "sha256:" + hashlib.sha256(jcs(value).encode()).hexdigest()


def scope_fingerprint(scope: dict) -> str:
    """Capabilities and partition values are sets: sorted, without repetition."""
    out = dict(scope)
    out["capabilities"] = sorted(set(scope.get("capabilities", [])))
    out["partitions"] = {k: sorted({jcs(x): x for x in v}.values(), key=lambda x: (str(type(x)), x)) for k, v in scope.get("partitions", {}).items()}
    return digest(out)


def effective_plan_hash(catalog: str, policy: str, scope: str, query: str) -> str:
    return digest({"catalogVersion": catalog, "languageVersion": "0", "policyVersion": policy, "scopeFingerprint": scope, "sourceQueryHash": query})


def execution_fingerprint(**members: Any) -> str:
    names = ("adapterVersion", "afterWrite", "anchor", "bindingVersion", "channel", "channelPolicyHash", "effectivePlanHash", "embeddingSpec", "engineVersion", "page", "qualityCertification", "qualityProfile", "snapshotOrWatermark")
    return digest({n: members.get(n) for n in names})


def vector_digest(vector: list[float]) -> str:
    """Over a domain tag, the dimension (big-endian) and the components (binary32, little-endian)."""
    body = b"".join(struct.pack("<f", x + 0.0) for x in vector)
    return "sha256:" + hashlib.sha256(f"{errors.DIALECT.lower()}-vector-f32le-v0".encode() + b"\0" + struct.pack(">I", len(vector)) + body).hexdigest()
