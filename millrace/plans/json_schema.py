"""JSON Schema of the query grammar, made from the same constants that validate queries."""

from __future__ import annotations

from typing import Any

from ..functions.civil import GRAINS
from .catalog import AGGREGATES
from .grammar import COMPARE, HAVING_OPS, LIMITS, OUTPUT_ID, UNITS


def _object(members: dict[str, Any], optional: tuple[str, ...] = ()) -> dict:
    return {"type": "object", "properties": members, "required": [m for m in members if m not in optional], "additionalProperties": False}


def _array(items: dict, most: int, least: int = 0) -> dict:
    return {"type": "array", "items": items, "minItems": least, "maxItems": most}


_TEXT = {"type": "string"}
_MONEY = _object({"amount": _TEXT, "currency": _TEXT})
_SCALAR = {"anyOf": [{"type": ["string", "integer", "boolean", "null"]}, _MONEY]}


def _tree(name: str, leaves: list[dict]) -> dict:
    own = {"$ref": f"#/$defs/{name}"}
    return {
        "oneOf": [
            *leaves,
            _object({"kind": {"enum": ["and", "or"]}, "items": _array(own, LIMITS["items"], 1)}),
            _object({"kind": {"const": "not"}, "item": own}),
        ]
    }


def _leaf(subject: str, ops: tuple[str, ...], **more: Any) -> dict:
    return _object({"kind": {"const": "predicate"}, subject: _TEXT, "op": {"enum": list(ops)}, **more})


def schema() -> dict:
    """One closed schema for the three modes."""
    predicate = {"$ref": "#/$defs/predicate"}
    needle = {"type": "string", "maxLength": LIMITS["text"]}
    output = {"type": "string", "pattern": f"^{OUTPUT_ID.pattern}$"}
    order = _array(_object({"by": _TEXT, "dir": {"enum": ["asc", "desc"]}}), LIMITS["order"], 1)
    after = _object({"receipt": _TEXT, "require": _array(_TEXT, LIMITS["require"], 1), "timeoutMs": {"type": "integer", "minimum": 0, "maximum": LIMITS["timeoutMs"]}})
    common = {"version": {"const": "0"}, "from": _TEXT, "where": predicate, "afterWrite": after}
    take = lambda most: {"type": "integer", "minimum": 1, "maximum": most}
    metrics = {
        "oneOf": [
            _object({"id": output, "op": {"const": "count"}, "where": predicate}, ("where",)),
            _object({"id": output, "op": {"enum": [a for a in AGGREGATES if a != "count"]}, "field": _TEXT, "where": predicate}, ("where",)),
            _object({"id": output, "op": {"const": "ratio"}, "numerator": _TEXT, "denominator": _TEXT}),
        ]
    }
    dimensions = {"oneOf": [_object({"kind": {"const": "field"}, "field": _TEXT, "id": output}), _object({"kind": {"const": "timeBucket"}, "field": _TEXT, "grain": {"enum": list(GRAINS)}, "id": output})]}
    semantic = _object({"kind": {"const": "semantic"}, "using": _TEXT, "text": needle, "accuracy": {"enum": ["exact", "approximate"]}, "quality": _TEXT})
    hybrid = _object({"kind": {"const": "hybrid"}, "semantic": _object({"using": _TEXT, "text": needle, "accuracy": {"const": "approximate"}}), "lexical": _object({"field": _TEXT, "text": needle}), "fusion": {"const": "rrf-v0"}, "quality": _TEXT})
    optional = ("where", "afterWrite")
    return {
        "$schema": "https://json-schema.org/draft/2020-12/schema",
        "oneOf": [
            _object({**common, "mode": {"const": "records"}, "select": _array(_TEXT, LIMITS["select"], 1), "order": order, "take": take(LIMITS["take"])}, optional),
            _object({**common, "mode": {"const": "aggregate"}, "dimensions": _array(dimensions, LIMITS["dimensions"]), "metrics": _array(metrics, LIMITS["metrics"], 1), "having": {"$ref": "#/$defs/having"}, "order": order, "take": take(LIMITS["take"])}, (*optional, "having")),
            _object({**common, "mode": {"const": "retrieve"}, "select": _array(_TEXT, LIMITS["select"]), "search": {"oneOf": [semantic, hybrid]}, "take": take(LIMITS["retrieveTake"])}, (*optional, "select")),
        ],
        "$defs": {
            "predicate": _tree(
                "predicate",
                [
                    _leaf("field", COMPARE, value=_SCALAR),
                    _leaf("field", ("in", "notIn"), values=_array(_SCALAR, LIMITS["values"], 1)),
                    _leaf("field", ("isNull", "isNotNull")),
                    _leaf("field", ("contains", "startsWith"), value=needle),
                    _leaf("field", ("inLast",), amount={"type": "integer", "minimum": 1}, unit={"enum": list(UNITS)}),
                    _leaf("field", ("inCurrent", "inPrevious"), unit={"enum": list(UNITS)}),
                ],
            ),
            "having": _tree("having", [_leaf("metric", COMPARE, value=_SCALAR), _leaf("metric", tuple(o for o in HAVING_OPS if o not in COMPARE))]),
        },
    }
