"""Cost gates: what a plan may hold in between and return, against the scope's budgets."""

from __future__ import annotations

from typing import Any

from . import canon
from .catalog import Field, Scope
from .compile import Plan, output_field
from .errors import refuse

#: Bytes of one value on the wire; text counts by what a typical value takes, the byte gate on results is exact.
WIDTHS = {"id": 64, "boolean": 5, "integer": 17, "decimal": 42, "money": 72, "text": 256, "enum": 32, "date": 12, "instant": 29, "null": 4}


def width(f: Field) -> int:
    return WIDTHS[f.kind] + len(f.id) + 4


def estimate(plan: Plan) -> dict[str, int]:
    """Rows, bytes and retrieval candidates a plan may produce at most."""
    fields = list(plan.select) + [d.field for d in plan.dimensions] + [output_field(m) for m in plan.metrics]
    candidates = 0
    if plan.search is not None:
        candidates = plan.take if plan.search["kind"] == "semantic" else 2 * min(4 * plan.take, 400)
    return {"rows": plan.take, "bytes": plan.take * sum(map(width, fields)), "candidates": candidates}


def admit(plan: Plan, scope: Scope) -> dict[str, int]:
    """The estimate; refuses what exceeds a budget of the scope."""
    cost = estimate(plan)
    limits = {"rows": scope.budget("rows", 100_000), "bytes": scope.budget("intermediateBytes", 64_000_000), "candidates": scope.budget("candidates", 1_000)}
    for name, limit in limits.items():
        if cost[name] > limit:
            raise refuse("COST_LIMIT_EXCEEDED", "/take", [], {"budget": name, "limit": limit, "estimate": cost[name]})
    return cost


def check_result(rows: list[dict[str, Any]], scope: Scope) -> None:
    """The exact backstop: a result larger than the byte budget isn't released."""
    limit, total = scope.budget("intermediateBytes", 64_000_000), 0
    for row in rows:
        total += len(canon.jcs(row).encode())
        if total > limit:
            raise refuse("COST_LIMIT_EXCEEDED", "/take", [], {"budget": "bytes", "limit": limit})
