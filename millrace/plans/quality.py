"""Retrieval quality: recall measured exactly, certifications that expire and go stale."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field
from decimal import Decimal
from fractions import Fraction
from typing import Any

from ..functions.vectors import quantile, recall
from .values import divide, parse_decimal, parse_instant, print_decimal

POINTS = {"p01": Fraction(1, 100), "p05": Fraction(1, 20), "p10": Fraction(1, 10), "p25": Fraction(1, 4)}


def _print(x: Fraction) -> str:
    return print_decimal(divide(Decimal(x.numerator), Decimal(x.denominator), 9), 9)


def report(found: dict[str, list[str]], truth: dict[str, list[str]], eligible: dict[str, set[str]], k: int) -> dict:
    """Every query's recall and their distribution; missing answers count as none found, empty eligible sets apart."""
    per_query, samples, violations = [], [], 0
    for name in sorted(truth):
        got = found.get(name, [])
        inside = [x for x in got if x in eligible[name]]
        violations += len(got) - len(inside)
        r = recall(inside, truth[name])
        per_query.append({"queryId": name, "k": k, "exactRelevantCount": len(truth[name]), "returnedEligibleCount": len(inside), "relevantReturnedCount": len(set(inside) & set(truth[name])), "recall": "emptyEligible" if r is None else _print(r)})
        if r is not None:
            samples.append(r)
    out: dict[str, Any] = {"perQuery": per_query, "sampleCount": len(samples), "eligibilityViolations": violations}
    if samples:
        ordered = sorted(samples)
        middle = (ordered[(len(ordered) - 1) // 2] + ordered[len(ordered) // 2]) / 2
        out |= {"mean": _print(sum(samples) / len(samples)), "median": _print(middle), "minimum": _print(ordered[0])}
        out |= {n: _print(quantile(samples, p)) for n, p in POINTS.items()}
    return out


@dataclass(frozen=True)
class Certification:
    id: str
    version: str
    profile: str
    spec: str
    revision: str
    bound: dict = field(default_factory=dict)  # digests and versions the measurement holds for
    measured_at: str = ""
    max_age_days: int = 30
    report: dict = field(default_factory=dict)
    thresholds: dict | None = None
    shapes: frozenset = frozenset()  # predicate kinds covered; empty: all

    def status(self, now: dt.datetime, current: dict) -> str:
        """valid, stale or measurementRequired."""
        if self.thresholds is None:
            return "measurementRequired"
        until = parse_instant(self.measured_at, "") + dt.timedelta(days=self.max_age_days)
        same = all(current.get(k) == v for k, v in self.bound.items())
        met = all(k in self.report and parse_decimal(self.report[k], "") >= parse_decimal(v, "") for k, v in self.thresholds.items())
        return "valid" if now < until and same and met and not self.report.get("eligibilityViolations") else "stale"

    def covers(self, shapes: set[str]) -> bool:
        return not self.shapes or shapes <= self.shapes

    def reference(self, status: str) -> dict:
        return {"certificationId": self.id, "version": self.version, "status": status}
