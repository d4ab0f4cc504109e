"""Vector scores: native and approximate to double precision, then exact on a superset."""

from __future__ import annotations

import functools
import hashlib
import struct
from fractions import Fraction

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.errors import refuse


def f32(vector: list[float], path: str = "/search/text") -> list[float]:
    """Components rounded once to binary32; negative zero becomes zero."""
    out = []
    for x in vector:
        try:
            y = struct.unpack("<f", struct.pack("<f", float(x)))[0]
        except (OverflowError, struct.error):
            raise refuse("SCHEMA_INVALID_VALUE", path, ["Use finite vector components."]) from None
        if y != y or y in (float("inf"), float("-inf")):
            raise refuse("SCHEMA_INVALID_VALUE", path, ["Use finite vector components."])
        out.append(y + 0.0)
    return out


#: Up to this dimension sums are written out, so that they compile into the scan's loop; beyond, they run over the array.
UNROLLED = 256


def _total(terms: list[Column]) -> Column:
    """A balanced sum."""
    while len(terms) > 1:
        terms = [terms[i] + terms[i + 1] if i + 1 < len(terms) else terms[i] for i in range(0, len(terms), 2)]
    return terms[0]


def _sum(v: Column, query: list[float], term) -> Column:
    """Sum of term(component, the query's component)."""
    if len(query) <= UNROLLED:
        return _total([term(F.get(v, F.lit(i)).cast("double"), F.lit(float(x))) for i, x in enumerate(query)])
    q = F.array(*(F.lit(float(x)) for x in query))
    return F.aggregate(F.zip_with(v, q, lambda x, y: term(x.cast("double"), y)), F.lit(0.0), lambda s, x: s + x)


def score(v: Column, query: list[float], metric: str) -> Column:
    """Larger is nearer."""
    if metric == "squaredEuclidean":
        return -_sum(v, query, lambda x, y: (x - y) * (x - y))
    dot = _sum(v, query, lambda x, y: x * y)
    if metric == "dotProduct":
        return dot
    return dot / (F.sqrt(_sum(v, query, lambda x, _: x * x)) * F.lit(sum(x * x for x in query) ** 0.5))


def slack(scores: Column, v: Column, query: list[float], metric: str) -> Column:
    """A bound of the rounding error of `score`."""
    eps = 2.0**-52 * (len(query) + 8)
    if metric == "dotProduct":
        return _sum(v, query, lambda x, y: F.abs(x * y)) * eps
    return (F.abs(scores) + F.lit(1.0 if metric == "cosine" else 0.0)) * (4 * eps)


def exact(vector: list[float], query: list[float], metric: str) -> tuple:
    """A key that orders nearer vectors first, exactly."""
    v, q = [Fraction(float(x)) for x in vector], [Fraction(float(x)) for x in query]
    if metric == "squaredEuclidean":
        return (sum((a - b) ** 2 for a, b in zip(v, q, strict=True)),)
    dot = sum(a * b for a, b in zip(v, q, strict=True))
    if metric == "dotProduct":
        return (-dot,)
    norm = sum(a * a for a in v)
    if not norm:
        raise refuse("SCHEMA_INVALID_VALUE", "/search/using", ["Zero vectors have no cosine."])
    square = dot * dot / norm  # the query's norm is common to all
    return (-square if dot > 0 else square,)


def rrf(lists: list[list[str]], take: int) -> list[str]:
    """Reciprocal rank fusion with constant 60; exact sums, ties by id."""
    total: dict[str, Fraction] = {}
    for ids in lists:
        for rank, i in enumerate(ids, 1):
            total[i] = total.get(i, Fraction(0)) + Fraction(1, 60 + rank)
    return sorted(total, key=lambda i: (-total[i], i.encode()))[:take]


def recall(found: list[str], truth: list[str]) -> Fraction | None:
    """Share of the true set found; None where nothing is eligible."""
    return Fraction(len(set(found) & set(truth)), len(set(truth))) if truth else None


def quantile(values: list[Fraction], p: Fraction) -> Fraction:
    """Element floor(p * (n - 1)) of the sorted values."""
    return sorted(values)[(p * (len(values) - 1)).__floor__()]


@functools.cache
def hashed(text: str, dimension: int) -> tuple[float, ...]:
    """A deterministic embedding: components in [-1, 1) from a 32-bit xorshift seeded by the text's hash."""
    state = int.from_bytes(hashlib.sha256(text.encode()).digest()[:4], "big") or 1
    out = []
    for _ in range(dimension):
        state ^= (state << 13) & 0xFFFFFFFF
        state ^= state >> 17
        state ^= (state << 5) & 0xFFFFFFFF
        out.append(f32([state / 2**31 - 1])[0])
    return tuple(out) if any(out) else (0.5,) * dimension
