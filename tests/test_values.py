from decimal import Decimal
from fractions import Fraction

import pytest
from hypothesis import given
from hypothesis import strategies as st

from millrace.functions import vectors
from millrace.plans import canon
from millrace.plans.catalog import Field
from millrace.plans.errors import Refusal
from millrace.plans.values import divide, literal, parse_decimal, parse_instant, print_decimal
from millrace.sources.bindings import join_limbs, split_limbs


def code(call, *args):
    with pytest.raises(Refusal) as e:
        call(*args)
    return e.value.errors[0]["code"]


@pytest.mark.parametrize(("text", "printed"), [("+1.50", "1.5"), ("-0.0", "0"), ("00012", "12"), ("1e3", "1000"), ("12.300e-1", "1.23"), ("0e99999", "0")])
def test_decimal_spellings(text, printed):
    assert print_decimal(parse_decimal(text, "")) == printed


def test_decimal_bounds():
    assert print_decimal(parse_decimal("999.99", "", 5, 2), 2) == "999.99"
    assert print_decimal(parse_decimal("1.2300", "", 5, 2), 2) == "1.23"
    assert code(parse_decimal, "1.234", "", 5, 2) == "NUMERIC_SCALE_MISMATCH"
    assert code(parse_decimal, "1000.00", "", 5, 2) == "NUMERIC_OVERFLOW"
    assert code(parse_decimal, "1e999999999", "") == "NUMERIC_OVERFLOW"
    assert code(parse_decimal, "1e-39", "") == "NUMERIC_SCALE_MISMATCH"
    assert code(parse_decimal, " 1", "") == "SCHEMA_TYPE_MISMATCH"


@given(st.integers(-(10**30), 10**30), st.integers(1, 10**12), st.integers(0, 12))
def test_division_is_half_even(n, d, scale):
    exact = Fraction(n, d) * 10**scale
    got = divide(Decimal(n), Decimal(d), scale)
    assert Fraction(got) * 10**scale == round(exact)  # round() of a fraction is half to even


@given(st.decimals(-(10**18), 10**18, places=38, allow_nan=False, allow_infinity=False))
def test_limbs_round_trip(x):
    i, f1, f2 = split_limbs(x)
    assert join_limbs({"i": i, "f1": f1, "f2": f2}) == x


def test_instants():
    assert parse_instant("2024-02-29T23:59:59.123Z", "", "millisecond").microsecond == 123000
    assert code(parse_instant, "2024-01-01T00:00:00Z", "", "millisecond") == "INSTANT_PRECISION_MISMATCH"
    assert code(parse_instant, "2023-02-29T00:00:00Z", "") == "SCHEMA_INVALID_VALUE"
    assert code(parse_instant, "2024-01-01T00:00:00+01:00", "") == "SCHEMA_TYPE_MISMATCH"


def test_literals_by_kind():
    money = Field("d.m", "money", precision=8, scale=2, currencies=("EUR",))
    assert literal(money, {"amount": "1.5", "currency": "EUR"}, "")[1] == {"amount": "1.50", "currency": "EUR"}
    assert code(literal, money, {"amount": "1", "currency": "USD"}, "") == "ENUM_VALUE_INVALID"
    assert code(literal, Field("d.e", "enum", codes=("a",)), "A", "") == "ENUM_VALUE_INVALID"
    assert code(literal, Field("d.i", "integer"), True, "") == "SCHEMA_TYPE_MISMATCH"
    assert code(literal, Field("d.i", "integer"), None, "") == "SCHEMA_TYPE_MISMATCH"
    assert literal(Field("d.t", "text"), "é", "")[0] == "é"


def test_canonical_json():
    assert canon.jcs({"b": 1, "a": [None, True, 1.0, "é"], "\U0001f600": 0, "～": 0}) == '{"a":[null,true,1,"é"],"b":1,"😀":0,"～":0}'
    assert canon.scope_fingerprint({"capabilities": ["b", "a", "a"], "partitions": {"x": [2, 1, 2]}}) == canon.scope_fingerprint({"capabilities": ["a", "b"], "partitions": {"x": [1, 2]}})


def test_fusion_and_recall():
    assert vectors.rrf([["a", "b", "c"], ["b", "a"]], 3) == ["a", "b", "c"]
    assert vectors.rrf([["x"], ["y"]], 5) == ["x", "y"]
    assert vectors.recall(["a", "z"], ["a", "b"]) == Fraction(1, 2)
    assert vectors.recall([], []) is None
    assert vectors.quantile([Fraction(k, 10) for k in range(11)], Fraction(1, 20)) == 0


@given(st.lists(st.lists(st.floats(-100, 100, width=32), min_size=3, max_size=3), min_size=2, max_size=2))
def test_exact_cosine_order(pair):
    query = [1.0, 2.0, -1.0]
    if not all(any(v) for v in pair):
        return
    a, b = (vectors.exact(v, query, "cosine") for v in pair)
    score = [sum(Fraction(x) * Fraction(q) for x, q in zip(v, query)) for v in pair]
    norm = [sum(Fraction(x) ** 2 for x in v) for v in pair]
    left, right = (abs(s) * s / n for s, n in zip(score, norm))
    assert (a < b) == (left > right) and (a == b) == (left == right)
