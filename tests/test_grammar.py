import pytest

from millrace.plans import grammar
from millrace.plans.errors import Refusal
from millrace.sources import decode

GOOD = {"version": "0", "mode": "records", "from": "things", "select": ["things.id"], "order": [{"by": "things.id", "dir": "asc"}], "take": 5}


def errors(query):
    with pytest.raises(Refusal) as e:
        grammar.validate(query)
    return [(x["code"], x["path"]) for x in e.value.errors]


def test_good_query():
    grammar.validate(GOOD)


def test_structural_errors_come_together_in_schema_order():
    bad = {"zzz": 1, "take": 0, "order": "things.id", "select": 3, "from": 5, "mode": "records", "version": 0, "aaa": 2}
    assert errors(bad) == [
        ("SCHEMA_TYPE_MISMATCH", "/version"),
        ("SCHEMA_TYPE_MISMATCH", "/from"),
        ("SCHEMA_TYPE_MISMATCH", "/select"),
        ("SCHEMA_TYPE_MISMATCH", "/order"),
        ("LIMIT_OUT_OF_RANGE", "/take"),
        ("SCHEMA_UNKNOWN_MEMBER", "/aaa"),
        ("SCHEMA_UNKNOWN_MEMBER", "/zzz"),
    ]


@pytest.mark.parametrize(
    ("change", "want"),
    [
        ({"joins": []}, ("UNSUPPORTED_IN_V0", "/joins")),
        ({"from": ["a", "b"]}, ("UNSUPPORTED_IN_V0", "/from")),
        ({"mode": "merge"}, ("UNSUPPORTED_IN_V0", "/mode")),
        ({"mode": "update"}, ("QUERY_WRITE_FORBIDDEN", "/mode")),
        ({"rawSql": "x"}, ("NATIVE_PASSTHROUGH_FORBIDDEN", "/rawSql")),
        ({"where": {"kind": "and", "items": [{"kind": "predicate", "op": "regex"}]}}, ("REGEX_FORBIDDEN", "/where/items/0/op")),
        ({"where": {"kind": "not", "item": {"kind": "udf"}}}, ("UDF_FORBIDDEN", "/where/item/kind")),
        ({"where": {"kind": "expression"}}, ("EVALUABLE_CONSTRUCT_FORBIDDEN", "/where/kind")),
        ({"where": {"kind": "predicate", "query": {}}}, ("UNSUPPORTED_IN_V0", "/where/query")),
        ({"metrics": [{"op": "percentile"}]}, ("UNSUPPORTED_IN_V0", "/metrics/0/op")),
        ({"search": {"using": ["a"]}}, ("UNSUPPORTED_IN_V0", "/search/using")),
        ({"privacy": 1, "credential": 1}, ("UNSUPPORTED_IN_V0", "/credential")),
    ],
)
def test_reserved_and_unsafe_constructs(change, want):
    assert errors({**GOOD, **change}) == [want]


def test_limits():
    leaf = {"kind": "predicate", "field": "things.id", "op": "isNull"}
    deep = leaf
    for _ in range(4):
        deep = {"kind": "not", "item": deep}
    assert errors({**GOOD, "where": deep}) == [("STRUCTURAL_LIMIT_EXCEEDED", "/where")]
    assert errors({**GOOD, "where": {"kind": "or", "items": [leaf] * 17}}) == [("STRUCTURAL_LIMIT_EXCEEDED", "/where/items")]
    assert errors({**GOOD, "where": {"kind": "predicate", "field": "things.id", "op": "in", "values": ["x"] * 101}}) == [("STRUCTURAL_LIMIT_EXCEEDED", "/where/values")]
    assert errors({**GOOD, "take": 1001}) == [("LIMIT_OUT_OF_RANGE", "/take")]


def test_missing_members():
    assert errors({"version": "0", "mode": "aggregate"}) == [("SCHEMA_REQUIRED_MEMBER", f"/{m}") for m in ("from", "dimensions", "metrics", "order", "take")]


def refused(text):
    with pytest.raises(Refusal) as e:
        decode.decode(text)
    return e.value.errors[0]["code"]


def test_json_and_yaml_are_the_same_tree():
    text = "version: '0'\nmode: records\nfrom: things\nselect: [things.id]\norder:\n  - {by: things.id, dir: asc}\ntake: 5\n"
    assert decode.decode(text) == GOOD
    assert decode.decode("```yaml\n" + text + "```") == GOOD
    assert decode.decode("a: yes\nb: 0x1F\nc: ~\nd: 'null'\ne: 1.0\n") == {"a": "yes", "b": 31, "c": None, "d": "null", "e": 1}


@pytest.mark.parametrize(
    ("text", "code"),
    [
        ('{"a": 1, "a": 2}', "ENCODING_DUPLICATE_KEY"),
        ("a: 1\na: 2\n", "ENCODING_DUPLICATE_KEY"),
        ("a: &x 1\nb: *x\n", "ENCODING_ANCHOR_FORBIDDEN"),
        ("<<: {a: 1}\n", "ENCODING_MERGE_KEY_FORBIDDEN"),
        ("a: !!str 1\n", "ENCODING_TAG_FORBIDDEN"),
        ("a: 1\n---\nb: 2\n", "ENCODING_MULTIDOC_FORBIDDEN"),
        ("{", "ENCODING_INVALID"),
        ('{"a": NaN}', "ENCODING_INVALID"),
    ],
)
def test_rejected_encodings(text, code):
    assert refused(text) == code
