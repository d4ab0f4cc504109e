from millrace.plans.catalog import Catalog
from millrace.sources.bindings import Binding

FIELDS = [
    ("id", "id", {}),
    ("code", "enum", {"values": [{"code": "a", "label": "A"}, {"code": "b", "label": "B"}]}),
    ("note", "text", {"nullable": True}),
    ("n", "integer", {}),
    ("total", "decimal", {"precision": 5, "scale": 2, "nullable": True}),
    ("free", "decimal", {"nullable": True}),
    ("paid", "money", {"currencies": ["EUR"], "nullable": True}),
    ("at", "instant", {"precision": "second", "nullable": True}),
    ("day", "date", {"nullable": True}),
]
DATASET = Catalog.load({"version": "1", "datasets": [{"id": "d", "idField": "d.id", "fields": [{"id": f"d.{n}", "kind": k, **more} for n, k, more in FIELDS]}]}).datasets["d"]
SCHEMA = "id string, code string, note string, n string, total string, free string, paid struct<currency string, amount string>, at string, day string, gone boolean"
GOOD = ("1", "a", "caf\u00e9 \u6771", "12", "999.99", "-1.5", ("EUR", "1.00"), "2024-01-01T00:00:00Z", "2024-02-29", False)


def faults(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    return {(r.field, r.fault): r.rows for r in Binding(lambda _: df, deleted="gone").faults(spark, DATASET).collect()}


def test_sound_and_empty_sources_have_no_faults(spark):
    nulls = ("2", "b", None, "0", None, None, None, None, None, False)
    assert faults(spark, [GOOD, nulls]) == {}
    assert faults(spark, []) == {}


def test_each_fault_is_counted(spark):
    def bad(name, **values):
        names = [n for n, _, _ in FIELDS]
        return tuple({**dict(zip([*names, "gone"], GOOD)), "id": name, **values}.values())

    rows = [
        GOOD,
        bad("1"),
        bad(None, n=None),
        bad("3", code="c", note="cafe\u0301"),
        bad("4\u0344", n="x", total="1000.00", free="one"),
        bad("5", total="1.234", paid=("USD", "1.00"), at="soon", day="2023-02-29"),
        bad("6", total="1.230"),
        bad("7", code="z", n=None, gone=True),
    ]
    assert faults(spark, rows) == {
        ("d.id", "repeated"): 2,
        ("d.id", "null"): 1,
        ("d.n", "null"): 1,
        ("d.code", "code"): 1,
        ("d.note", "normal form"): 1,
        ("d.id", "normal form"): 1,
        ("d.n", "type"): 1,
        ("d.total", "type"): 2,
        ("d.free", "type"): 1,
        ("d.paid", "currency"): 1,
        ("d.at", "type"): 1,
        ("d.day", "type"): 1,
    }
