import datetime as dt
import re
from types import SimpleNamespace

import pyarrow as pa
import pytest

from millrace.engine import Engine
from millrace.functions import vectors
from millrace.operators.retrieve import _first, nearest
from millrace.plans.catalog import Catalog, CatalogError, Policy, Scope
from millrace.sources import sinks
from millrace.sources.bindings import Binding
from millrace.streaming.ingest import move, observe, stream_into
from millrace.plans.errors import Refusal


def field(name, kind, nullable=False, **more):
    return {"id": f"bills.{name}", "kind": kind, "nullable": nullable, "description": name, **more}


DOC = {
    "version": "c1",
    "calendar": {"timezone": "America/New_York", "timezoneDatabase": "2024a", "weekStart": "monday", "fiscalDayStart": "00:00:00"},
    "embeddingSpecs": [{"id": "note@1", "sourceFields": ["bills.note"], "inputTransform": "t", "model": {"id": "m", "revision": "1"}, "dimension": 4, "metric": "cosine", "vectorEncoding": "float32", "chunking": "none", "privacyClass": "public"}],
    "qualityProfiles": [{"id": "loose", "thresholds": None}, {"id": "strict", "thresholds": {"mean": "0.9"}}],
    "datasets": [
        {
            "id": "bills",
            "description": "Bills",
            "idField": "bills.id",
            "profiles": [],
            "rowScope": {"kind": "partition", "dimensions": ["bills.tenant"]},
            "embeddings": {"note": "note@1"},
            "fields": [
                field("id", "id"),
                field("tenant", "enum", values=[{"code": "a", "label": "A"}, {"code": "b", "label": "B"}]),
                field("total", "decimal", True, precision=10, scale=2),
                field("free", "decimal"),
                field("paid", "money"),
                field("count", "integer"),
                field("at", "instant", precision="second"),
                field("day", "date"),
                field("note", "text", normalization="NFC", collation="unicode-codepoint-v0"),
            ],
        },
        {"id": "secrets", "description": "Hidden", "idField": "secrets.id", "profiles": [], "capabilityTags": ["vault"], "fields": [{"id": "secrets.id", "kind": "id", "nullable": False, "description": "id"}]},
    ],
}
ROWS = [
    ("1", "a", "10.00", "1", ("1", "EUR"), 3, "2024-03-10T04:59:59Z", "2024-03-09", "alpha beta"),
    ("2", "a", None, "0.000000000000000001", ("0.000000000000000001", "EUR"), 4, "2024-03-10T05:00:00Z", "2024-03-10", "beta beta"),
    ("3", "a", "-0.50", "-2.5", ("0.000000001", "USD"), 5, "2024-03-11T03:59:59Z", "2024-03-10", "gamma"),
    ("4", "a", "0.25", "1e3", ("0.000000002", "USD"), 6, "2024-03-11T04:00:00Z", "2024-03-11", "Beta"),
    ("5", "b", "99.99", "7", ("5", "EUR"), 7, "2024-03-12T00:00:00Z", "2024-03-12", "beta"),
]
SCOPE = Scope.open({"bills.tenant": ["a"]})
BOTH = Scope.open({"bills.tenant": ["a", "b"]})


def record(row):
    names = ("tenant", "total", "free", "paid", "count", "at", "day", "note")
    value = dict(zip(names, row[1:]))
    value["paid"] = dict(zip(("amount", "currency"), value["paid"]))
    return {"id": row[0], "value": value}


def request(records, key, mode="insertOnly"):
    return {"dataset": "bills", "mode": mode, "records": records, "embeddingPolicy": "catalog", "idempotencyKey": key}


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    e = Engine(spark, Catalog.load(DOC), store=str(tmp_path_factory.mktemp("store")))
    out = e.put(request([record(r) for r in ROWS], "seed"), BOTH)
    assert [o["status"] for o in out["outcomes"]] == ["accepted"] * 5
    return e


def records(where=None, select=("id",), order=(("id", "asc"),), take=100):
    q = {"version": "0", "mode": "records", "from": "bills", "select": [f"bills.{s}" for s in select], "order": [{"by": f"bills.{b}", "dir": d} for b, d in order], "take": take}
    return q | ({"where": where} if where else {})


def leaf(name, op, **more):
    return {"kind": "predicate", "field": f"bills.{name}", "op": op, **more}


def ids(result):
    assert result["status"] == "success", result
    return [r["bills.id"] for r in result["data"]["rows"]]


@pytest.mark.parametrize(
    ("where", "want"),
    [
        (leaf("total", "ne", value="10.00"), "2 3 4"),
        (leaf("total", "eq", value=None), "2"),
        ({"kind": "not", "item": leaf("total", "lt", value="1.00")}, "1 2"),
        (leaf("total", "in", values=[None, "0.25"]), "2 4"),
        (leaf("total", "notIn", values=["0.25"]), "1 2 3"),
        (leaf("free", "gt", value="0"), "1 2 4"),
        (leaf("free", "eq", value="1000"), "4"),
        (leaf("paid", "gte", value={"amount": "0.000000001", "currency": "USD"}), "3 4"),
        (leaf("note", "contains", value="beta"), "1 2"),
        (leaf("note", "startsWith", value=""), "1 2 3 4"),
        ({"kind": "and", "items": [leaf("at", "gte", value="2024-03-10T05:00:00Z"), leaf("at", "lt", value="2024-03-11T04:00:00Z")]}, "2 3"),
        ({"kind": "or", "items": [leaf("tenant", "eq", value="b"), leaf("count", "gt", value=4)]}, "3 4"),
        (leaf("day", "lte", value="2024-03-10"), "1 2 3"),
    ],
)
def test_predicates_within_scope(engine, where, want):
    assert ids(engine.run(records(where), SCOPE)) == want.split()


def test_relative_windows_need_an_anchor(engine):
    q = records(leaf("at", "inCurrent", unit="day"))
    assert ids(engine.run(q, SCOPE, anchor="2024-03-10T20:00:00Z")) == ["2", "3"]
    assert ids(engine.run(records(leaf("at", "inLast", amount=1, unit="day")), SCOPE, anchor="2024-03-11T04:00:00Z")) == ["2", "3", "4"]
    assert engine.run(q, SCOPE)["errors"][0]["path"] == "/execution/anchor"


def test_order_take_and_wire_forms(engine):
    out = engine.run(records(select=("id", "total", "paid", "at", "free"), order=(("total", "desc"),), take=3), SCOPE)
    assert out["data"]["rows"] == [
        {"bills.id": "1", "bills.total": "10.00", "bills.paid": {"amount": "1", "currency": "EUR"}, "bills.at": "2024-03-10T04:59:59Z", "bills.free": "1"},
        {"bills.id": "4", "bills.total": "0.25", "bills.paid": {"amount": "0.000000002", "currency": "USD"}, "bills.at": "2024-03-11T04:00:00Z", "bills.free": "1000"},
        {"bills.id": "3", "bills.total": "-0.50", "bills.paid": {"amount": "0.000000001", "currency": "USD"}, "bills.at": "2024-03-11T03:59:59Z", "bills.free": "-2.5"},
    ]
    assert [c["kind"] for c in out["schema"]] == ["id", "decimal", "money", "instant", "decimal"]
    assert len(list(sinks.ndjson(out))) == 4


def aggregate(metrics, dims=(), order=None, **more):
    return {"version": "0", "mode": "aggregate", "from": "bills", "dimensions": list(dims), "metrics": metrics, "order": [{"by": order or (dims[0]["id"] if dims else metrics[0]["id"]), "dir": "asc"}], "take": 100, **more}


def groups(result):
    assert result["status"] == "success", result
    return result["data"]["groups"]


def test_exact_sums_averages_and_ratios(engine):
    m = [
        {"id": "n", "op": "count"},
        {"id": "sum", "op": "sum", "field": "bills.total"},
        {"id": "avg", "op": "avg", "field": "bills.total"},
        {"id": "free", "op": "sum", "field": "bills.free"},
        {"id": "ints", "op": "avg", "field": "bills.count"},
        {"id": "usd", "op": "sum", "field": "bills.paid", "where": leaf("count", "gt", value=4)},
        {"id": "mean", "op": "avg", "field": "bills.paid", "where": leaf("count", "gt", value=4)},
        {"id": "rate", "op": "ratio", "numerator": "n", "denominator": "sum"},
    ]
    assert groups(engine.run(aggregate(m), SCOPE)) == [
        {"n": 4, "sum": "9.75", "avg": "3.250000000", "free": "998.500000000000000001", "ints": "4.500000000", "usd": {"amount": "0.000000003", "currency": "USD"}, "mean": {"amount": "0.000000002", "currency": "USD"}, "rate": "0.410256410"}
    ]


def test_mixed_currencies_refuse_at_the_metric(engine):
    for op in ("sum", "avg"):
        out = engine.run(aggregate([{"id": "n", "op": "count"}, {"id": "x", "op": op, "field": "bills.paid"}]), SCOPE)
        assert [(e["code"], e["path"]) for e in out["errors"]] == [("MONEY_CURRENCY_MIXED", "/metrics/1")]


def test_calendar_buckets_and_having(engine):
    dims = [{"kind": "timeBucket", "field": "bills.at", "grain": "day", "id": "day"}]
    out = groups(engine.run(aggregate([{"id": "n", "op": "count"}], dims), SCOPE))
    assert [(g["day"]["start"], g["day"]["endExclusive"], g["day"]["label"], g["n"]) for g in out] == [
        ("2024-03-09T05:00:00Z", "2024-03-10T05:00:00Z", "2024-03-09", 1),
        ("2024-03-10T05:00:00Z", "2024-03-11T04:00:00Z", "2024-03-10", 2),
        ("2024-03-11T04:00:00Z", "2024-03-12T04:00:00Z", "2024-03-11", 1),
    ]
    having = {"kind": "predicate", "metric": "n", "op": "gt", "value": 1}
    assert [g["n"] for g in groups(engine.run(aggregate([{"id": "n", "op": "count"}], dims, having=having), SCOPE))] == [2]


def test_empty_input(engine):
    m = [{"id": "n", "op": "count"}, {"id": "d", "op": "countDistinct", "field": "bills.count"}, {"id": "s", "op": "sum", "field": "bills.total"}, {"id": "a", "op": "avg", "field": "bills.free"}, {"id": "r", "op": "ratio", "numerator": "s", "denominator": "n"}]
    nothing = leaf("count", "gt", value=1000)
    assert groups(engine.run(aggregate(m, where=nothing), SCOPE)) == [{"n": 0, "d": 0, "s": None, "a": None, "r": None}]
    dims = [{"kind": "field", "field": "bills.note", "id": "note"}]
    assert groups(engine.run(aggregate(m, dims, where=nothing), SCOPE)) == []


def test_scope_comes_first_and_empty_scope_sees_nothing(engine):
    everything = records({"kind": "or", "items": [leaf("id", "isNotNull"), leaf("tenant", "eq", value="b")]})
    assert ids(engine.run(everything, SCOPE)) == ["1", "2", "3", "4"]
    assert ids(engine.run(everything, Scope.open({"bills.tenant": []}))) == []
    assert ids(engine.run(everything, Scope.open({}))) == []
    assert engine.run(everything, Scope.open({"bills.note": ["x"], "bills.tenant": ["a"]}))["errors"][0]["code"] == "SCOPE_INVALID"
    late = Scope({**SCOPE.doc, "expiresAt": "2000-01-01T00:00:00Z"})
    assert engine.run(everything, late)["errors"][0]["code"] == "SCOPE_EXPIRED"
    plan = engine.dataframe(everything, SCOPE)._jdf.queryExecution().optimizedPlan().toString()
    assert "tenant" in plan


def test_empty_scope_has_the_shape_of_empty_input(engine):
    m = [{"id": "n", "op": "count"}, {"id": "s", "op": "sum", "field": "bills.total"}]
    nobody = Scope.open({})
    assert groups(engine.run(aggregate(m), nobody)) == [{"n": 0, "s": None}]
    for op, value, want in (("eq", 0, 1), ("gt", 0, 0)):
        having = {"kind": "predicate", "metric": "n", "op": op, "value": value}
        assert len(groups(engine.run(aggregate(m, having=having), nobody))) == want
        assert len(groups(engine.run(aggregate(m, having=having, where=leaf("count", "gt", value=999)), SCOPE))) == want


def test_hidden_is_nonexistent(engine, spark):
    closed = Engine(spark, engine.catalog, policy=Policy({"version": "p", "fields": {"bills.total": {"select": False}}}), store=engine.store)
    hidden, missing = (closed.run(records(select=("id", name)), SCOPE)["errors"] for name in ("total", "nothing"))
    assert hidden == missing and hidden[0]["code"] == "REFERENCE_NOT_AVAILABLE" and "bills.total" not in hidden[0]["alternatives"]
    a, b = (engine.run(records() | {"from": n}, SCOPE)["errors"] for n in ("secrets", "nowhere"))
    assert a == b and a[0]["alternatives"] == ["bills"]


def test_minimum_cohort_looks_empty(engine, spark):
    policy = Policy({"version": "p", "release": {"principal": [{"kind": "minimumCohort", "minimum": 3}]}})
    e = Engine(spark, engine.catalog, policy=policy, store=engine.store)
    assert ids(e.run(records(leaf("count", "lt", value=5)), SCOPE)) == []
    assert ids(e.run(records(), SCOPE)) == ["1", "2", "3", "4"]
    dims = [{"kind": "field", "field": "bills.day", "id": "day"}]
    out = e.run(aggregate([{"id": "n", "op": "count"}], dims), SCOPE)
    assert groups(out) == [] and out["page"] == {"returned": 0, "truncated": False, "nextCursor": None}


def retrieve(accuracy="exact", quality="exact-oracle-v0", text="beta", take=2, **more):
    return {"version": "0", "mode": "retrieve", "from": "bills", "search": {"kind": "semantic", "using": "note@1", "text": text, "accuracy": accuracy, "quality": quality}, "take": take, **more}


def test_retrieval(engine, spark):
    out = engine.run(retrieve(text="beta beta", take=4), SCOPE)
    assert [r["rank"] for r in out["data"]["rows"]] == [1, 2, 3, 4] and ids(out)[0] == "2"
    assert ids(engine.run(retrieve(text="beta", take=9, where=leaf("count", "gt", value=4)), BOTH))[0] == "5"
    tight = Engine(spark, engine.catalog, store=engine.store, exact_limit=2)
    refusal = tight.run(retrieve(), SCOPE)["errors"][0]
    assert (refusal["code"], refusal["path"], refusal["remedy"]["details"]["limit"]) == ("EXACT_SCAN_LIMIT_EXCEEDED", "/search/accuracy", 2)
    assert engine.run(retrieve("approximate", "strict"), SCOPE)["errors"][0]["code"] == "QUALITY_UNCERTIFIED"
    assert engine.run(retrieve("approximate", "loose"), SCOPE)["determinism"]["semantics"] == "approximate"


def test_approximate_retrieval_has_no_admission_limit(engine, spark):
    tight = Engine(spark, engine.catalog, store=engine.store, exact_limit=2)
    want = engine.run(retrieve(text="beta beta", take=4), SCOPE)
    assert ids(tight.run(retrieve("approximate", "loose", text="beta beta", take=4), SCOPE)) == ids(want)


def test_ties_come_back_bounded(spark, monkeypatch):
    rows = [(f"{i:04d}", [float(2 ** (i % 5)), 0.0]) for i in range(3000)] + [("x", [1.0, 1.0])]
    df = spark.createDataFrame(rows, "c_t__id string, e_s__1 array<float>").repartition(3)
    plan = SimpleNamespace(dataset=SimpleNamespace(id_field="t.id"), spec=SimpleNamespace(id="s@1", metric="cosine"))
    sizes, collect = [], type(df).collect
    monkeypatch.setattr(type(df), "collect", lambda self: sizes.append(len(out := collect(self))) or out)
    assert nearest(df, plan, [3.0, 0.0], 7) == [f"{i:04d}" for i in range(7)]
    assert max(sizes) <= 3 * 7


def test_copies_are_ranked_exactly_once_a_batch(monkeypatch):
    rows = [(f"{i:04d}", [1.0, float(i % 3)]) for i in range(3000)]
    batch = pa.RecordBatch.from_pydict({"id": [i for i, _ in rows], "v": pa.array([v for _, v in rows], pa.list_(pa.float32()))})
    seen, exact = [], vectors.exact
    monkeypatch.setattr(vectors, "exact", lambda v, *more: seen.append(v) or exact(v, *more))
    (out,) = _first([1.0, 2.0], "cosine", 4)(iter([batch, batch.slice(0, 0)]))
    assert out.to_pydict() == {"id": ["0002", "0005", "0008", "0011"], "v": [[1.0, 2.0]] * 4}
    assert len(seen) == 3


def test_hybrid(engine):
    search = {"kind": "hybrid", "semantic": {"using": "note@1", "text": "beta beta", "accuracy": "approximate"}, "lexical": {"field": "bills.note", "text": "beta"}, "fusion": "rrf-v0", "quality": "loose"}
    out = engine.run({"version": "0", "mode": "retrieve", "from": "bills", "select": ["bills.note"], "search": search, "take": 3}, SCOPE)
    assert ids(out)[0] == "2" and len(ids(out)) == 3


def test_pages_are_the_bounded_result(engine):
    got, cursor = [], None
    while True:
        out = engine.run(records(order=(("day", "desc"),)), SCOPE, page_size=3, cursor=cursor)
        got += ids(out)
        cursor = out["page"]["nextCursor"]
        if cursor is None:
            break
        assert re.fullmatch(r"cursor:[A-Za-z0-9_-]{22,512}", cursor)
        assert engine.run(records(), SCOPE, page_size=3, cursor=cursor)["errors"][0]["code"] == "CURSOR_INVALID"
    assert got == ids(engine.run(records(order=(("day", "desc"),)), SCOPE))


def test_model_previews_are_capped(engine):
    out = engine.run(records(), SCOPE, channel="model")
    assert out["page"]["nextCursor"] is None and not out["page"]["truncated"]


def test_first_semantic_error_only(engine):
    q = records(leaf("three", "eq", value=1), select=("id", "one", "two"), order=(("four", "asc"),))
    assert [(e["code"], e["path"]) for e in engine.run(q, SCOPE)["errors"]] == [("REFERENCE_NOT_AVAILABLE", "/select/1")]
    q = aggregate([{"id": "x", "op": "count"}], [{"kind": "field", "field": "bills.note", "id": "x"}])
    assert engine.run(q, SCOPE)["errors"][0]["path"] == "/metrics/0/id"
    assert engine.run(aggregate([{"id": "constructor", "op": "count"}]), SCOPE)["errors"][0]["code"] == "OUTPUT_ID_INVALID"


def test_ingest_outcomes_versions_and_idempotency(spark, tmp_path):
    e = Engine(spark, Catalog.load(DOC), store=str(tmp_path))
    one, two = record(ROWS[0]), record(ROWS[1])
    bad = {"id": "9", "value": {**one["value"], "total": "1.234"}}
    first = e.put(request([one, bad, record(ROWS[4])], "k1"), SCOPE)
    assert [(o["status"], (o["error"] or {}).get("code"), (o["error"] or {}).get("path")) for o in first["outcomes"]] == [("accepted", None, None), ("refused", "NUMERIC_SCALE_MISMATCH", "/records/1/value/total"), ("refused", "SCOPE_INVALID", "/records/2/value/tenant")]
    assert e.put(request([one, bad, record(ROWS[4])], "k1"), SCOPE) == first
    assert e.put(request([two], "k1"), SCOPE)["errors"][0]["code"] == "IDEMPOTENCY_CONFLICT"
    assert e.put(request([one], "k2"), SCOPE)["outcomes"][0]["error"]["code"] == "RECORD_EXISTS"
    assert e.put(request([{**one, "ifVersion": 7}], "k3", "replace"), SCOPE)["outcomes"][0]["error"]["code"] == "VERSION_CONFLICT"
    assert e.put(request([{**one, "ifVersion": 1}], "k4", "replace"), SCOPE)["outcomes"][0]["version"] == 2
    assert e.put(request([{"id": "1"}], "k5", "delete"), SCOPE)["outcomes"][0]["version"] == 3
    assert ids(e.run(records(), SCOPE)) == []
    assert e.put(request([one], "k6"), SCOPE)["outcomes"][0]["version"] == 4
    assert ids(e.run(records(), SCOPE)) == ["1"]
    e.writer("bills").table.compact()
    assert ids(e.run(records(), SCOPE)) == ["1"]


def test_receipts(spark, tmp_path):
    e = Engine(spark, Catalog.load(DOC), store=str(tmp_path))
    first = e.put(request([record(ROWS[0])], "k1"), SCOPE)["writeReceipt"]
    want = {"receipt": first["receipt"], "require": ["record", "embedding:note@1"], "timeoutMs": 0}
    out = e.run(records() | {"afterWrite": want}, SCOPE)
    assert out["determinism"]["writeVisibility"] == "afterWrite" and len(out["provenance"]["afterWrite"]["observed"]) == 2
    assert e.run(records() | {"afterWrite": want}, BOTH)["errors"][0]["code"] == "RECEIPT_INVALID"
    assert e.run(records() | {"afterWrite": {**want, "require": ["embedding:other@1"]}}, SCOPE)["errors"][0]["code"] == "EMBEDDING_UNINDEXED"
    e.put(request([record(ROWS[0])], "k2", "replace"), SCOPE)
    assert e.run(records() | {"afterWrite": want}, SCOPE)["errors"][0]["code"] == "RECEIPT_SUPERSEDED"
    state = {"receipts": {"wr_x": {"scope": SCOPE.fingerprint, "expiresAt": "2999-01-01T00:00:00Z", "records": [{"id": "1", "visibility": {"record": {"state": "pending"}}}]}}}
    now = dt.datetime.now(dt.UTC)
    assert observe("wr_x", ["record"], state, SCOPE, now) is None
    state["receipts"]["wr_x"]["expiresAt"] = "2000-01-01T00:00:00Z"
    with pytest.raises(Refusal):
        observe("wr_x", ["record"], state, SCOPE, now)
    with pytest.raises(ValueError, match="can't become"):
        move("superseded", "ready")


def test_what_is_stored_decides_a_receipt(spark, tmp_path):
    e = Engine(spark, Catalog.load(DOC), store=str(tmp_path))
    first = e.put(request([record(ROWS[0]), record(ROWS[1])], "k1"), SCOPE)["writeReceipt"]
    want = {"receipt": first["receipt"], "require": ["record", "embedding:note@1"], "timeoutMs": 0}
    assert e.run(records() | {"afterWrite": want}, SCOPE)["status"] == "success"
    w = e.writer("bills")
    nothing = w.standing(first["receipt"], w.table.manifest(0) | {"number": 0})
    assert observe(first["receipt"], ["record"], nothing, SCOPE, dt.datetime.now(dt.UTC)) is None
    assert w.put_vector("2", 1, "note@1", None)
    out = e.run(records() | {"afterWrite": want}, SCOPE)
    assert (out["status"], out["errors"][0]["code"], out["errors"][0]["remedy"]["details"]) == ("timeout", "AFTER_WRITE_TIMEOUT", {"receipt": first["receipt"], "require": ["embedding:note@1", "record"]})
    assert e.run(records() | {"afterWrite": {**want, "require": ["record"]}}, SCOPE)["status"] == "success"
    e.put(request([{"id": "2"}], "k2", "delete"), SCOPE)
    error = e.run(records() | {"afterWrite": want}, SCOPE)["errors"][0]
    assert (error["code"], error["path"], error["remedy"]["details"]) == ("RECEIPT_SUPERSEDED", "/afterWrite", {"receipt": first["receipt"]})
    assert e.run(records() | {"afterWrite": {**want, "receipt": "wr_../manifests/000000000001"}}, SCOPE)["errors"][0]["code"] == "RECEIPT_INVALID"


def test_manifests_stay_small_and_lost_attempts_answer_nothing(spark, tmp_path, monkeypatch):
    import json

    from millrace.sources.tables import Conflict, Table

    e = Engine(spark, Catalog.load(DOC), store=str(tmp_path))
    w = e.writer("bills")
    sizes = []
    for i in range(6):
        e.put(request([{**record(ROWS[0])}], f"k{i}", "replace"), SCOPE)
        sizes.append(len(json.dumps({**w.table.manifest(), "deltas": []})))
    assert len(set(sizes)) == 1
    commit, tried = Table.commit, []

    def beaten(table, manifest):
        if not tried:  # another writer is first, with the same key
            tried.append(commit(table, {**manifest, "state": {"write": "other"}}))
            raise Conflict("")
        return commit(table, manifest)

    monkeypatch.setattr(Table, "commit", beaten)
    one = e.put(request([record(ROWS[1])], "late"), SCOPE)
    assert len(w.table.files("answers", *{n for n in w.table.files("answers") if len(w.table.files("answers", n)) == 2})) == 2
    assert e.put(request([record(ROWS[1])], "late"), SCOPE) == one


def test_streaming_ingest(spark, tmp_path):
    e = Engine(spark, Catalog.load(DOC), store=str(tmp_path / "store"))
    rows = [(r[0], r[1], r[2], r[3], {"amount": r[4][0], "currency": r[4][1]}, r[5], r[6], r[7], r[8]) for r in ROWS[:3]]
    schema = "id string, tenant string, total string, free string, paid map<string,string>, count long, at string, day string, note string"
    spark.createDataFrame(rows, schema).write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).json(str(tmp_path / "in"))
    q = stream_into(stream, e.writer("bills"), SCOPE, checkpoint=str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(120) and q.exception() is None
    assert ids(e.run(records(), SCOPE)) == ["1", "2", "3"]


def test_explain_catalog_and_saved_queries(engine):
    plan = engine.explain(records(), SCOPE, channel="operator")
    assert plan["status"] == "explained" and "physicalPlan" in plan
    assert "physicalPlan" not in engine.explain(records(), SCOPE)
    assert [d["id"] for d in engine.search_catalog("bills", SCOPE) if d["kind"] == "dataset"] == ["bills"]
    assert engine.lookup_values("bills.tenant", SCOPE)["values"][0] == {"code": "a", "label": "A"}
    assert engine.describe("secrets", SCOPE)["errors"][0]["code"] == "REFERENCE_NOT_AVAILABLE"
    out = engine.run(records(), SCOPE)
    assert engine.save_query("mine", records(), out, "ex_forged", SCOPE)["errors"][0]["code"] == "RECEIPT_INVALID"
    assert engine.save_query("mine", records(), out, engine.execution_receipt(out), SCOPE)["status"] == "saved"
    assert ids(engine.run_saved("mine", SCOPE)) == ids(out)


def test_backend_text_never_leaves(spark):
    doc = {**DOC, "datasets": [{**DOC["datasets"][0], "rowScope": {"kind": "none", "reason": "x"}, "embeddings": {}}]}
    e = Engine(spark, Catalog.load(doc), {"bills": Binding(lambda s: s.read.parquet("/nowhere/secret_table"))})
    out = e.run(records(), Scope.open())
    assert out["status"] == "refused" and "secret_table" not in str(out)


def test_filters_reach_the_scan(spark, tmp_path):
    spark.range(100).selectExpr("cast(id as string) id", "id n", "'x' other").write.parquet(str(tmp_path / "t"))
    doc = {"version": "1", "datasets": [{"id": "t", "description": "t", "idField": "t.id", "profiles": [], "fields": [{"id": "t.id", "kind": "id"}, {"id": "t.n", "kind": "integer"}, {"id": "t.other", "kind": "text"}]}]}
    e = Engine(spark, Catalog.load(doc), {"t": Binding(lambda s: s.read.parquet(str(tmp_path / "t")))})
    q = {"version": "0", "mode": "records", "from": "t", "select": ["t.id"], "where": {"kind": "predicate", "field": "t.n", "op": "lt", "value": 10}, "order": [{"by": "t.id", "dir": "asc"}], "take": 3}
    plan = e.dataframe(q)._jdf.queryExecution().executedPlan().toString()
    assert "LessThan(n,10)" in plan and "other" not in plan and "TakeOrderedAndProject" in plan


def test_catalog_errors():
    broken = {**DOC, "datasets": [{**DOC["datasets"][0], "idField": "bills.note"}]}
    with pytest.raises(CatalogError):
        Catalog.load(broken)


# -- division, commits ---------------------------------------------------------------


@pytest.mark.parametrize(("places", "scale", "digits"), [(2, 9, 30), (0, 9, 28), (9, 9, 37), (0, 0, 20), (18, 18, 36)])
def test_native_quotients_are_rounded_once(spark, places, scale, digits):
    import random
    from decimal import Decimal

    from pyspark.sql import functions as F

    from millrace.operators.aggregate import quotient
    from millrace.plans.values import divide

    pick = random.Random(places)
    rows = [(None, 3)]
    for _ in range(200):
        top = pick.choice([pick.randrange(10 ** pick.randrange(1, digits)), pick.randrange(100), 0, 5, 15, 25]) * pick.choice([1, -1])
        rows.append((Decimal(top).scaleb(-places), pick.choice([pick.randrange(1, 10), pick.randrange(1, 10**17), 2, 4, 8, 2**62, -3])))
    df = spark.createDataFrame(rows, f"a decimal(38,{places}), n long").withColumn("q", quotient(F.col("a"), places, F.col("n"), scale))
    assert all(r.q == (None if r.a is None else divide(r.a, Decimal(r.n), scale)) for r in df.collect())


def test_averages_and_ratios_need_no_python(spark):
    from millrace import workload

    for name in ("a10_avg_integer", "a11_avg_decimal", "a11_avg_money", "a14_ratio", "f26_having"):
        plan = workload.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "Arrow" not in plan and "Python" not in plan


def test_rounding_modes():
    from decimal import Decimal

    from millrace.plans.values import divide

    for top, want in (("7", ("2", "1", "2")), ("-7", ("-2", "-1", "-2")), ("5", ("1", "1", "2")), ("-6", ("-2", "-1", "-2")), ("8", ("2", "2", "2"))):
        assert tuple(str(divide(Decimal(top), Decimal(4), 0, r)) for r in ("halfEven", "down", "up")) == want


def test_of_two_writers_one_has_to_try_again(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    from millrace import workload
    from millrace.engine import Engine
    from millrace.sources.tables import Conflict

    tables = [Engine(spark, workload.catalog(), store=f"file://{tmp_path}").writer("nations").table for _ in range(4)]
    first = tables[0].manifest()
    tables[0].commit(first)
    with pytest.raises(Conflict):
        tables[1].commit(first)

    def write(table):
        lost = 0
        for _ in range(5):
            while True:
                try:
                    m = table.manifest()
                    table.commit({**m, "state": {"n": m["state"].get("n", 0) + 1}})
                    break
                except Conflict:
                    lost += 1
        return lost

    with ThreadPoolExecutor(4) as pool:
        list(pool.map(write, tables))
    assert tables[0].manifest()["number"] == 21 and tables[0].manifest()["state"] == {"n": 20}
