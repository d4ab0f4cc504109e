import json
import random
import threading
import urllib.request

import pytest

from millrace.engine import CURSOR_LIFE, Engine
from millrace.plans import grammar
from millrace.plans.catalog import Catalog, Scope
from millrace.plans.grammar import LIMITS
from millrace.plans.json_schema import schema
from millrace.plans.quality import Certification, report
from millrace.service import TOOLS, Caller, Service
from millrace.sources import seed, sinks
from millrace.sources.bindings import Binding

from .test_engine import BOTH, DOC, ROWS, SCOPE, ids, record, records, request, retrieve


@pytest.fixture(scope="module")
def service(spark, tmp_path_factory):
    e = Engine(spark, Catalog.load(DOC), store=str(tmp_path_factory.mktemp("store")))
    e.put(request([record(r) for r in ROWS], "seed"), BOTH)
    return Service(e, {"agent": Caller(SCOPE, "model"), "person": Caller(SCOPE, "principal")})


def test_tools(service):
    who = service.callers["agent"]
    out = service.call("run_query", {"query": records()}, who)
    assert ids(out) == ["1", "2", "3", "4"] and out["executionReceipt"].startswith("ex_")
    assert service.call("save_query", {"name": "q", "query": records(), "executionReceipt": out["executionReceipt"]}, who)["status"] == "saved"
    assert service.call("lookup_values", {"field": "bills.tenant", "query": "b"}, who)["values"] == [{"code": "b", "label": "B"}]
    assert service.call("search_catalog", {"query": "BILL", "limit": 1}, who) == {"items": [{"kind": "dataset", "id": "bills"}]}
    assert service.call("describe_catalog", {"refs": ["bills"]}, who)["items"][0]["idField"] == "bills.id"
    assert service.call("explain_query", {"query": records()}, who)["status"] == "explained"
    assert service.call("nothing", {}, who)["errors"][0]["alternatives"] == sorted(TOOLS)
    assert service.call("run_query", {"query": records(), "x": 1}, who)["errors"][0]["path"] == "/x"


def test_only_named_members_reach_a_model(service):
    agent, person = service.callers["agent"], service.callers["person"]
    for query in (records(select=("id", "paid")), retrieve(take=2)):
        whole, shown = (service.call("run_query", {"query": query}, who) for who in (person, agent))
        assert set(whole["provenance"]) - set(shown["provenance"]) >= {"snapshotOrWatermark", "afterWrite"}
        assert shown["data"]["rows"] == whole["data"]["rows"][:20]
        assert "indexWatermark" not in (shown["provenance"].get("retrieval") or {})
    made = {**whole, "secret": 1, "provenance": {**whole["provenance"], "shard": 7}, "data": {"rows": [{**r, "hidden": "x"} for r in whole["data"]["rows"]], "raw": []}}
    made["schema"] = [{**c, "physicalName": "p"} for c in made["schema"]]
    assert sinks.for_model(made) == sinks.for_model(whole)
    with pytest.raises(TypeError):
        sinks.for_model({**whole, "data": {"rows": [{"bills.id": ["nested"]}]}})


def test_answers_and_handles_end(service):
    agent, now = service.callers["agent"], service.engine.now
    receipt = service.call("run_query", {"query": records()}, agent)["executionReceipt"]
    handle = service.open_result({"query": records()}, service.callers["person"])["handle"]
    try:
        service.engine.now = lambda: now() + CURSOR_LIFE
        late = service.call("save_query", {"name": "late", "query": records(), "executionReceipt": receipt}, agent)
        assert late["errors"][0]["code"] == "RECEIPT_INVALID"
        assert service.page(handle, service.callers["person"])["errors"][0]["code"] == "CURSOR_INVALID"
        service.call("run_query", {"query": records()}, agent)
        assert receipt not in service._answers or len(service._answers) == 1
    finally:
        service.engine.now = now


def test_http(service):
    server = service.server()
    threading.Thread(target=server.serve_forever, daemon=True).start()

    def ask(path, body=None, token="agent"):
        req = urllib.request.Request(f"http://127.0.0.1:{server.server_port}{path}", None if body is None else json.dumps(body).encode(), {"Authorization": f"Bearer {token}"})
        try:
            with urllib.request.urlopen(req, timeout=60) as r:
                return r.status, r.read().decode()
        except urllib.error.HTTPError as e:
            return e.code, ""

    assert ask("/health/live")[0] == 200 and ask("/health/ready")[0] == 200
    assert ask("/v0/query/run", {"query": records()}, "stranger")[0] == 401
    assert ids(json.loads(ask("/v0/query/run", {"query": records()})[1])) == ["1", "2", "3", "4"]
    assert json.loads(ask("/v0/principal-results", {"query": records()})[1])["errors"][0]["code"] == "POLICY_DENIED"
    handle = json.loads(ask("/v0/principal-results", {"query": records(), "pageSize": 3}, "person")[1])["handle"]
    first = json.loads(ask(f"/v0/principal-results/{handle}", token="person")[1])
    assert ids(first) == ["1", "2", "3"]
    lines = ask(f"/v0/principal-results/{handle}/stream", token="person")[1].strip().split("\n")
    assert [json.loads(x)["bills.id"] for x in lines[1:]] == ["1", "2", "3", "4"]
    assert ask("/v0/nowhere", {})[0] == 404
    assert ask("/v0/query/run", {"x": "y" * LIMITS["bytes"]})[0] == 413
    server.shutdown()


def test_seed_lines_and_vectors(spark, tmp_path):
    lines = [json.dumps({"dataset": "bills", **record(r)}) for r in ROWS[:3]]
    (tmp_path / "seed.jsonl").write_text("\n".join(lines) + "\n\n")
    e = Engine(spark, Catalog.load(DOC), store=str(tmp_path / "store"))
    for _ in range(2):  # the second reading replays
        for r in seed.requests(spark, str(tmp_path / "seed.jsonl"), 2):
            assert all(o["status"] == "accepted" for o in e.put(r, SCOPE)["outcomes"])
    assert ids(e.run(records(), SCOPE)) == ["1", "2", "3"]
    w = e.writer("bills")
    assert w.put_vector("3", 1, "note@1", [float(x) for x in e.embedder("beta", 4)]) and not w.put_vector("3", 9, "note@1", None)
    assert ids(e.run(retrieve(text="beta", take=1), SCOPE)) == ["3"]
    assert w.put_vector("3", 1, "note@1", None)
    assert "3" not in ids(e.run(retrieve(text="beta", take=9), SCOPE))


def test_certifications(spark, service):
    import datetime as dt

    good = {"mean": "0.95", "eligibilityViolations": 0}
    c = Certification("c", "1", "strict", "note@1", "1", {"corpus": "x"}, "2024-01-01T00:00:00Z", 10, good, {"mean": "0.9"}, frozenset({"eq"}))
    early, late = dt.datetime(2024, 1, 5, tzinfo=dt.UTC), dt.datetime(2024, 1, 11, tzinfo=dt.UTC)
    assert (c.status(early, {"corpus": "x"}), c.status(late, {"corpus": "x"}), c.status(early, {"corpus": "y"})) == ("valid", "stale", "stale")
    e = Engine(spark, service.engine.catalog, store=service.engine.store, certifications=(c,), bound={"corpus": "x"}, now=lambda: early)
    out = e.run(retrieve("approximate", "strict"), SCOPE)
    assert out["provenance"]["retrieval"]["qualityCertification"]["status"] == "valid"
    where = {"kind": "predicate", "field": "bills.count", "op": "gt", "value": 1}
    assert e.run(retrieve("approximate", "strict", where=where), SCOPE)["errors"][0]["code"] == "FILTER_SHAPE_UNCERTIFIED"


def test_recall_report():
    out = report({"a": ["1", "2"], "b": []}, {"a": ["1", "3"], "b": ["9"], "c": []}, {"a": {"1", "2", "3"}, "b": {"9"}, "c": set()}, 2)
    assert [q["recall"] for q in out["perQuery"]] == ["0.500000000", "0.000000000", "emptyEligible"]
    assert (out["mean"], out["median"], out["sampleCount"], out["eligibilityViolations"]) == ("0.250000000", "0.250000000", 2, 0)


def test_schema_covers_the_grammar():
    s = schema()
    modes = [x["properties"]["mode"]["const"] for x in s["oneOf"]]
    assert modes == list(grammar.MEMBERS)
    for x, (needed, more) in zip(s["oneOf"], grammar.MEMBERS.values()):
        assert set(x["properties"]) == {*needed, *more} and set(x["required"]) == set(needed)


def test_no_row_outside_scope_is_ever_seen(spark):
    """Random tenants, filters and modes: answers equal those over the allowed rows alone."""
    pick = random.Random(7)
    rows = [(str(k), f"t{pick.randrange(4)}", pick.randrange(10), f"note {pick.randrange(5)}", [float(pick.randrange(-9, 10)) for _ in range(3)] or [1.0] * 3) for k in range(60)]
    frame = spark.createDataFrame(rows, "id string, tenant string, n long, note string, v array<double>").cache()
    doc = {
        "version": "s",
        "embeddingSpecs": [{"id": "e@1", "sourceFields": ["d.note"], "model": {"id": "m", "revision": "1"}, "dimension": 3, "metric": "dotProduct"}],
        "qualityProfiles": [{"id": "loose", "thresholds": None}],
        "datasets": [{"id": "d", "description": "d", "idField": "d.id", "profiles": [], "rowScope": {"kind": "partition", "dimensions": ["d.tenant"]}, "embeddings": {"e": "e@1"}, "fields": [{"id": "d.id", "kind": "id"}, {"id": "d.tenant", "kind": "text"}, {"id": "d.n", "kind": "integer"}, {"id": "d.note", "kind": "text"}]}],
    }
    e = Engine(spark, Catalog.load(doc), {"d": Binding(lambda _: frame, embeddings={"e@1": "v"})}, embedder=lambda t, d: (1.0, -2.0, 3.0))
    for _ in range(12):
        allowed = pick.sample(["t0", "t1", "t2", "t3"], pick.randrange(0, 4))
        bound = pick.randrange(10)
        scope = Scope.open({"d.tenant": allowed})
        where = {"kind": "or", "items": [{"kind": "predicate", "field": "d.n", "op": "lt", "value": bound}, {"kind": "predicate", "field": "d.tenant", "op": "eq", "value": pick.choice(["t0", "t1", "t2", "t3"])}]}
        eligible = [r for r in rows if r[1] in allowed and (r[2] < bound or r[1] == where["items"][1]["value"])]
        q = {"version": "0", "mode": "records", "from": "d", "select": ["d.id"], "where": where, "order": [{"by": "d.n", "dir": "desc"}], "take": 50}
        assert [r["d.id"] for r in e.run(q, scope)["data"]["rows"]] == [r[0] for r in sorted(eligible, key=lambda r: (-r[2], r[0]))][:50]
        q = {"version": "0", "mode": "retrieve", "from": "d", "where": where, "search": {"kind": "semantic", "using": "e@1", "text": "x", "accuracy": "exact", "quality": "exact-oracle-v0"}, "take": 7}
        best = sorted(eligible, key=lambda r: (-(r[4][0] - 2 * r[4][1] + 3 * r[4][2]), r[0]))[:7]
        assert [r["d.id"] for r in e.run(q, scope)["data"]["rows"]] == [r[0] for r in best]
        q = {"version": "0", "mode": "aggregate", "from": "d", "where": where, "dimensions": [], "metrics": [{"id": "n", "op": "count"}], "order": [{"by": "n", "dir": "asc"}], "take": 1}
        assert e.run(q, scope)["data"]["groups"] == [{"n": len(eligible)}]


def test_cost_gates(service):
    narrow = Scope.open({"bills.tenant": ["a"]}, rows=3)
    out = service.engine.run(records(take=4), narrow)["errors"][0]
    assert (out["code"], out["path"], out["remedy"]["details"]["budget"]) == ("COST_LIMIT_EXCEEDED", "/take", "rows")
    assert service.engine.run(records(take=3), narrow)["status"] == "success"
    assert service.engine.run(retrieve(take=5), Scope.open({"bills.tenant": ["a"]}, candidates=4))["errors"][0]["remedy"]["details"]["budget"] == "candidates"
    assert service.engine.run(records(take=100), Scope.open({"bills.tenant": ["a"]}, intermediateBytes=500))["errors"][0]["code"] == "COST_LIMIT_EXCEEDED"


def test_catalog_resources_and_documentation(service):
    assert service.engine.resources(SCOPE) == ["catalog://source", "catalog://source/datasets/bills"]
    assert service.engine.read_resource("catalog://source/datasets/bills", SCOPE)["id"] == "bills"
    assert service.engine.read_resource("catalog://source/datasets/secrets", SCOPE)["errors"][0]["code"] == "REFERENCE_NOT_AVAILABLE"
    text = service.engine.documentation(SCOPE)
    assert "bills.total (decimal, nullable)" in text and "secrets" not in text


def test_stored_vectors_decode(spark):
    import numpy as np

    from millrace.sources.encodings import decoded

    for encoding, raw, want in (
        ("float32", np.array([1.5, -2], "<f4").tobytes(), [1.5, -2.0]),
        ("float64", np.array([0.25, 4], "<f8").tobytes(), [0.25, 4.0]),
        ("int8", np.array([-3, 7], "i1").tobytes(), [-3.0, 7.0]),
        ("binary", bytes([2]), [0.0, 1.0]),
    ):
        df = spark.createDataFrame([(1, bytearray(raw)), (2, None)], "id long, v binary")
        assert [r.v for r in decoded(df, "v", encoding, 2).orderBy("id").collect()] == [want, None]
