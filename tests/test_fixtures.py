"""Fixture documents of the query contract, read as data from the folder that MILLRACE_FIXTURES names.

Each document in `exact` has a catalog, a scope, seed records, one or more queries and what
they must give; `encoding` has texts that mean the same and texts to refuse; `receipts`
has states over time and whether a query that waits may go on.  They aren't part of this
repository; without the folder nothing is run.
"""

import datetime as dt
import json
import os
import re
from pathlib import Path

import pytest

from millrace.engine import Engine
from millrace.plans import canon
from millrace.plans.catalog import Catalog, Policy, Scope
from millrace.plans.errors import DIALECT, Refusal
from millrace.sources import decode
from millrace.sources.bindings import Binding
from millrace.sources.tables import schema
from millrace.streaming.ingest import Ingest, move, observe, timeout

FOLDER = Path(os.environ.get("MILLRACE_FIXTURES", "/nonexistent"))
EXACT = sorted(FOLDER.glob("exact/*.json"))
PAIRS = sorted(FOLDER.glob("encoding/pairs/*.json"))
REJECTED = sorted(FOLDER.glob("encoding/reject/*"))
RECEIPTS = sorted(FOLDER.glob("receipts/*.json"))
pytestmark = pytest.mark.skipif(not EXACT, reason="MILLRACE_FIXTURES names no folder of fixtures")
NOW = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)


def seeds(fixture):
    """(dataset, record, vectors) of each seed row."""
    first = fixture["catalog"]["datasets"][0]["id"]
    for x in fixture.get("seed", []):
        yield x.get("dataset", first), x.get("record", x), x.get("derived", {})


def load(spark, fixture, tmp_path):
    """An engine over the seed records that ingest takes, and ingest's refusals by position."""
    catalog = Catalog.load(fixture["catalog"])
    everything = Scope.open()
    refused, rows = {}, {name: [] for name in catalog.datasets}
    for i, (name, record, derived) in enumerate(seeds(fixture)):
        d = catalog.datasets[name]
        values = {k: v for k, v in record.items() if f"{name}.{k}" != d.id_field}
        try:
            free = Catalog.load({**fixture["catalog"], "datasets": [{**x, "rowScope": {"kind": "none"}} for x in fixture["catalog"]["datasets"]]})
            typed = Ingest(spark, str(tmp_path), free.datasets[name], free).record({"id": record[d.fields[d.id_field].local], "value": values}, f"/records/{i}", "insertOnly", everything)
        except Refusal as e:
            refused[i] = e.errors[0]
            continue
        vectors = [derived.get(f"embedding:{s}") and [float(x) for x in derived[f"embedding:{s}"]] for s in d.embeddings.values()]
        rows[name].append((*(typed.get(f.local) for f in d.fields.values()), *vectors, 1, False))
    frames = {name: spark.createDataFrame(rows[name], schema(d)) for name, d in catalog.datasets.items()}
    bindings = {name: Binding(lambda _, f=f: f) for name, f in frames.items()}
    given = fixture.get("execution", {}).get("runtimeEmbedder")
    embedder = {"embedder": lambda text, n: tuple(given["queryVector"])} if given else {}
    limit = {"exact_limit": fixture["binding"]["exactEligibleSetMaximum"]} if "binding" in fixture else {}
    policy = Policy(fixture["policy"]) if "policy" in fixture else Policy()
    return Engine(spark, catalog, bindings, policy, now=lambda: NOW, **embedder, **limit), refused


def queries(fixture):
    if "cases" in fixture:
        return {c["name"]: c["query"] for c in fixture["cases"]}
    return fixture.get("queries") or {"": fixture["query"]}


def told(error, fixture):
    """The error with this engine's name for the language in place of the document's."""
    name = fixture["format"].partition("-")[0]
    return json.loads(re.sub(name, DIALECT, json.dumps(error), flags=re.I))


@pytest.mark.parametrize("path", EXACT, ids=lambda p: p.stem)
def test_fixture(spark, path, tmp_path):
    fixture = json.loads(path.read_text())
    want, how = fixture["expected"], fixture.get("execution", {})
    engine, refused = load(spark, fixture, tmp_path)
    if want.get("phase") == "ingest":
        for o in want["recordOutcomes"]:
            error = refused.get(o["seedIndex"])
            assert (error is None) == (o["outcome"] == "accepted"), o
            if error:
                assert error == o["error"]
        return
    scope, got = Scope({**fixture["scope"], "version": "0"}), {}
    for name, query in queries(fixture).items():
        if size := how.get("pageSize"):
            out = engine.run(query, scope, anchor=how.get("anchor"), page_size=size)
            rows = list(out["data"]["rows"])
            while cursor := out["page"]["nextCursor"]:
                out = engine.run(query, scope, anchor=how.get("anchor"), page_size=size, cursor=cursor)
                rows += out["data"]["rows"]
            out["data"]["rows"] = rows
        else:
            out = engine.run(query, scope, anchor=how.get("anchor"))
        got[name] = out
    if "success" in want.get("outcome", ""):
        semantic = want["semantic"]
        for name, out in got.items():
            assert out["status"] == "success", out
            expected = semantic.get(name, semantic)
            (kind,) = (k for k in expected if k in ("rows", "groups", "concatenatedRows"))
            assert out["data"]["groups" if kind == "groups" else "rows"] == expected[kind]
        for name, digest in (want.get("sourceQueryHashes") or ({"": want["sourceQueryHash"]} if "sourceQueryHash" in want else {})).items():
            assert got[name]["provenance"]["sourceQueryHash"] == digest
        return
    for name, out in got.items():
        errors = want.get("structuralErrors") or [want.get("errorsByCase", {}).get(name) or want.get("error") or want["errorShape"]]
        assert out["status"] != "success"
        assert out["errors"] == told(errors, fixture), name


@pytest.mark.parametrize("path", PAIRS, ids=lambda p: p.stem)
def test_same_meaning(path):
    assert canon.jcs(decode.decode(path.read_bytes())) == canon.jcs(decode.decode(path.with_suffix(".yaml").read_bytes()))


@pytest.mark.parametrize("path", REJECTED, ids=lambda p: p.stem)
def test_rejected(path):
    with pytest.raises(Refusal) as refused:
        decode.decode(path.read_bytes())
    assert refused.value.errors[0]["code"] == re.search(r"EXPECT: (\w+)", path.read_text())[1]


def visibility(step, fixture):
    """(record id, states by representation) at one step of a fixture."""
    if "records" in step:
        return [(k, {n: {"state": s, "token": f"{k}/{n}"} for n, s in v.items()}) for k, v in step["records"].items()]
    seen = step.get("visibility") or {n: {"state": s, "token": n} for n, s in step["queryRouteVisibility"].items()}
    setup = fixture["setup"]
    return [((setup.get("record") or setup["existingRecord"])["id"], seen)]


@pytest.mark.parametrize("path", RECEIPTS, ids=lambda p: p.stem)
def test_receipt(path):
    fixture = json.loads(path.read_text())
    want, scope = fixture["expected"], Scope.open()
    for trace in fixture.get("traces", []):
        try:
            for a, b in zip(trace["states"], trace["states"][1:]):
                move(a, b)
            assert trace["expected"] == "valid"
        except ValueError:
            assert trace["expected"] == "invalid"
    if "timeline" not in fixture:
        if "traces" not in fixture:
            pytest.skip("about what a runner or a binding does: no states over time")
        return
    asked = fixture["query"]["afterWrite"]
    went = {}
    for step in fixture["timeline"]:
        records = [{"id": k, "version": 1, "visibility": v} for k, v in visibility(step, fixture)]
        state = {"receipts": {asked["receipt"]: {"expiresAt": "2099-01-01T00:00:00Z", "scope": scope.fingerprint, "records": records}}}
        went[step["step"]] = observe(asked["receipt"], asked["require"], state, scope, NOW)
    for attempt in want.get("attempts", []):
        assert (went[attempt["step"]] is not None) == (attempt["outcome"] == "success")
    if want.get("outcome") == "structured-timeout":
        assert went[want["atStep"]] is None
        assert timeout(asked["receipt"], asked["require"]).errors == [want["error"]]
