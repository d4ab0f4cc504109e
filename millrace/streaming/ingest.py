"""Whole-record ingest: per-record outcomes, idempotency, receipts, and a streaming sink on top."""

from __future__ import annotations

import datetime as dt
import re
import secrets
import unicodedata
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors
from ..plans import canon
from ..plans.catalog import Catalog, Dataset, Scope
from ..plans.compile import unindexed
from ..plans.errors import Refusal, error, refuse
from ..plans.values import EXACT, literal, print_decimal, print_instant
from ..sources.tables import Conflict, Table

MODES = ("insertOnly", "replace", "delete")
#: Legal moves of a representation's state.
MOVES = {
    "accepted": ("pending", "ready", "failed", "superseded"),
    "pending": ("ready", "failed", "superseded"),
    "ready": ("superseded",),
    "failed": ("superseded",),
    "superseded": (),
}
#: File sets in the log after which a write compacts it.
LOG = 32


def move(state: str, to: str) -> str:
    if to not in MOVES[state]:
        raise ValueError(f"{state} can't become {to}")
    return to


def token(prefix: str) -> str:
    """An unguessable handle; it holds nothing."""
    return prefix + secrets.token_urlsafe(24)


def embed(dataset: Dataset, catalog: Catalog, spec: str, values: dict, embedder: Callable[[str, int], tuple] = vectors.hashed) -> list[float]:
    s = catalog.specs[spec]
    parts = [values.get(dataset.fields[f].local) for f in s.source_fields]
    if any(p is None for p in parts):
        raise refuse("SCHEMA_REQUIRED_MEMBER", "", [])
    return vectors.f32(list(embedder(unicodedata.normalize("NFC", "\n".join(parts)), s.dimension)), "")


class Ingest:
    """One dataset's writes."""

    def __init__(self, spark: SparkSession, root: str, dataset: Dataset, catalog: Catalog, embedder: Callable[[str, int], tuple] = vectors.hashed, now: Callable[[], dt.datetime] = lambda: dt.datetime.now(dt.UTC)):
        self.table = Table(spark, root, dataset)
        self.dataset, self.catalog, self.embedder, self.now = dataset, catalog, embedder, now

    # -- validation ------------------------------------------------------------------

    def record(self, x: Any, path: str, mode: str, scope: Scope) -> dict:
        """Typed values by local name, of a whole record within scope."""
        d = self.dataset
        key = d.fields[d.id_field]
        if not isinstance(x, dict) or set(x) - {"id", "value", "ifVersion"}:
            raise refuse("SCHEMA_UNKNOWN_MEMBER", path, ["id", "value", "ifVersion"])
        if "id" not in x:
            raise refuse("SCHEMA_REQUIRED_MEMBER", f"{path}/id", ["id"])
        name, _ = literal(key, x["id"], f"{path}/id")
        if "ifVersion" in x and (isinstance(x["ifVersion"], bool) or not isinstance(x["ifVersion"], int)):
            raise refuse("SCHEMA_TYPE_MISMATCH", f"{path}/ifVersion", ["Use a JSON integer."])
        if mode == "delete":
            if "value" in x:
                raise refuse("SCHEMA_UNKNOWN_MEMBER", f"{path}/value", ["id", "ifVersion"])
            return {key.local: name}
        if not isinstance(x.get("value"), dict):
            raise refuse("SCHEMA_REQUIRED_MEMBER" if "value" not in x else "SCHEMA_TYPE_MISMATCH", f"{path}/value", ["value"])
        given = {k.partition(".")[2] if k.startswith(d.id + ".") else k: v for k, v in x["value"].items()}
        if given.get(key.local, name) != name:
            raise refuse("SCHEMA_INVALID_VALUE", f"{path}/value/{key.local}", [])
        given.pop(key.local, None)
        out = {key.local: name}
        for f in d.fields.values():
            if f.id == key.id:
                continue
            at = f"{path}/value/{f.local}"
            if f.local not in given:
                raise refuse("SCHEMA_REQUIRED_MEMBER", at, [f.local])
            typed, _ = literal(f, given.pop(f.local), at)
            out[f.local] = self._stored(f, typed)
        if given:
            raise refuse("SCHEMA_UNKNOWN_MEMBER", f"{path}/value/{sorted(given)[0]}", sorted(f.local for f in d.fields.values()))
        allowed = scope.values(d)
        for dim, values in (allowed or {}).items():
            f = d.fields[dim]
            if out[f.local] not in [literal(f, v, "")[0] for v in values]:
                raise refuse("SCOPE_INVALID", f"{path}/value/{f.local}")
        return out

    @staticmethod
    def _stored(f: Any, typed: Any) -> Any:
        if typed is None:
            return None
        if f.kind == "decimal":
            return typed.quantize(type(typed)(1).scaleb(-f.scale), context=EXACT) if f.precision else print_decimal(typed)
        if f.kind == "money":
            amount = typed[1].quantize(type(typed[1])(1).scaleb(-f.scale), context=EXACT) if f.precision else print_decimal(typed[1])
            return (typed[0], amount)
        return typed

    # -- the write -------------------------------------------------------------------

    def put(self, request: dict, scope: Scope) -> dict:
        """Outcomes in the request's order and a receipt; the same key and content give the same answer again."""
        if not isinstance(request, dict):
            raise refuse("SCHEMA_TYPE_MISMATCH", "", ["Use one closed IngestRequest object."])
        legal = ("dataset", "mode", "records", "embeddingPolicy", "idempotencyKey")
        for name in legal:
            if name not in request:
                raise refuse("SCHEMA_REQUIRED_MEMBER", f"/{name}", [name])
        if unknown := sorted(set(request) - set(legal)):
            raise refuse("SCHEMA_UNKNOWN_MEMBER", f"/{unknown[0]}", list(legal))
        if request["mode"] not in MODES:
            raise refuse("SCHEMA_INVALID_VALUE", "/mode", list(MODES))
        if not isinstance(request["records"], list) or not request["records"]:
            raise refuse("SCHEMA_TYPE_MISMATCH", "/records", ["Use a JSON array of records."])
        if scope.values(self.dataset) is None:
            raise refuse("SCOPE_INVALID")
        while True:
            try:
                return self._put(request, scope)
            except Conflict:
                continue

    def _put(self, request: dict, scope: Scope) -> dict:
        manifest = self.table.manifest()
        key = canon.digest([scope.fingerprint, request["idempotencyKey"]]).partition(":")[2]
        content = canon.digest(request)
        if known := self._answer(key, manifest):
            if known["content"] != content:
                raise refuse("IDEMPOTENCY_CONFLICT", "/idempotencyKey", [])
            return known["result"]
        d, mode = self.dataset, request["mode"]
        local = d.fields[d.id_field].local
        checked: list[dict | Refusal] = []
        for i, x in enumerate(request["records"]):
            try:
                checked.append(self.record(x, f"/records/{i}", mode, scope))
            except Refusal as e:
                checked.append(e)
        names = [c[local] for c in checked if isinstance(c, dict)]
        current = self._current(names, manifest, scope)
        rows, outcomes = {}, []
        for i, (x, c) in enumerate(zip(request["records"], checked, strict=True)):
            path = f"/records/{i}"
            fault = c.errors[0] if isinstance(c, Refusal) else None
            version = None
            if fault is None:
                had = current.get(c[local])
                alive = bool(had and not had["deleted"])
                if had and not had["visible"]:
                    fault = error("RECORD_EXISTS" if mode == "insertOnly" else "RECORD_NOT_FOUND", f"{path}/id", [])
                elif mode == "insertOnly" and alive:
                    fault = error("RECORD_EXISTS", f"{path}/id", [])
                elif mode == "delete" and not alive:
                    fault = error("RECORD_NOT_FOUND", f"{path}/id", [])
                elif "ifVersion" in x and x["ifVersion"] != (had["version"] if alive else 0):
                    fault = error("VERSION_CONFLICT", f"{path}/ifVersion", [])
            if fault is None:
                version = (had["version"] if had else 0) + 1
                rows[c[local]] = self._row(c, version, mode == "delete")
                current[c[local]] = {"version": version, "deleted": mode == "delete", "visible": True}
            given = x.get("id") if isinstance(x, dict) else None
            outcomes.append({"id": given if isinstance(given, str) else "", "status": "refused" if fault else "accepted", "version": version, "error": fault})
        receipt = self._receipt(request, outcomes, scope)
        result = {"outcomes": outcomes, "writeReceipt": receipt}
        # both count only once this attempt's manifest is published: nobody else knows the receipt, and the answer names the manifest
        attempt = uuid.uuid4().hex
        self.table.put_file({**receipt, "scope": scope.fingerprint}, "receipts", f"{receipt['receipt']}.json")
        self.table.put_file({"content": content, "result": result}, "answers", key, f"{manifest['number'] + 1:012d}-{attempt}.json")
        new = {**manifest, "state": {"write": attempt}}
        if rows:
            new = self.table.append(self.table.spark.createDataFrame(list(rows.values()), self.table.schema), new)  # one request's records
        self.table.commit(new)
        if len(new["deltas"]) >= LOG:
            self.table.compact()
        return result

    def _answer(self, key: str, manifest: dict) -> dict | None:
        """What was answered under this key by a write that the manifest holds; one file per attempt."""
        for name in self.table.files("answers", key):
            number, _, attempt = name.removesuffix(".json").partition("-")
            if int(number) <= manifest["number"] and self.table.manifest(int(number))["state"].get("write") == attempt:
                return self.table.get_file("answers", key, name)
        return None

    def standing(self, receipt: str, manifest: dict) -> dict:
        """The receipt with the states that the stored rows show, in the form `observe` takes.

        A version newer than the receipt's supersedes it; an older one, or a missing vector, is still to come.
        """
        found = self.table.get_file("receipts", f"{receipt}.json") if re.fullmatch(r"wr_[\w-]+", receipt) else None
        if found is None:
            return {}
        last = {}
        for r in found["records"]:
            last[r["id"]] = max(r["version"], last.get(r["id"], 0))
        stored = self._stored_rows(list(last), manifest)
        for r in found["records"]:
            row = stored.get(r["id"])
            for name, v in r["visibility"].items():
                if row is None or row["_version"] < last[r["id"]]:
                    v["state"] = "accepted"
                elif row["_version"] > last[r["id"]]:
                    v["state"] = move(v["state"], "superseded")
                elif name.startswith("embedding:") and not row["_deleted"] and not row[name]:
                    v["state"] = "pending"
        return {"receipts": {receipt: found}}

    def _stored_rows(self, names: list[str], manifest: dict) -> dict[str, dict]:
        """Version, deletion and which vectors there are, of one request's records."""
        local = self.dataset.fields[self.dataset.id_field].local
        if not names or (not manifest["base"] and not manifest["deltas"]):
            return {}
        specs = [f"embedding:{s}" for s in self.dataset.embeddings.values()]
        wanted = F.broadcast(self.table.spark.createDataFrame([(n,) for n in names], "__want string"))  # one request's ids
        rows = self.table.versions(manifest).join(wanted, F.col(local) == F.col("__want"), "left_semi")
        return {r[local]: r.asDict() for r in rows.select(local, "_version", "_deleted", *(F.col(f"`{s}`").isNotNull().alias(s) for s in specs)).collect()}

    def put_vector(self, record: str, version: int, spec: str, vector: list[float] | None) -> bool:
        """Write back (or, with None, take out) a vector of exactly this record version; False if it is no longer current."""
        if spec not in self.dataset.embeddings.values():
            raise refuse("EMBEDDING_UNINDEXED", "/embedding", details={"embeddingSpec": spec})
        if vector is not None and len(vector) != self.catalog.specs[spec].dimension:
            raise refuse("SCHEMA_INVALID_VALUE", "/vector", [f"Use {self.catalog.specs[spec].dimension} components."])
        local = self.dataset.fields[self.dataset.id_field].local
        while True:
            manifest = self.table.manifest()
            now = self.table.rows(manifest).where((F.col(local) == record) & (F.col("_version") == version))
            if not now.limit(1).count():
                return False
            value = F.lit(None) if vector is None else F.array(*(F.lit(x) for x in vectors.f32(vector, "/vector")))
            changed = now.withColumn(f"embedding:{spec}", value.cast("array<float>"))
            try:
                self.table.commit(self.table.append(changed, manifest))
                return True
            except Conflict:
                continue

    def _row(self, values: dict, version: int, deleted: bool) -> tuple:
        out = [values.get(f.local) for f in self.dataset.fields.values()]
        for spec in self.dataset.embeddings.values():
            out.append(None if deleted else embed(self.dataset, self.catalog, spec, values, self.embedder))
        return (*out, version, deleted)

    def _current(self, names: list[str], manifest: dict, scope: Scope) -> dict[str, dict]:
        """Versions of the named records; those outside the scope are known only to be there."""
        local = self.dataset.fields[self.dataset.id_field].local
        if not names or (not manifest["base"] and not manifest["deltas"]):
            return {}
        dims = {self.dataset.fields[k].local: [literal(self.dataset.fields[k], v, "")[0] for v in vs] for k, vs in (scope.values(self.dataset) or {}).items()}
        wanted = F.broadcast(self.table.spark.createDataFrame([(n,) for n in set(names)], "__want string"))  # one request's ids
        rows = self.table.versions(manifest).join(wanted, F.col(local) == F.col("__want"), "left_semi").select(local, "_version", "_deleted", *(F.col(f"`{x}`") for x in dims)).collect()
        return {r[local]: {"version": r._version, "deleted": r._deleted, "visible": r._deleted or all(r[k] in v for k, v in dims.items())} for r in rows}

    def _receipt(self, request: dict, outcomes: list[dict], scope: Scope) -> dict:
        at = self.now()
        names = ["record", "lexical", *(f"embedding:{s}" for s in self.dataset.embeddings.values())]
        visible = lambda: {n: {"state": "ready", "token": token("opaque:")} for n in names}
        return {
            "receipt": token("wr_"),
            "operation": request["mode"],
            "issuedAt": print_instant(at),
            "expiresAt": print_instant(at + dt.timedelta(hours=24)),
            "records": [{"id": o["id"], "version": o["version"], "visibility": visible()} for o in outcomes if o["status"] == "accepted"],
        }


def timeout(receipt: str, require: list[str]) -> Refusal:
    """The deadline came first; `require` holds the names asked for."""
    return Refusal(error("AFTER_WRITE_TIMEOUT", "/afterWrite", details={"receipt": receipt, "require": sorted(require)}), status="timeout")


def observe(receipt: str, require: list[str], state: dict, scope: Scope, now: dt.datetime) -> list[dict] | None:
    """Tokens of all required representations of all records; None while any is still to come."""
    found = state.get("receipts", {}).get(receipt)
    if found is None or found["scope"] != scope.fingerprint:
        raise refuse("RECEIPT_INVALID", "/afterWrite/receipt", details={"receipt": receipt})
    if found["expiresAt"] <= print_instant(now):
        raise refuse("RECEIPT_EXPIRED", "/afterWrite/receipt", details={"receipt": receipt})
    states = {n: {r["visibility"][n]["state"] for r in found["records"] if n in r["visibility"]} for n in require}
    if any("superseded" in s for s in states.values()):
        raise refuse("RECEIPT_SUPERSEDED", "/afterWrite", details={"receipt": receipt})
    if failed := sorted(n for n, s in states.items() if "failed" in s):
        raise refuse("RECEIPT_FAILED", "/afterWrite", details={"receipt": receipt, "failedRepresentations": failed})
    out, waiting = [], False
    for r in sorted(found["records"], key=lambda r: r["id"].encode()):
        for name in sorted(require):
            v = r["visibility"].get(name)
            if v is None:
                raise unindexed(name, "/afterWrite/require")
            if v["state"] != "ready":
                waiting = True
            else:
                out.append({"recordId": r["id"], "representation": name, "token": v["token"]})
    return None if waiting else out


def stream_into(stream: DataFrame, ingest: Ingest, scope: Scope, mode: str = "replace", checkpoint: str | None = None, records_a_batch: int = 10_000):
    """A streaming query that writes each micro-batch under a key of its own: a batch that is run again changes nothing.

    Rows become records by field name; a micro-batch is put in slices of `records_a_batch`.
    """
    local = ingest.dataset.fields[ingest.dataset.id_field].local

    def put(batch: DataFrame, number: int) -> None:
        rows, part = [], 0

        def flush() -> None:
            nonlocal rows, part
            if rows:
                ingest.put({"dataset": ingest.dataset.id, "mode": mode, "records": rows, "embeddingPolicy": "catalog", "idempotencyKey": f"{checkpoint}:{number}:{part}"}, scope)
                rows, part = [], part + 1

        for r in batch.orderBy(local).toLocalIterator():
            value = r.asDict()
            name = value.pop(local)
            rows.append({"id": name} if mode == "delete" else {"id": name, "value": value})
            if len(rows) >= records_a_batch:
                flush()
        flush()

    writer = stream.writeStream.foreachBatch(put)
    return writer.option("checkpointLocation", checkpoint) if checkpoint else writer
