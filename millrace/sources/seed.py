"""Seeds: lines of {dataset, id, value} as one insert per dataset and slice."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import SparkSession

from ..plans.errors import refuse
from .decode import read_json


def requests(spark: SparkSession, path: str, records_a_request: int = 10_000) -> Iterator[dict]:
    """Ingest requests of a JSONL file (or folder), in order of the lines; a file read again gives the same keys."""
    held: dict[str, list[dict]] = {}
    parts: dict[str, int] = {}

    def cut(dataset: str) -> dict:
        part = parts[dataset] = parts.get(dataset, -1) + 1
        name = hashlib.sha256(f"{path}|{dataset}|{part}".encode()).hexdigest()[:32]
        return {"dataset": dataset, "mode": "insertOnly", "records": held.pop(dataset), "embeddingPolicy": "catalog", "idempotencyKey": f"seed-{name}"}

    for n, row in enumerate(spark.read.text(path).toLocalIterator(), 1):
        if not row.value.strip():
            continue
        line = read_json(row.value)
        if not isinstance(line, dict) or set(line) != {"dataset", "id", "value"} or not all(isinstance(line[k], str) and line[k] for k in ("dataset", "id")) or not isinstance(line["value"], dict):
            raise refuse("SCHEMA_TYPE_MISMATCH", f"/lines/{n}", ["Use one closed seed record a line."])
        own = held.setdefault(line["dataset"], [])
        own.append({"id": line["id"], "value": line["value"]})
        if len(own) >= records_a_request:
            yield cut(line["dataset"])
    for dataset in sorted(held):
        yield cut(dataset)
