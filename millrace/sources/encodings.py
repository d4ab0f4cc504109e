"""Stored vectors in other encodings, and opaque names for managed tables."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Encodings and their little-endian element types.
ELEMENTS = {"float32": "<f4", "float64": "<f8", "int8": "i1"}


def decoded(df: DataFrame, name: str, encoding: str, dimension: int) -> DataFrame:
    """A binary column as array<float>; rows of another length are refused.  "binary" holds one bit a component, as 0 or 1."""
    place = df.columns.index(name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for raw in batch.column(place).to_pylist():
                if raw is None:
                    out.append(None)
                    continue
                if encoding == "binary":
                    x = np.unpackbits(np.frombuffer(raw, np.uint8), bitorder="little")[:dimension]
                else:
                    x = np.frombuffer(raw, ELEMENTS[encoding])
                if len(x) != dimension or (encoding == "binary" and len(raw) != -(-dimension // 8)):
                    raise ValueError("EMBEDDING_UNINDEXED@/search/using@")
                out.append(x.astype(np.float32).tolist())
            columns = [pa.array(out, pa.list_(pa.float32())) if i == place else c for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    schema = ", ".join(f"`{f.name}` {'array<float>' if f.name == name else f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(run, schema)


def input_text(*fields: Column) -> Column:
    """An embedding's input: its source fields by line; null if any of them is."""
    joined = F.concat_ws("\n", *fields)
    missing = fields[0].isNull()
    for f in fields[1:]:
        missing = missing | f.isNull()
    return F.when(~missing, joined)


def physical_name(catalog_version: str, dataset: str, member: str = "") -> str:
    """A name that shows nothing of what it stands for."""
    return "m_" + hashlib.sha256("\0".join((catalog_version, dataset, member)).encode()).hexdigest()[:24]
