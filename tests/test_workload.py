"""Every registered engine query against its SQL, on the smallest tables."""

import os

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from millrace import workload

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    for name in os.listdir(SF):
        duckdb.sql(f"CREATE OR REPLACE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return duckdb


def rows(frame, columns):
    frame = frame[columns].astype(object)
    return sorted(map(str, frame.where(frame.notna(), None).values.tolist()))


def test_all_have_sql():
    assert set(workload.QUERIES) == set(workload.ORACLES)


@pytest.mark.parametrize("name", sorted(workload.QUERIES))
def test_query(spark, duck, name):
    got, want = workload.QUERIES[name](spark, SF).toPandas(), duck.sql(workload.ORACLES[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert rows(got, columns) == rows(want, columns)


@pytest.fixture(scope="module")
def many(tmp_path_factory):
    """One vector more than an engine admits by default, a tenth of them copies of others; a few have a document."""
    at, n = tmp_path_factory.mktemp("many"), 100_001
    rng = np.random.default_rng(7)
    vectors = rng.standard_normal((n, 64), dtype=np.float32)
    vectors[rng.permutation(n)[: n // 10]] = vectors[rng.integers(0, n, n // 10)]
    items = {"vec_id": pa.array(range(n)), "embedding": pa.FixedSizeListArray.from_arrays(vectors.ravel(), 64).cast(pa.list_(pa.float32())), "label": pa.array([i % 5 for i in range(n)], pa.int32())}
    pq.write_table(pa.table(items), at / "embeddings.parquet")
    pq.write_table(pa.table({"doc_id": pa.array(range(0, 90, 3)), "text": pa.array(["words"] * 30)}), at / "documents.parquet")
    return str(at)


@pytest.mark.parametrize("name", ["r6_cosine_topk", "r7_dot_topk", "r8_euclidean_topk", "r9_ties_by_id"])
def test_more_vectors_than_the_default_limit(spark, many, name):
    duck = pytest.importorskip("duckdb").connect()
    for table in ("embeddings", "documents"):
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{many}/{table}.parquet'")
    got, want = workload.QUERIES[name](spark, many).toPandas(), duck.sql(workload.ORACLES[name]).df()
    columns = sorted(want.columns)
    assert len(want) and rows(got, columns) == rows(want, columns)
