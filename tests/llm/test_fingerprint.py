import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from millrace.llm import fingerprint as op

from .common import documents, empty, jaccard, odd, shingles, texts


def brute(rows):
    """id -> (code points, sha of the edited text) by descending id."""
    rows = sorted(rows, key=lambda r: -r[0])
    out = {}
    for (i, a), (_, b) in zip(rows, rows[1:] + rows[:1]):
        a, b = a or "", b or ""
        k = len(a) // 3
        edited = a[: len(a) - k] + b[:k]
        out[i] = (len(a), hashlib.sha256(edited.encode()).hexdigest(), jaccard(shingles(a), shingles(edited)), jaccard(shingles(a), shingles(b)))
    return out


def test_against_brute_force(spark):
    docs = documents(spark)
    want = brute(texts(docs))
    got = {r.doc_id: r for r in op.fingerprints(docs).collect()}
    assert len(got) == len(want)
    errors = []
    for i, (n, sha, edited, after) in want.items():
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (n, sha)
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        errors += [abs(r.near_edited - edited), abs(r.near_next - after)]
    assert sum(errors) / len(errors) < 0.05


def test_the_next_document_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(op, "RANGES", 5)
    pick = random.Random(1)
    ids = [*range(40), *(10**15 + k for k in range(40)), *(pick.randrange(-(10**17), 10**17) for _ in range(40))]
    rows = [(i, f"text {i} " + " ".join(str(pick.random()) for _ in range(pick.randrange(30)))) for i in ids]
    got = {r.doc_id: r.edited_sha256 for r in op.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: sha for i, (_, sha, _, _) in brute(rows).items()}


def test_hot_ids_are_cut_by_text(spark, monkeypatch):
    monkeypatch.setattr(op, "HOT_SHARE", 0.1)
    monkeypatch.setattr(op, "HOT_ROWS", 10)
    monkeypatch.setattr(op, "RANGES", 3)
    pick = random.Random(4)
    ids = [None] * 60 + [5] * 60 + [7] * 40 + [*range(-20, 60)]
    rows = [(i, f"text {k} " + " ".join(str(pick.random()) for _ in range(pick.randrange(20)))) for k, i in enumerate(ids)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    ordered = df.orderBy(F.col("doc_id").desc_nulls_last(), F.xxhash64("text")).collect()
    want = []
    for a, b in zip(ordered, ordered[1:] + ordered[:1], strict=True):
        k = len(a.text) // 3
        want.append((a.doc_id, hashlib.sha256((a.text[: len(a.text) - k] + b.text[:k]).encode()).hexdigest()))
    own = df.select(F.col("doc_id").alias("id"), "text")
    assert own.select(op._within(own, len(rows), 16).alias("w")).distinct().count() > 20
    assert sorted(((r.doc_id, r.edited_sha256) for r in op.fingerprints(df).collect()), key=str) == sorted(want, key=str)


def test_equal_texts_and_odd_rows(spark):
    out = op.fingerprints(odd(spark)).collect()
    assert len(out) == odd(spark).count()
    by = {}
    for r in out:
        by.setdefault(r.doc_id, []).append(r)
    assert by[6][0].fingerprint == by[7][0].fingerprint == by[7][1].fingerprint == by[8][0].fingerprint
    assert by[1][0].fingerprint == by[2][0].fingerprint == by[4][0].fingerprint == ""
    assert by[5][0].fingerprint and by[10][0].n_chars == 1_080_000


def test_one_row_and_none(spark):
    one = spark.createDataFrame([(7, "abc")], "doc_id long, text string")
    r = op.fingerprints(one).first()
    assert r.edited_sha256 == hashlib.sha256(b"aba").hexdigest() and r.near_next == 1.0
    assert op.fingerprints(empty(spark)).count() == 0


def test_sketches_merge_and_contain(spark):
    pick = random.Random(2)
    word = lambda: f"w{pick.randrange(10**6)}"
    small = " ".join(word() for _ in range(400))
    large = " ".join(word() for _ in range(20_000)) + " " + small
    df = spark.createDataFrame([(1, small), (2, large), (3, "other words entirely " + " ".join(word() for _ in range(300)))], "doc_id long, text string")
    s = op.sketches(df).collect()
    a, b, c = (next(r.sketch for r in s if r.doc_id == k) for k in (1, 2, 3))
    row = spark.createDataFrame([(a, b, c)], "a array<long>, b array<long>, c array<long>")
    x = row.select(op.containment(F.col("a"), F.col("b")).alias("ab"), op.containment(F.col("b"), F.col("a")).alias("ba"), op.merge(F.col("a"), F.col("c")).alias("m"), op.likeness(F.col("a"), F.col("c")).alias("no")).first()
    assert x.ab == 1.0 and x.ba < 0.05 and x.no == 0 and set(x.m) == set(a) | set(c)
    assert 0.15 < len(b) / 20_396 < 0.35  # the fixed fraction


def test_no_python_in_the_plan(spark):
    plan = op.fingerprints(documents(spark))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


@pytest.mark.parametrize("n", [1, 5])
def test_short_texts_have_one_shingle(spark, n):
    df = spark.createDataFrame([("a b",), ("a b c d e",), ("",)], "t string")
    assert [r.n for r in df.select(F.size(op.hashes(op.words(F.col("t")))).alias("n")).collect()] == [1, 1, 0]
