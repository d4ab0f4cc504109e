import random
import zlib

from millrace.llm import sharding as op

from .common import documents, empty, odd, texts


def check(docs, shards=40):
    got = op.shard(docs, shards=shards).collect()
    want = sorted(((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in texts(docs)), key=str)
    assert sorted(((r.doc_id, r["size"], r.text_crc32) for r in got), key=str) == want
    total, slots = {}, {}
    for r in got:
        assert 0 <= r.shard < shards and r.law == "bytes" and r.grown_shard is None
        total[r.shard] = total.get(r.shard, 0) + r["size"]
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return got, total


def test_near_equal_bytes(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got, total = check(docs)
    mean = sum(total.values()) / 40
    assert len(total) == 40 and max(total.values()) < 1.05 * mean and min(total.values()) > 0.95 * mean
    at = {}
    text = dict(texts(docs))
    for r in got:
        at.setdefault(text[r.doc_id], set()).add(r.shard)
    assert all(len(s) == 1 for s in at.values())


def test_a_group_heavier_than_a_shard(spark):
    pick = random.Random(5)
    rows = [(i, "hot text " * 20) for i in range(600)] + [(1000 + i, " ".join(str(pick.random()) for _ in range(pick.randrange(1, 20)))) for i in range(1200)]
    _, total = check(spark.createDataFrame(rows, "doc_id long, text string"), 10)
    mean = sum(total.values()) / 10
    assert max(total.values()) < 1.15 * mean and min(total.values()) > 0.85 * mean


def test_odd_rows(spark):
    check(odd(spark), 4)
    check(odd(spark), 1)
    check(documents(spark).limit(3).select("doc_id", "text"), 40)


def plain(items, leaves, first):
    """The tree over (g, bytes, keys...) by sorting: {g: leaf}."""
    if leaves == 1 or not items:
        return {x[0]: first for x in items}
    k = leaves // 2
    spans = [max(x[2 + d] >> op.TIE for x in items) - min(x[2 + d] >> op.TIE for x in items) for d in range(len(items[0]) - 2)]
    items = sorted(items, key=lambda x: x[2 + spans.index(max(spans))])
    want, below, n = sum(x[1] for x in items) * k / leaves, 0, 0
    while n < len(items) and below + items[n][1] <= want:
        below += items[n][1]
        n += 1
    if n < len(items) and want - below > items[n][1] / 2:
        n += 1
    return plain(items[:n], k, first) | plain(items[n:], leaves - k, first + k)


def test_tree_against_sorting(spark):
    pick = random.Random(8)
    for shards in (2, 5, 8):
        items = [(g, pick.randrange(50, 60), *((pick.randrange(1 << width) << op.TIE) + pick.randrange(1 << op.TIE) for width in (6, 9, 9))) for g in range(90)]
        light = spark.createDataFrame(items, "g long, bytes long, k0 long, k1 long, k2 long")
        _, placed = op.build(light, 3, shards, sum(x[1] for x in items), [])
        assert {r.g: r.light_shard for r in placed.collect()} == plain(items, shards, 0)


def test_shards_hold_alike_documents(spark):
    rows = [(i, f"words {i} " * 30, "en" if i % 16 < 10 else "fr" if i % 16 < 15 else "de") for i in range(1600)]
    got, _ = check(spark.createDataFrame(rows, "doc_id long, text string, lang string"), 16)
    lang = {r[0]: r[2] for r in rows}
    held = {}
    for r in got:
        held.setdefault(r.shard, set()).add(lang[r.doc_id])
    assert sum(len(v) == 1 for v in held.values()) >= 13


def test_empty_table(spark):
    assert op.shard(empty(spark)).count() == 0
