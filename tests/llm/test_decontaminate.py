import hashlib
import random

import pytest

from millrace.llm import decontaminate as op

from .common import SENTENCE, SF, documents, empty, odd, row, texts, words


def brute(docs, items, window=13):
    out = []
    wanted = {}
    for name, text in items:
        w = words(text)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            wanted.setdefault(tuple(w[k : k + window]), set()).add(str(name))
    sizes = {len(x) for x in wanted}
    for name, text in docs:
        w, hit, found = words(text), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (x := tuple(w[k : k + n])) in wanted:
                    hit |= set(range(k, k + n))
                    found |= wanted[x]
        sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((name, len(w), len(hit), len(found), sha, bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def check(docs, bench):
    items = [(r.item_id, r.text) for r in bench.collect()]
    assert sorted(map(tuple, op.digest(op.search(docs, bench)).collect()), key=str) == brute(texts(docs), items)


def bench_of(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def test_against_brute_force(spark):
    check(documents(spark), spark.read.parquet(f"{SF}/benchmark.parquet"))


def test_odd_rows_and_items(spark):
    items = [(1, SENTENCE), (1, "again jumps"), (2, "One"), (3, None), (4, ""), (5, "!!"), (6, "lorem ipsum dolor sit amet " * 4), (7, SENTENCE), (8, "not there at all"), (None, "the quick")]
    docs = odd(spark, [row(20, "x " + SENTENCE[:70]), row(21, "one " * 30), row(22, SENTENCE + " filler" * 2000)])
    check(docs, bench_of(spark, items[:-1]))
    op.search(docs, bench_of(spark, items)).count()


@pytest.mark.parametrize("block", [1, 3])
def test_blocks_of_items(spark, monkeypatch, block):
    monkeypatch.setattr(op, "ITEMS_A_BLOCK", block)
    check(odd(spark), bench_of(spark, [(1, SENTENCE), (2, "One"), (3, "lorem ipsum dolor sit amet lorem ipsum"), (4, "fox jumps over"), (5, "brown fox jumps over the")]))


@pytest.mark.parametrize("block", [20_000, 2])
def test_items_without_an_id(spark, monkeypatch, block):
    monkeypatch.setattr(op, "ITEMS_A_BLOCK", block)
    items = [(None, "quick brown fox"), (None, "lorem ipsum dolor sit amet " * 4), (None, None), (1, "fox jumps over"), (2, "seven wizards"), (3, "one two three")]
    docs = odd(spark)
    want = brute(texts(docs), items)  # names the items without an id None
    found = op.search(docs, bench_of(spark, items))
    got = sorted(map(tuple, op.digest(found).collect()), key=str)
    assert [r[:4] + r[5:] for r in got] == [r[:4] + r[5:] for r in want] and any(r[3] == 3 for r in got)
    named = {hashlib.sha256(",".join(sorted(i for i in r["items"] if i is not None)).encode()).hexdigest() for r in found.collect()}
    assert {r[4] for r in got} == named and all(r["items"].count(None) <= 1 for r in found.collect())


def test_proximity_matches(spark):
    w = SENTENCE.split()
    changed = " ".join([*w[:6], "slowly", *w[7:]])
    docs = spark.createDataFrame([(1, changed), (2, "nothing alike here")], "doc_id long, text string")
    found = {r.doc_id: r for r in op.search(docs, bench_of(spark, [(1, " ".join(w[:13]))])).collect()}
    assert found[1]["items"] == [] and found[1]["near_items"] == ["1"] and found[2]["near_items"] == []


def test_proximity_matches_at_every_place(spark):
    w = SENTENCE.split()[:13]
    docs = [(k, " ".join(["so", *w[:k], "slowly", *w[k + 1 :], "on"])) for k in range(13)]
    found = {r.doc_id: r for r in op.search(spark.createDataFrame(docs, "doc_id long, text string"), bench_of(spark, [(1, " ".join(w))])).collect()}
    assert all(found[k]["items"] == [] and found[k]["near_items"] == ["1"] for k in range(13))


@pytest.mark.parametrize("near", [0.85, 0.7])
def test_proximity_matches_against_brute_force(spark, near):
    rng = random.Random(5)
    items = [(i, [rng.choice("abcdefghij") for _ in range(rng.choice([3, 7, 13, 16]))]) for i in range(12)]
    docs = []
    for k in range(60):
        w = list(rng.choice(items)[1])
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = rng.choice("abcxyz")
        docs.append((k, [rng.choice("abcx") for _ in range(3)] + w + [rng.choice("abcx") for _ in range(3)]))
    want = {k: set() for k, _ in docs}
    for k, w in docs:
        for i, x in items:
            n = min(13, len(x))
            for probe in (x[s : s + n] for s in range(len(x) - n + 1)):
                missed = [sum(a != b for a, b in zip(probe, w[s : s + n], strict=True)) for s in range(len(w) - n + 1)]
                if any(0 < m <= n * (1 - near) + 1e-9 for m in missed):
                    want[k].add(str(i))
    got = op.search(spark.createDataFrame([(k, " ".join(w)) for k, w in docs], "doc_id long, text string"), bench_of(spark, [(i, " ".join(x)) for i, x in items]), near=near)
    assert {r.doc_id: set(r.near_items) for r in got.collect()} == want and any(want.values())


def test_empty_tables(spark):
    bench = bench_of(spark, [(1, SENTENCE)])
    assert op.search(empty(spark), bench).count() == 0
    assert {r.n_hit for r in op.search(odd(spark), bench.limit(0)).collect()} == {0}
