import random

import pytest

from millrace.llm import jaccard_join as op
from millrace.llm.components import components

from .common import SENTENCE, documents, empty, jaccard, odd, row, shingles, texts


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    linked = [[j for j in range(len(rows)) if j != i and jaccard(sets[i], sets[j]) >= 0.8] for i in range(len(rows))]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, js in enumerate(linked):
        for j in js:
            parent[max(root(i), root(j))] = min(root(i), root(j))
    low = {}
    for i, (name, _) in enumerate(rows):
        if name is not None:
            low[root(i)] = min(low.get(root(i), name), name)
    return sorted(((name, low.get(root(i)), len(linked[i])) for i, (name, _) in enumerate(rows)), key=str)


def check(docs):
    got = sorted(((r.doc_id, r.class_id, r.n_links) for r in op.join(docs).collect()), key=str)
    assert got == brute(texts(docs))


def test_against_brute_force(spark):
    check(documents(spark))


def test_odd_rows(spark):
    check(odd(spark))


def test_shuffle_joins_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(op.scratch, "BROADCAST_ROWS", 0)
    check(documents(spark))
    a = {r.doc_id for r in op.deduplicate(documents(spark)).collect()}
    monkeypatch.undo()
    assert a == {r.doc_id for r in op.deduplicate(documents(spark)).collect()}


def test_recall_of_exact_pairs(spark):
    """All linked pairs of a larger table, by an inverted index of shingles: none of their links may be missed."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = texts(docs)
    sets = [shingles(t) for _, t in rows]
    holders = {}
    for i, s in enumerate(sets):
        for g in s:
            holders.setdefault(g, []).append(i)
    common = {}
    for own in holders.values():
        for k, a in enumerate(own):
            for b in own[k + 1 :]:
                common[a, b] = common.get((a, b), 0) + 1
    links = dict.fromkeys(range(len(rows)), 0)
    for (a, b), n in common.items():
        if n / (len(sets[a]) + len(sets[b]) - n) >= 0.8:
            links[a] += 1
            links[b] += 1
    got = {r.doc_id: r.n_links for r in op.join(docs).collect()}
    assert sum(links.values()) > 100 and got == {rows[i][0]: n for i, n in links.items()}


def test_tiles_against_single_pairs():
    import numpy as np

    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 400, dtype=np.uint64)
    sets = [np.unique(np.concatenate([rng.choice(base, rng.integers(300, 400), replace=False), rng.integers(0, 2**63, rng.integers(0, 60), dtype=np.uint64)])) for _ in range(600)] + [np.array([7], np.uint64)]
    need = op.least_matches(0.8, 1e-7)
    unit = op.Unit(op.signatures(sets), sets, 0.8, need)
    want = {(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets)) if (n := op._overlap(sets[a], sets[b])) / (len(sets[a]) + len(sets[b]) - n) >= 0.8}
    for left, right in ((np.arange(601), None), (np.arange(300), np.arange(300, 601))):
        got = [(min(x, y), max(x, y)) for a, b in unit.pairs(left, right) for x, y in zip(a.tolist(), b.tolist(), strict=True)]
        own = want if right is None else {(a, b) for a, b in want if a < 300 <= b}
        assert len(got) == len(set(got)) and set(got) == own and own
    label = np.arange(601)
    op._unite(label, *(np.array(x) for x in zip(*sorted(want), strict=True)))
    parent = list(range(601))
    for a, b in sorted(want):
        while parent[a] != a:
            a = parent[a]
        while parent[b] != b:
            b = parent[b]
        parent[max(a, b)] = min(a, b)

    def root(x):
        return x if parent[x] == x else root(parent[x])

    assert label.tolist() == [root(x) for x in range(601)]


def test_empty_table(spark):
    assert op.join(empty(spark)).count() == 0


def test_large_group_of_near_copies_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(op, "BLOCK", 16)
    pick = random.Random(3)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for i in range(150):
        own = list(base)
        for _ in range(pick.randrange(0, 5)):
            own[pick.randrange(len(own))] = f"x{pick.randrange(1000)}"
        rows.append(row(i, " ".join(own)))
    check(spark.createDataFrame(rows, odd(spark).schema))


def test_pruning_bound_is_the_posterior():
    need = op.least_matches(0.8, 1e-7)
    assert all(0 <= need[k] < k for k in op.STEPS) and need[72] > need[36] > need[16]
    # at the threshold itself a pair is lost with about the tolerance's probability
    from math import comb

    for k, m in need.items():
        assert sum(comb(k, j) * 0.8**j * 0.2 ** (k - j) for j in range(m)) < 1e-5


def test_deduplicate_keeps_one_of_each_class(spark):
    docs = odd(spark, [row(30, SENTENCE + " indeed"), row(31, "quite another text that has nothing to do with any of them at all")])
    out = op.deduplicate(docs)
    assert out.columns == docs.columns
    kept = sorted((r.doc_id, r.text) for r in out.collect() if r.doc_id is not None)
    assert [i for i, _ in kept if i in (6, 7, 8, 30)] == [] or len([i for i, _ in kept if i in (6, 7, 8, 30)]) == 0
    fox = [r for r in out.collect() if r.text and r.text.lower().startswith("the quick brown")]
    assert len(fox) == 1
    assert {1, 2, 3, 4, 5, 9, 10, 11, 31} <= {i for i, _ in kept}


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    pick = random.Random(seed)
    edges = [(pick.randrange(60), pick.randrange(60)) for _ in range(45)] + [(100 + k, 101 + k) for k in range(40)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    got = {r.node: r.comp for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: root(x) for x in parent}
