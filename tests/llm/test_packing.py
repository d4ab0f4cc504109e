import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import packing as op
from millrace.llm import tokens

from .common import documents, empty, odd, row, texts


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.default_path())


def check(docs, capacity=2048):
    own = library()
    got = op.pack(docs, capacity=capacity, keep_ids=True).collect()
    want = []
    for name, text in texts(docs):
        ids = np.array([*own.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        want += [(name, k, a, ids[a : a + capacity].tobytes()) for k, a in enumerate(range(0, len(ids), capacity))]
    assert sorted(((r.doc_id, r.piece, r.start, bytes(r.ids)) for r in got), key=str) == sorted(want, key=str)
    sequences = {}
    for r in got:
        assert r.length == len(r.ids) // 4 and r.ids_crc32 == zlib.crc32(r.ids)
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity
    return len(sequences), -(-sum(r.length for r in got) // capacity)


def test_own_documents(spark):
    used, least = check(documents(spark))
    assert used <= least * 1.02 + 1


def test_odd_rows(spark):
    check(odd(spark, [row(20, "It's 1 don’t x²"), row(21, "a" * 5000), row(22, "<|endoftext|> y")]))
    check(odd(spark), 16)


def test_empty_table(spark):
    assert op.pack(empty(spark)).count() == 0


@settings(deadline=None, max_examples=25)
@given(st.lists(st.integers(1, 64), min_size=0, max_size=300))
def test_plans_place_everything_once(lengths):
    counts = np.bincount(np.array(lengths, dtype=np.int64), minlength=65)
    plan = op.best_plan(counts, 64)
    seen = [np.zeros(n, dtype=int) for n in counts]
    for n, room, held in plan.runs:
        assert sum(x for x, _ in held) + room == 64 and room >= 0 and n > 0
        for x, first in held:
            seen[x][first : first + n] += 1
    assert all((s == 1).all() for s in seen)
    # never worse than first-fit decreasing's guarantee
    assert plan.sequences() <= -(-sum(lengths) // 64) * 11 / 9 + 2


def test_configurations_solve_the_programme():
    # 3 x 20 + 1 x 4 and 2 x 32: the optimum mixes sizes
    found = op.configurations([32, 20, 4], [10, 30, 10], 64)
    assert abs(sum(x for _, x in found) - 15) < 1e-6
    for config, _ in found:
        assert config @ np.array([32, 20, 4]) <= 64


@pytest.mark.parametrize("segment", [50, 1 << 18])
def test_cached_encoding_is_the_library(spark, monkeypatch, segment):
    monkeypatch.setattr(tokens, "SEGMENT", segment)
    monkeypatch.setattr(tokens, "CACHED", 500)
    encoder, own = tokens.Encoder(tokens.default_path()), library()
    some = [t for _, t in texts(documents(spark))[:60]] + ["It's", "", " ", "ÀÉ ñ ß", "x²", "İstanbul", "a\x1cb", "'s 't 're", "<|startoftext|>", "x" * 400 + "'s"]
    assert [x.tolist() for x in encoder.encode(some)] == [own.encode(t, add_special_tokens=False).ids for t in some]
