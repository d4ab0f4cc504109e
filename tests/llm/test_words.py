import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given
from hypothesis import strategies as st

from millrace.llm import textvec as tv

from .common import words


@given(st.lists(st.one_of(st.none(), st.text(max_size=60)), max_size=6), st.integers(1, 40))
def test_words_are_the_rule(texts, piece):
    was, tv.PIECE = tv.PIECE, piece
    try:
        got = tv.Words(pa.array(texts, pa.string()))
    finally:
        tv.PIECE = was
    want = [words(t.encode("utf-8", "ignore").decode() if t else t) for t in texts]
    assert got.counts.tolist() == [len(w) for w in want]
    flat = [x for w in want for x in w]
    assert [got.word(i) for i in range(len(flat))] == flat
    assert got.hash.tolist() == [tv.word_hash(x) for x in flat]


def test_windows_and_sets():
    w = tv.Words(pa.array(["a b c d e f", "a b", "", "b c d e f a b c d e f"]))
    run, text, start = tv.windows(w.hash, w.first, 5)
    assert np.bincount(text, minlength=4).tolist() == [2, 1, 0, 7]
    values, offsets = tv.sets(run, text, 4)
    own = [set(values[a:b].tolist()) for a, b in zip(offsets[:-1], offsets[1:])]
    assert [len(x) for x in own] == [2, 1, 0, 6]
    assert len(own[0] & own[3]) == 2


def test_slices_keep_all_rows():
    batch = pa.RecordBatch.from_arrays([pa.array(range(50)), pa.array(["x" * k for k in range(50)])], ["i", "t"])
    parts = list(tv.sliced([batch], 1, 100))
    assert sum(p.num_rows for p in parts) == 50 and len(parts) > 5
    assert [x for p in parts for x in p.column(0).to_pylist()] == list(range(50))


@pytest.mark.parametrize("base", [tv._BASE])
def test_powers(base):
    assert tv.powers(base, 5).tolist() == [pow(base, k, 1 << 64) for k in range(5)]
