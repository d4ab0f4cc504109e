"""Vectorised word handling over Arrow string batches.

A word is a maximal run of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after A-Z have
been lower-cased.  Every byte of a multi-byte code point is above 0x7F, so the
rule can be applied to UTF-8 bytes without decoding.  Words are named by a
64-bit polynomial hash over randomised byte values, computed for all words of a
piece at once from one prefix sum; operators that need certainty compare the
words themselves afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes worked on at once: bounds the temporary arrays, whatever the texts' lengths.
PIECE = 1 << 19
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)

_rng = np.random.default_rng(20240501)
_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_WORD = np.ones(256, dtype=bool)
IS_WORD[:0x30] = IS_WORD[0x3A:0x61] = IS_WORD[0x7B:0x80] = False
_WORDY = IS_WORD[LOWER]
_LOWER_VALUE = _VALUE[LOWER]


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, dtype=np.uint64)
    out[1:] = base & 0xFFFFFFFFFFFFFFFF
    with np.errstate(over="ignore"):
        return np.cumprod(out, dtype=np.uint64)


_POW: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept for later calls."""
    have = _POW.get(base)
    if have is None or len(have) < n:
        have = _POW[base] = _powers(base, max(n, 1024, 0 if have is None else 2 * len(have)))
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64, copy=True)
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls become empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, offsets


def spans(raw: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of all words in raw; words never cross a position in cuts."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    wordy = _WORDY[raw]
    begin = wordy.copy()
    begin[1:] &= ~wordy[:-1]
    inner = cuts[(cuts > 0) & (cuts < len(raw))]
    begin[inner] = wordy[inner]
    end = wordy.copy()
    end[:-1] &= ~wordy[1:]
    end[inner - 1] = wordy[inner - 1]
    return np.flatnonzero(begin), np.flatnonzero(end) + 1


def hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each lower-cased span."""
    with np.errstate(over="ignore"):
        sums = np.zeros(len(raw) + 1, dtype=np.uint64)
        np.cumsum(_LOWER_VALUE[raw] * powers(_BASE, len(raw)), out=sums[1:])
        return mix((sums[end] - sums[start]) * powers(_INVERSE, len(raw) + 1)[start])


def pieces(raw: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Byte ranges of about PIECE bytes that end at a text's end or outside any word."""
    at, last = int(offsets[0]), int(offsets[-1])
    while at < last:
        to = at + PIECE
        if to >= last:
            yield at, last
            return
        end = int(offsets[np.searchsorted(offsets, to, side="right") - 1])
        if end <= at:  # inside one long text
            end = to
            while end < last and _WORDY[raw[end]] and not offsets[np.searchsorted(offsets, end)] == end:
                end += 1
        yield at, end
        at = end


class Words:
    """All words of a batch of texts: doc (row number), start, end (bytes in raw), hash."""

    def __init__(self, column: pa.Array, *, places: bool = True):
        self.raw, self.offsets = buffers(column)
        self.n = len(column)
        starts, ends, named = [], [], []
        for a, b in pieces(self.raw, self.offsets):
            cuts = self.offsets[np.searchsorted(self.offsets, a, "right") : np.searchsorted(self.offsets, b, "left")] - a
            s, e = spans(self.raw[a:b], cuts)
            named.append(hashes(self.raw[a:b], s, e))
            starts.append(s + a)
            if places:
                ends.append(e + a)
        none = [np.zeros(0, np.int64)]
        self.start = np.concatenate(starts or none)
        self.end = np.concatenate(ends or none)
        self.hash = np.concatenate(named or [np.zeros(0, np.uint64)])
        #: first[i]:first[i + 1] are the words of text i
        self.first = np.searchsorted(self.start, self.offsets, "left")
        self.counts = np.diff(self.first)

    def docs(self) -> np.ndarray:
        return np.repeat(np.arange(self.n), self.counts)

    def word(self, i: int) -> str:
        return LOWER[self.raw[self.start[i] : self.end[i]]].tobytes().decode("utf-8", "replace")


def word_hash(word: str) -> int:
    raw = np.frombuffer(word.encode(), dtype=np.uint8)
    return int(hashes(raw, np.array([0]), np.array([len(raw)]))[0]) if len(raw) else 0


_WINDOW = 0xD1342543DE82EF95 | 1


def windows(named: np.ndarray, first: np.ndarray, size: int, *, short: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all runs of `size` words within each text.

    Returns (hash, text, place of its first word).  With ``short``, a text of
    fewer words, but not none, gives one window over all of them.
    """
    counts = np.diff(first)
    total = len(named)
    with np.errstate(over="ignore"):
        run = np.zeros(total, dtype=np.uint64)
        room = np.maximum(counts - size + 1, 0)
        starts = np.repeat(first[:-1], room) + (np.arange(room.sum()) - np.repeat(np.cumsum(room) - room, room))
        for k in range(size):
            if k == 0:
                run = named[starts] * np.uint64(_WINDOW)
            else:
                run = (run + named[starts + k]) * np.uint64(_WINDOW) ^ (run >> np.uint64(29))
        text = np.repeat(np.arange(len(counts)), room)
        run = mix(run)
        if short and (few := np.flatnonzero((counts > 0) & (counts < size))).size:
            extra = np.array([_run(named[first[i] : first[i + 1]]) for i in few], dtype=np.uint64)
            run, text, starts = np.concatenate([run, extra]), np.concatenate([text, few]), np.concatenate([starts, first[few]])
            order = np.argsort(text, kind="stable")
            run, text, starts = run[order], text[order], starts[order]
    return run, text, starts


def _run(named: np.ndarray) -> np.uint64:
    with np.errstate(over="ignore"):
        run = named[:1] * np.uint64(_WINDOW)
        for h in named[1:]:
            run = (run + h) * np.uint64(_WINDOW) ^ (run >> np.uint64(29))
        return mix(run ^ np.uint64(len(named)))[0]


def sets(run: np.ndarray, text: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of each text, ascending: (values, offsets)."""
    order = np.lexsort((run, text))
    run, text = run[order], text[order]
    keep = np.ones(len(run), dtype=bool)
    keep[1:] = (run[1:] != run[:-1]) | (text[1:] != text[:-1])
    run, text = run[keep], text[keep]
    return run, np.searchsorted(text, np.arange(n + 1))


def sliced(batches: Iterator[pa.RecordBatch], column: int = 1, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `most` bytes of text (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = buffers(batch.column(column))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to
