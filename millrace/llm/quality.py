"""Quality classifier: histogram gradient-boosted trees over document statistics.

One scan turns every whole text into a row of statistics.  Trees are fitted on
the driver on at most about ``fit_rows`` labelled rows of statistics (numbers
only), chosen by a hash; the fitted trees are flattened into arrays, and all
rows go down all trees at once in numpy.

Defined results: null and empty texts have zero statistics and a score like any
other; a document with several labels teaches each; null labels teach nothing;
without any label of both kinds the score is the share of label 1 (0.5 if there
are none); repeated rows give equal rows; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import scratch
from . import textvec as tv

_CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "digit": b"0123456789",
    "space": b" \t\r\f\v",
    "line": b"\n",
    "stop": b".?;:",
    "shout": b"!",
    "comma": b",",
    "symbol": b"#$%&*@^~_=+<>{}[]\\/`",
    "pipe": b"|",
    "quote": b"\"'()-",
    "other": bytes(range(128, 256)),
}
STATISTICS = (
    "log_bytes", "log_words", *(f"{c}_share" for c in _CLASSES), "word_bytes", "long_words", "short_words",
    "distinct_words", "top_word", "distinct_pairs", "distinct_fives", "distinct_lines", "words_a_line", "words_a_stop",
)


def _texts(column: pa.Array) -> np.ndarray:
    """texts x STATISTICS."""
    words = tv.Words(column)
    n = words.n
    size = np.maximum(np.diff(words.offsets), 1).astype(float)
    raw = words.raw[words.offsets[0] : words.offsets[-1]]
    at = words.offsets - words.offsets[0]
    counts = {}
    for name, members in _CLASSES.items():
        own = np.zeros(256, dtype=bool)
        own[np.frombuffer(members, dtype=np.uint8)] = True
        counts[name] = np.diff(np.concatenate([[0], np.cumsum(own[raw], dtype=np.int64)])[at]).astype(float)
    some = np.maximum(words.counts, 1).astype(float)
    length = words.end - words.start
    per_text = lambda x: np.diff(np.concatenate([[0], np.cumsum(x, dtype=np.int64)])[words.first])
    distinct, top, pairs, fives, lines = (np.ones(n) for _ in range(5))
    two, text2, _ = tv.windows(words.hash, words.first, 2)
    cut2 = np.searchsorted(text2, np.arange(n + 1))
    five, text5, _ = tv.windows(words.hash, words.first, 5)
    cut5 = np.searchsorted(text5, np.arange(n + 1))
    for i in range(n):
        a, b = words.first[i], words.first[i + 1]
        if b <= a:
            continue
        h = np.sort(words.hash[a:b])
        edge = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1], [True]]))
        distinct[i], top[i] = (len(edge) - 1) / (b - a), np.diff(edge).max() / (b - a)
        for out, run, cut in ((pairs, two, cut2), (fives, five, cut5)):
            s = np.sort(run[cut[i] : cut[i + 1]])
            out[i] = (1 + np.count_nonzero(s[1:] != s[:-1])) / max(1, len(s))
        own = words.raw[words.offsets[i] : words.offsets[i + 1]].tobytes().split(b"\n")
        lines[i] = len(set(own)) / len(own)
    columns = [
        np.log1p(np.diff(words.offsets)), np.log1p(words.counts), *(counts[c] / size for c in _CLASSES), per_text(length) / some, per_text(length > 12) / some, per_text(length <= 2) / some,
        distinct, top, pairs, fives, lines, words.counts / (counts["line"] + 1), words.counts / (counts["stop"] + counts["shout"] + 1),
    ]
    return np.stack(columns, axis=1)


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in tv.sliced(batches, most=2 << 20):
        x = _texts(batch.column(1))
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.ascontiguousarray(x[:, k])) for k in range(x.shape[1]))], ["id", *STATISTICS])


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and the statistics of each whole text."""
    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInArrow(_measure, f"id {kind}, " + ", ".join(f"{s} double" for s in STATISTICS))
    return out.withColumnRenamed("id", id_col)


@dataclass
class Trees:
    """Perfect binary trees as arrays: trees x inner nodes, trees x leaves."""

    start: float
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        rows = np.arange(len(x))
        inner = self.feature.shape[1]
        for tree in range(len(self.feature)):
            node = np.zeros(len(x), dtype=np.int64)
            while inner and node[0] < inner:
                node = 2 * node + 1 + (x[rows, self.feature[tree, node]] > self.threshold[tree, node])
            total += self.value[tree, node - inner]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 120, depth: int = 4, rate: float = 0.1, bins: int = 48, least: int = 15, ridge: float = 1.0) -> Trees:
    """Boosting on the logistic loss; splits are sought in histograms of `bins` quantile bins."""
    inner = 2**depth - 1
    share = float(y.mean()) if len(y) else 0.5
    start = float(np.log((share + 1e-3) / (1 - share + 1e-3)))
    if len(y) < 2 * least or share in (0.0, 1.0):
        return Trees(start, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)))
    count, width = x.shape
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1])) for k in range(width)]
    binned = np.stack([np.searchsorted(e, x[:, k], "left") for k, e in enumerate(edges)], axis=1)
    total = np.full(count, start)
    feature, threshold, value = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    offset = np.arange(width) * bins
    for t in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = p - y, p * (1 - p)
        node = np.zeros(count, dtype=np.int64)
        for level in range(depth):
            first, wide = 2**level - 1, 2**level
            cell = ((node - first)[:, None] * (width * bins) + offset + binned).ravel()
            shape = (wide, width, bins)
            sums = [np.bincount(cell, np.repeat(w, width), wide * width * bins).reshape(shape).cumsum(axis=2) for w in (g, h, np.ones(count))]
            (gl, hl, nl), (gt, ht, nt) = sums, (s[:, :, -1:] for s in sums)
            gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
            gain = np.where((nl >= least) & (nt - nl >= least), gain, -1.0).reshape(wide, -1)
            best = gain.argmax(axis=1)
            for k in range(wide):
                f, b = divmod(int(best[k]), bins)
                if gain[k, best[k]] > 1e-6 and b < len(edges[f]):
                    feature[t, first + k], threshold[t, first + k] = f, edges[f][b]
            node = 2 * node + 1 + (x[np.arange(count), feature[t, node]] > threshold[t, node])
        leaf = node - inner
        value[t] = -rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + ridge)
        total += value[t, leaf]
    return Trees(start, feature, threshold, value)


def _score(model: Trees):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([batch.column(1 + k).to_numpy(zero_copy_only=False) for k in range(len(STATISTICS))], axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x))], ["key", "score"])

    return run


def train(measured: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", fit_rows: int = 20_000) -> Trees:
    """Fit on at most about fit_rows of the labelled rows."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("labelled"), F.col(label_col).cast("double").alias("label"))
    rows = measured.join(known, F.col(id_col) == F.col("labelled")).select("labelled", "label", *STATISTICS)
    total = known.count()
    chosen = rows.where(F.shiftrightunsigned(F.xxhash64(F.col("labelled").cast("string")), 11) / F.lit(float(1 << 53)) < min(1.0, fit_rows / max(1, total)))
    table = chosen.orderBy("labelled", *STATISTICS).toArrow()  # fit_rows rows of numbers
    x = np.stack([table[s].to_numpy() for s in STATISTICS], axis=1) if table.num_rows else np.zeros((0, len(STATISTICS)))
    return fit(x, table["label"].to_numpy().astype(float))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = 0.7) -> DataFrame:
    """One row per document: id, score, predicted.  `labels` should hold the labels to learn from only."""
    measured = scratch.keep(measure(docs, id_col, text_col))
    model = train(measured, labels, id_col, label_col)
    kind = docs.schema[id_col].dataType.simpleString()
    out = measured.mapInArrow(_score(model), f"key {kind}, score double")
    return out.select(F.col("key").alias(id_col), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
