"""Benchmark decontamination by a distributed positional inverted index.

Every segment of the corpus stores the postings (term, place) of the test
vocabulary's words in its documents, in one scan of the texts; the index is a
table in the shared folder.  Document frequencies are counted from the index
over all documents.  Each test window is then looked up from its rarest terms:
their postings, shifted by the term's place in the window, propose starts, which
are intersected with the shifted postings of the other terms until all words have
matched (exact phrases) or all but a few have (proximity matches).  A window that
may miss m words is looked up from its m + 1 rarest places, one of which is there.

Defined results: null and empty texts have no words and no hits; items without
words are never found; items of fewer words than a window are one window;
repeated items count once by id; items without an id hit words like any other and
count together as one item, null among `items` and left out of their hash, as in the
SQL; repeated documents give repeated rows; an empty
table gives an empty result.  Only the named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import scratch
from . import textvec as tv

#: Most test items and bytes of their texts in a block (one item at least).  A word of an item takes some 130 bytes of the
#: lookup tables that each Python worker holds, so a block takes about 40 MB; more items take more rounds over the index.
ITEMS_A_BLOCK = 20_000
BYTES_A_BLOCK = 2 << 20
#: Words of documents whose postings are worked on at once (one document at least).
WORDS_A_SEGMENT = 250_000


class Tests:
    """A block of test items as windows over a vocabulary."""

    def __init__(self, items: list[tuple[str | None, str]], window: int, vocabulary: np.ndarray):
        names = sorted({i for i, _ in items}, key=lambda i: (i is not None, i))  # null first
        self.names = names
        place = {x: k for k, x in enumerate(names)}
        words = tv.Words(pa.array([t or "" for _, t in items], pa.large_string()), places=False)
        ids = np.searchsorted(vocabulary, words.hash)
        counts = words.counts
        room = np.where(counts > 0, np.maximum(counts - window + 1, 1), 0)
        start = np.repeat(words.first[:-1], room) + np.arange(room.sum()) - np.repeat(np.cumsum(room) - room, room)
        length = np.repeat(np.minimum(counts, window), room)
        owner = np.repeat(np.array([place[i] for i, _ in items], dtype=np.int64), room)
        size = int(length.max(initial=1))
        terms = np.full((len(start), size), -2, dtype=np.int32)
        for k in range(size):
            live = k < length
            terms[live, k] = ids[start[live] + k]
        #: distinct windows, their words (-2 beyond their length), and the items each belongs to
        self.windows, which = np.unique(terms, axis=0, return_inverse=True)
        own = np.unique(which.ravel() * max(1, len(names)) + owner)
        self.item, self.item_from = own % max(1, len(names)), np.searchsorted(own // max(1, len(names)), np.arange(len(self.windows) + 1))

    def order(self, frequency: np.ndarray, near: float) -> None:
        """Fix each window's order of lookup: rarest terms first; pivots, one place more than may be missed, are grouped by their term."""
        self.length = (self.windows >= 0).sum(axis=1)
        rarity = np.where(self.windows >= 0, frequency[np.maximum(self.windows, 0)] if len(frequency) else 0, np.iinfo(np.int64).max)
        by = np.argsort(rarity, axis=1, kind="stable")
        self.places, self.terms = by.astype(np.int16), np.take_along_axis(self.windows, by, axis=1)
        self.allowed = np.minimum(np.floor(self.length * (1 - near) + 1e-9).astype(np.int64), self.length - 1)
        of_rank = [np.flatnonzero(self.allowed >= k) for k in range(int(self.allowed.max(initial=0)) + 1)]
        window, rank = np.concatenate(of_rank), np.repeat(np.arange(len(of_rank)), [len(x) for x in of_rank])
        by = np.argsort(self.terms[window, rank], kind="stable")
        self.by_pivot, self.rank = window[by], rank[by]
        self.pivots, self.pivot_from = np.unique(self.terms[self.by_pivot, self.rank], return_index=True)
        self.pivot_to = np.append(self.pivot_from[1:], len(by))

    def items_of(self, window: int) -> list[int]:
        return self.item[self.item_from[window] : self.item_from[window + 1]].tolist()


def _ids_of(vocabulary: np.ndarray, named: np.ndarray) -> np.ndarray:
    if not len(vocabulary):
        return np.full(len(named), -1, np.int32)
    at = np.searchsorted(vocabulary, named)
    at[at == len(vocabulary)] = 0
    return np.where(vocabulary[at] == named, at, -1).astype(np.int32)


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in tv.sliced(batches, 0):
        yield pa.RecordBatch.from_arrays([pa.array(np.unique(tv.Words(batch.column(0), places=False).hash).view(np.int64))], ["w"])


def _build(vocabulary: np.ndarray):
    """Index rows: one for each document, with the postings of the test vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tv.sliced(batches):
            words = tv.Words(batch.column(1), places=False)
            ids = _ids_of(vocabulary, words.hash)
            hit = np.flatnonzero(ids >= 0)
            terms = ids[hit]
            place = (hit - np.repeat(words.first[:-1], words.counts)[hit]).astype(np.int32) if len(hit) else np.zeros(0, np.int32)
            cuts = np.searchsorted(hit, words.first)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(words.counts.astype(np.int64)),
                    pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(terms, pa.int32())),
                    pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(place, pa.int32())),
                ],
                ["id", "n_words", "terms", "places"],
            )

    return run


def _segments(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The index rows (id, n_words, ...) of a batch in runs of about WORDS_A_SEGMENT words."""
    ends = np.cumsum(batch.column(1).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        done = int(ends[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + WORDS_A_SEGMENT, "right")))
        yield batch.slice(at, to - at)
        at = to


def _frequencies(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, dtype=np.int64)
        for whole in batches:
            for batch in _segments(whole):
                terms = batch.column(2)
                flat = terms.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                doc = np.repeat(np.arange(len(terms)), np.diff(terms.offsets.to_numpy()))
                total += np.bincount(np.unique(doc * size + flat) % size, minlength=size)
        full = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(total[full])], ["term", "n"])

    return run


def _match(tests: Tests):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _segments(whole):
                n_words = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
                first = np.concatenate([[0], np.cumsum(n_words)])
                lists = batch.column(2)
                counts = np.diff(lists.offsets.to_numpy())
                # postings of the segment in a frame where a document's words stand one after another
                dense = np.full(int(first[-1]) + 1, -1, dtype=np.int32)
                where = np.repeat(first[:-1], counts) + batch.column(3).flatten().to_numpy(zero_copy_only=False)
                terms = lists.flatten().to_numpy(zero_copy_only=False)
                dense[where] = terms
                window, start, close_window, close_start = _lookup(tests, dense, where, terms, first)
                n = batch.num_rows
                hit = np.zeros(len(dense) + 1, dtype=np.int64)
                np.add.at(hit, start, 1)
                np.add.at(hit, start + tests.length[window], -1)
                inside = np.concatenate([[0], np.cumsum(np.cumsum(hit[:-1]) > 0)])
                doc = np.searchsorted(first, start, "right") - 1
                items: dict[int, set] = {}
                spans: dict[int, set] = {}
                for d, w, s in zip(doc.tolist(), window.tolist(), start.tolist(), strict=True):
                    items.setdefault(d, set()).update(tests.items_of(w))
                    spans.setdefault(d, set()).add((s - int(first[d]), int(tests.length[w])))
                close: dict[int, set] = {}
                for d, w in zip((np.searchsorted(first, close_start, "right") - 1).tolist(), close_window.tolist(), strict=True):
                    close.setdefault(d, set()).update(tests.items_of(w))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        batch.column(4),
                        pa.array(n_words),
                        pa.array(inside[first[1:]] - inside[first[:-1]]),
                        pa.array([[tests.names[x] for x in sorted(items.get(i, ()))] for i in range(n)], pa.list_(pa.string())),
                        pa.array([[tests.names[x] for x in sorted(close.get(i, ()))] for i in range(n)], pa.list_(pa.string())),
                        pa.array([[{"at": a, "words": w} for a, w in sorted(spans.get(i, ()))] for i in range(n)], pa.list_(pa.struct([("at", pa.int64()), ("words", pa.int64())]))),
                    ],
                    ["id", "row", "n_words", "n_hit", "items", "near_items", "spans"],
                )

    return run


def _lookup(tests: Tests, dense: np.ndarray, where: np.ndarray, terms: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(window, start) of exact matches and of proximity matches."""
    none = np.zeros(0, np.int64)
    if not len(tests.windows) or not len(terms):
        return none, none, none, none
    at = np.searchsorted(tests.pivots, terms)
    at[at == len(tests.pivots)] = 0
    good = tests.pivots[at] == terms
    at, where = at[good], where[good]
    lengths = tests.pivot_to[at] - tests.pivot_from[at]
    if not lengths.sum():
        return none, none, none, none
    room = 2_000_000  # proposals worked on at once
    cuts = np.searchsorted(np.cumsum(lengths), np.arange(room, lengths.sum() + room, room), "left") + 1
    found: list[tuple] = []
    for a, b in zip([0, *cuts[:-1].tolist()], cuts.tolist(), strict=True):
        count = lengths[a:b]
        if not count.sum():
            continue
        run = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        pivot = np.repeat(tests.pivot_from[at[a:b]], count) + run
        window, rank = tests.by_pivot[pivot], tests.rank[pivot]
        seen = np.repeat(where[a:b], count)
        start = seen - tests.places[window, rank]
        doc = np.searchsorted(first, seen, "right") - 1
        fits = (start >= first[doc]) & (start + tests.length[window] <= first[doc + 1])
        window, start, rank = window[fits], start[fits], rank[fits]
        missed = np.zeros(len(window), np.int64)
        for k in range(tests.places.shape[1]):
            live = k < tests.length[window]
            same = dense[np.where(live, start + tests.places[window, k], 0)] == tests.terms[window, k]
            missed += live & ~same
            # a rarer place that is there has proposed the same start
            keep = (missed <= tests.allowed[window]) & ~(same & (k < rank))
            if not keep.all():
                window, start, rank, missed = window[keep], start[keep], rank[keep], missed[keep]
        exact = missed == 0
        found.append((window[exact], start[exact], window[~exact], start[~exact]))
    if not found:
        return none, none, none, none
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))  # type: ignore[return-value]


def search(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", window: int = 13, near: float = 0.85) -> DataFrame:
    """One row per document: id, n_words, n_hit, items (found exactly), near_items (found in at least `near` of a window's words), spans (word place and length of each match)."""
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    tests_df = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("t"))
    items, size = tests_df.agg(F.count(F.lit(1)), F.sum(F.octet_length("t"))).first()
    blocks = max(1, -(-items // ITEMS_A_BLOCK), -(-(size or 0) // BYTES_A_BLOCK))
    # 8 bytes for each distinct word of the benchmark
    vocabulary = np.sort(np.array([r.w for r in tests_df.select("t").mapInArrow(_words, "w long").distinct().collect()], dtype=np.int64).view(np.uint64))
    index = texts.mapInArrow(_build(vocabulary), f"id {kind}, n_words long, terms array<int>, places array<int>")
    index = scratch.keep(index.withColumn("row", F.monotonically_increasing_id()))
    frequency = np.zeros(len(vocabulary), dtype=np.int64)
    for term, n in index.select("id", "n_words", "terms").mapInArrow(_frequencies(max(1, len(vocabulary))), "term int, n long").groupBy("term").agg(F.sum("n")).collect():  # one row a word of the vocabulary
        frequency[term] = n
    found = []
    for block in range(blocks):
        mine = tests_df.where(F.pmod(F.xxhash64(F.coalesce("item", "t")), F.lit(blocks)) == block)
        tests = Tests([(r.item, r.t) for r in mine.collect()], window, vocabulary)  # one block of test items
        tests.order(frequency, near)
        found.append(index.mapInArrow(_match(tests), f"id {kind}, row long, n_words long, n_hit long, items array<string>, near_items array<string>, spans array<struct<at:long,words:long>>"))
    out = found[0] if blocks == 1 else _merged(found)
    return out.drop("row").withColumnRenamed("id", id_col)


def _merged(found: list[DataFrame]) -> DataFrame:
    """The blocks' rows of each document put together by its row in the index."""
    rest = None
    for part in found[1:]:
        some = part.where("size(items) + size(near_items) > 0").select("row", "items", "near_items", "spans")
        rest = some if rest is None else rest.unionAll(some)
    rest = rest.groupBy("row").agg(*(F.flatten(F.collect_list(c)).alias(f"more_{c}") for c in ("items", "near_items", "spans")))
    together = found[0].join(rest, "row", "left")
    for c in ("items", "near_items", "spans"):
        together = together.withColumn(c, F.when(F.col(f"more_{c}").isNull(), F.col(c)).otherwise(F.sort_array(F.array_distinct(F.concat(c, f"more_{c}")))))
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to")),
        lambda acc, x: F.struct(
            (acc["n"] + F.greatest(F.lit(0).cast("long"), x["at"] + x["words"] - F.greatest(acc["to"], x["at"]))).alias("n"),
            F.greatest(acc["to"], x["at"] + x["words"]).alias("to"),
        ),
    )["n"]
    return together.select("id", "row", "n_words", covered.alias("n_hit"), "items", "near_items", "spans")


def contaminated(n_hit: str = "n_hit", n_words: str = "n_words"):
    return (F.col(n_hit) > 0) & (20 * F.col(n_hit) >= F.col(n_words))


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The contract's columns."""
    return found.select(
        id_col,
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.sort_array("items")), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
lens AS (SELECT DISTINCT least(len(w), 13) AS n FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(list_slice(w, s, s + least(len(w), 13) - 1), ' ') AS k FROM b, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS u(s) WHERE len(w) > 0),
dw AS (SELECT doc_id, n, s, array_to_string(list_slice(w, s, s + n - 1), ' ') AS k FROM d, lens, unnest(range(1, greatest(len(w) - n + 2, 1))) AS u(s) WHERE len(w) >= n),
m AS (SELECT dw.doc_id, dw.n, dw.s, bw.item_id FROM dw JOIN bw ON dw.k = bw.k AND dw.n = bw.n),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM m) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""
