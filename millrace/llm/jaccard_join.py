"""Jaccard self-join on word n-grams with Bayesian candidate pruning.

1. One scan gives each text's set key and MinHash signature; equal sets are one
   node from here on.
2. Nodes that share a band of signature values are linked into candidate groups.
3. Groups are cut into blocks of bounded bytes; each pair of blocks is one unit of
   work.  In it signatures are compared a few values at a time, and a pair is
   dropped as soon as the posterior probability that its similarity reaches the
   threshold falls below ``tolerance`` (uniform prior).  The rest is verified on
   the exact sets, whole tiles of pairs at once where most of a tile is left.  A
   unit returns one row per linked text (sum of links, a spanning edge), never its
   pairs.
4. Classes are the components of verified links; a group of one block has them from
   its unit.

Bands of 3 values, 24 of them, miss a pair of similarity 0.8 with probability
4e-8; there is no cap on band sizes, group sizes or partners.  A group whose sets
and signatures have T bytes is sent T / 8 MB times, 8 MB to a block; a unit holds
two blocks.

Defined results: a text of fewer than n words, but not none, has one shingle (all
its words); texts without words (null, empty, punctuation) link to nothing and
are their own class; repeated rows count as copies; an empty table gives an
empty result.  Only the two named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import scratch
from . import textvec as tv
from .components import components

BANDS, ROWS = 24, 3
HASHES = BANDS * ROWS
STEPS = (16, 24, 36, 48, 72)
#: Texts in a block; a text counts as one, or as its bytes over TEXT_BYTES if that is more.
BLOCK = 3_000
TEXT_BYTES = 2_700
#: Side of a square of pairs that are compared at once.
TILE = 256
#: Shingles of a tile that are multiplied at once.
STRIP = 4_096

_rng = np.random.default_rng(72)
_XOR = _rng.integers(0, 2**63, HASHES, dtype=np.uint64)
_MUL = _rng.integers(0, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(column: pa.Array, n: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    words = tv.Words(column, places=False)
    run, text, _ = tv.windows(words.hash, words.first, n)
    cuts = np.searchsorted(text, np.arange(words.n + 1))
    out = []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        s = np.sort(run[a:b])
        out.append(s[np.concatenate([[True], s[1:] != s[:-1]])] if b > a else s)
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """uint32 MinHash values (texts x HASHES); empty sets give the largest value."""
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    out = np.full((len(sets), HASHES), 0xFFFFFFFF, dtype=np.uint32)
    full = np.flatnonzero(sizes)
    if not full.size:
        return out
    values = np.concatenate([sets[i] for i in full])
    at = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
    with np.errstate(over="ignore"):
        for k in range(HASHES):
            out[full, k] = np.minimum.reduceat((values ^ _XOR[k]) * _MUL[k], at) >> np.uint64(32)
    return out


def _keys(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """A 128-bit name for each set."""
    a, b = np.zeros(len(sets), np.uint64), np.zeros(len(sets), np.uint64)
    with np.errstate(over="ignore"):
        for i, s in enumerate(sets):
            a[i] = tv.mix(s).sum(dtype=np.uint64)
            b[i] = tv.mix(s ^ np.uint64(0xA5A5A5A5DEADBEEF)).sum(dtype=np.uint64) + np.uint64(len(s))
    return a.view(np.int64), b.view(np.int64)


def _sketch(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tv.sliced(batches):
            sets = shingle_sets(batch.column(1), n)
            empty = np.array([not len(s) for s in sets])
            sig = signatures(sets)
            k1, k2 = _keys(sets)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(k1, mask=empty), pa.array(k2, mask=empty), pa.array([len(s) for s in sets], pa.int32()), pa.array([x.tobytes() for x in sig], pa.binary())],
                ["id", "k1", "k2", "n_shingles", "sig"],
            )

    return run


def _band(sig: str, k: Column) -> Column:
    """Band k's name: a hash of its values and its number."""
    return F.xxhash64(F.substring(sig, k * (4 * ROWS) + 1, F.lit(4 * ROWS)), k)


def _sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tv.sliced(batches):
            sets = shingle_sets(batch.column(1), n)
            k1, k2 = _keys(sets)
            yield pa.RecordBatch.from_arrays([pa.array(k1), pa.array(k2), pa.array([s.tobytes() for s in sets], pa.binary())], ["s1", "s2", "shingles"])

    return run


def least_matches(threshold: float, tolerance: float) -> dict[int, int]:
    """For each step, the fewest equal values at which the posterior still reaches the tolerance.

    With a uniform prior, P(similarity >= t | m of k equal) = P(Binomial(k + 1, t) <= m).
    """
    out = {}
    for k in STEPS:
        total, m = 0.0, 0
        while m < k:
            total += comb(k + 1, m) * threshold**m * (1 - threshold) ** (k + 1 - m)
            if total >= tolerance:
                break
            m += 1
        out[k] = m
    return out


def _overlap(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


class Unit:
    """Texts that are compared with each other: signatures, and sets in their place in memory."""

    def __init__(self, sig: np.ndarray, sets: list[np.ndarray], threshold: float, need: dict[int, int]):
        self.values = np.ascontiguousarray(sig.T)
        self.sets, self.threshold, self.need = sets, threshold, need
        self.sizes = np.array([len(s) for s in sets], dtype=np.int64)

    def pairs(self, left: np.ndarray, right: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Linked pairs of left x right (left x left once, if right is None), a tile at a time."""
        for at in range(0, len(left), TILE):
            rows = left[at : at + TILE]
            others = left[at:] if right is None else right
            for to in range(0, len(others), TILE):
                columns = others[to : to + TILE]
                a, b = self._candidates(rows, columns, right is None and not to)
                if len(a):
                    yield self._verified(a, b)

    def _candidates(self, rows: np.ndarray, columns: np.ndarray, once: bool) -> tuple[np.ndarray, np.ndarray]:
        """Pairs that may reach the threshold, as far as sizes and signatures tell."""
        here, there = self.sizes[rows][:, None], self.sizes[columns][None, :]
        keep = np.minimum(here, there) >= self.threshold * np.maximum(here, there) - 1e-9
        if once:
            keep &= np.arange(len(rows))[:, None] < np.arange(len(columns))[None, :]
        same = np.zeros(keep.shape, dtype=np.uint8)
        for k in range(STEPS[0]):
            same += self.values[k][rows][:, None] == self.values[k][columns][None, :]
        i, j = np.nonzero(keep & (same >= self.need[STEPS[0]]))
        a, b, same, done = rows[i], columns[j], same[i, j].astype(np.int64), STEPS[0]
        for step in STEPS[1:]:
            for k in range(done, step):
                same += self.values[k][a] == self.values[k][b]
            keep = same >= self.need[step]
            a, b, same, done = a[keep], b[keep], same[keep], step
        return a, b

    def _verified(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those of the pairs whose exact similarity reaches the threshold."""
        rows, i = np.unique(a, return_inverse=True)
        columns, j = np.unique(b, return_inverse=True)
        if len(a) <= 4 * (len(rows) + len(columns)):
            both = np.array([_overlap(self.sets[x], self.sets[y]) for x, y in zip(a.tolist(), b.tolist(), strict=True)], dtype=np.int64)
        else:
            both = _overlaps([self.sets[x] for x in rows.tolist()], [self.sets[x] for x in columns.tolist()])[i, j]
        keep = both / (self.sizes[a] + self.sizes[b] - both) >= self.threshold
        return a[keep], b[keep]


def _overlaps(rows: list[np.ndarray], columns: list[np.ndarray]) -> np.ndarray:
    """Common values of each row with each column: a product of incidence matrices, a strip of values at a time."""
    mine, yours = np.concatenate(rows), np.concatenate(columns)
    common = np.intersect1d(mine, yours)
    out = np.zeros((len(rows), len(columns)), dtype=np.int64)

    def places(values: np.ndarray, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(common, values)
        at[at == len(common)] = 0
        good = common[at] == values
        owner, at = np.repeat(np.arange(len(sets)), [len(s) for s in sets])[good], at[good]
        by = np.argsort(at, kind="stable")
        return owner[by], at[by]

    if not len(common):
        return out
    (row, left), (column, right) = places(mine, rows), places(yours, columns)
    for low in range(0, len(common), STRIP):
        high = min(low + STRIP, len(common))
        parts = []
        for owner, at, n in ((row, left, len(rows)), (column, right, len(columns))):
            a, b = np.searchsorted(at, [low, high])
            part = np.zeros((n, high - low), dtype=np.float32)
            part[owner[a:b], at[a:b] - low] = 1
            parts.append(part)
        out += (parts[0] @ parts[1].T).astype(np.int64)  # counts up to STRIP are exact in float32
    return out


def _unite(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Give all of a component its smallest label, in place; label[i] <= i names i's component."""
    while True:
        low, high = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
        live = low < high
        if not live.any():
            return
        a, b = a[live], b[live]
        up = np.arange(len(label))
        np.minimum.at(up, high[live], low[live])
        while not np.array_equal(higher := up[up], up):
            up = higher
        label[:] = up[label]


def _units(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Runs of rows with equal values in the first `keys` columns, of batches sorted by them."""
    held: list[pa.RecordBatch] = []
    name = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(keys)]
        new = np.zeros(batch.num_rows, dtype=bool)
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        starts = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            this = tuple(c[a] for c in cols)
            if held and this != name:
                yield pa.Table.from_batches(held)
                held = []
            name = this
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _binaries(column: pa.ChunkedArray, kind: type) -> list[np.ndarray]:
    """Views of a binary column's values."""
    out = []
    for chunk in column.chunks:
        offsets = np.frombuffer(chunk.buffers()[1], dtype=np.int32)[chunk.offset : chunk.offset + len(chunk) + 1].tolist()
        raw = chunk.buffers()[2]
        out += [np.frombuffer(raw, dtype=np.uint8, count=b - a, offset=a).view(kind) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    return out


def _verify(threshold: float, tolerance: float):
    need = least_matches(threshold, tolerance)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for unit in _units(batches, 3):
            rows = unit["row"].to_numpy()
            _, once = np.unique(rows, return_index=True)
            rows, blocks, mult = rows[once], unit["block"].to_numpy()[once], unit["mult"].to_numpy()[once].astype(np.int64)
            sig, sets = (_binaries(unit[c], kind) for c, kind in (("sig", np.uint32), ("shingles", np.uint64)))
            i, j = unit["i"][0].as_py(), unit["j"][0].as_py()
            left = np.flatnonzero(blocks == i)
            right = None if i == j else np.flatnonzero(blocks == j)
            label, weight = np.arange(len(rows)), np.zeros(len(rows), dtype=np.int64)
            for a, b in Unit(np.stack([sig[x] for x in once]), [sets[x] for x in once], threshold, need).pairs(left, right):
                np.add.at(weight, a, mult[b])
                np.add.at(weight, b, mult[a])
                _unite(label, a, b)
            linked = np.flatnonzero(weight)
            held.append((rows[linked], rows[label[linked]], weight[linked], np.full(len(linked), unit["blocks"][0].as_py() > 1)))
            if sum(len(x[0]) for x in held) > 10_000:
                yield _rows(held)
                held = []
        if held:
            yield _rows(held)

    return run


def _rows(held: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*held, strict=True)], ["row", "hub", "weight", "more"])


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, threshold: float = 0.8, tolerance: float = 1e-7) -> DataFrame:
    """One row per document: id, class_id (smallest id of its class), n_links (other documents at or above the threshold), n_shingles."""
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    sketch = scratch.keep(texts.mapInArrow(_sketch(n), f"id {kind}, k1 long, k2 long, n_shingles int, sig binary").withColumn("row", F.monotonically_increasing_id()))

    copies = sketch.where("k1 is not null").groupBy("k1", "k2")
    size = F.greatest(F.lit(1.0), (F.col("n_shingles") * 8 + 4 * HASHES) / TEXT_BYTES)
    nodes = copies.agg(F.min("row").alias("row"), F.count(F.lit(1)).alias("mult"), F.min("id").alias("low"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig"))
    nodes = scratch.keep(nodes.withColumn("size", size), sketch.count())
    count = nodes.count()

    bands = nodes.select("row", F.explode(F.array(*(_band("sig", F.lit(k)) for k in range(BANDS)))).alias("band"))
    stars = scratch.keep(bands.groupBy("band").agg(F.min("row").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1").select("band", "hub"), BANDS // 2 * count)
    edges = bands.join(stars, "band").where("row <> hub").select(F.col("row").alias("u"), F.col("hub").alias("v"))
    groups = components(edges, count)

    known = scratch.keep(groups.withColumnRenamed("node", "row").join(nodes, "row").select("comp", "row", "k1", "k2", "mult", "low", "size", "sig"), count)
    # the scan of the texts is narrowed by id; the sets' own keys decide
    wanted = scratch.small(known.select(F.xxhash64("low").alias("want")).distinct(), count)
    found = texts.join(wanted, F.xxhash64("id") == F.col("want"), "left_semi").select(F.lit(0).alias("z"), "t").mapInArrow(_sets(n), "s1 long, s2 long, shingles binary")
    large = scratch.small(known.groupBy("comp").agg(F.ceil(F.sum("size") / BLOCK).cast("int").alias("blocks")).where("blocks > 1"), count // BLOCK)
    some_large = large.limit(1).count() > 0
    full = known.join(found, (F.col("k1") == F.col("s1")) & (F.col("k2") == F.col("s2"))).join(large, "comp", "left")
    full = full.select("comp", "row", "mult", "sig", "shingles", F.coalesce("blocks", F.lit(1)).alias("blocks")).withColumn("block", F.pmod(F.xxhash64("row"), "blocks").cast("int"))
    units = full.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    units = units.select("comp", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "row", "mult", "blocks", "sig", "shingles")
    work = units.repartition("comp", "i", "j").sortWithinPartitions("comp", "i", "j")
    links = scratch.keep(work.mapInArrow(_verify(threshold, tolerance), "row long, hub long, weight long, more boolean"))

    linked = links.groupBy("row").agg(F.sum("weight").alias("weight"), F.min("hub").alias("hub"))
    if some_large:  # the links of a group of several blocks come from several units
        across = components(links.where("more").select(F.col("row").alias("u"), F.col("hub").alias("v")), count)
        linked = linked.join(across, F.col("row") == F.col("node"), "left").select("row", "weight", F.coalesce("comp", "hub").alias("hub"))
    linked = scratch.keep(linked.join(nodes.select("row", "low"), "row"), count)
    lows = scratch.keep(linked.groupBy("hub").agg(F.min("low").alias("class_low")), count)
    told = linked.join(lows, "hub").select("row", "weight", "class_low")
    told = nodes.select("k1", "k2", "row", "mult", "low").join(told, "row", "left")
    told = told.select("k1", "k2", F.coalesce("class_low", "low").alias("class_id"), (F.coalesce("weight", F.lit(0)) + F.col("mult") - 1).alias("n_links"))
    out = sketch.select("id", "k1", "k2", "n_shingles").join(told, ["k1", "k2"], "left")
    out = out.select(F.col("id").alias(id_col), F.coalesce("class_id", "id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "n_shingles")
    scratch.drop(groups, stars, known)
    return out


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, threshold: float = 0.8) -> DataFrame:
    """One document of each class, with all its columns: the one with the smallest id (null ids first), then the smallest hash of its text.

    Of rows that repeat both id and text the one stays that comes first as JSON; of wholly equal rows, one.
    """
    name = F.struct(F.col(f"`{id_col}`").alias("id"), F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).alias("text"))
    own, gone_name, twice = (scratch.fresh(docs, x) for x in ("name", "gone", "twice"))
    named = docs.withColumn(own, name)
    found = scratch.keep(join(named, own, text_col, n, threshold).select(F.col(own).alias("name"), "class_id"))
    gone = scratch.small(found.where(~F.col("name").eqNullSafe(F.col("class_id"))).select(F.col("name").alias(gone_name)).distinct())
    out = named.join(gone, F.col(own).eqNullSafe(F.col(gone_name)), "left_anti")
    repeated = scratch.keep(found.groupBy("name").count().where("count > 1").select(F.col("name").alias(twice)))
    if repeated.limit(1).count():
        again = F.col(own).eqNullSafe(F.col(twice))
        row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
        once = out.join(repeated, again, "left_semi").groupBy(own).agg(F.min_by(row, F.to_json(row)).alias("row")).select("row.*", own)
        out = out.join(repeated, again, "left_anti").unionByName(once)
    return out.drop(own)
