"""Best-fit packing by linear grouping.

All that a packing depends on is how many pieces there are of each length, so
the plan is made on that histogram (at most `capacity` numbers) and the pieces
are put in their places by length and rank, in parallel:

1. Large lengths, in descending order, are cut into groups of equal cardinality
   and rounded up to their group's largest; few sizes remain.
2. Configurations (multisets of sizes that fit a sequence) are optimised by
   column generation: a simplex basis over the sizes, priced by a knapsack.
3. Actual pieces take the configurations' slots, which leaves their real room.
4. What is left of the large ones and all small ones go in best-fit, longest first.

Pieces of the full capacity are sequences by themselves.

Defined results: null and empty texts are one piece (the end mark alone);
repeated rows are packed each on its own; an empty table gives an empty result.
Only the two named columns are read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import scratch
from . import textvec as tv
from . import tokens

GROUPS = 48
#: Shares of a sequence up to which a length counts as small; the plan with the fewest sequences is taken.
SMALL = (1 / 8, 1 / 4, 2 / 5, 1 / 2)


def _tokenize(path: str, capacity: int, end: int, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.encoder(path)
        for batch in tv.sliced(batches, most=1 << 20):
            which, piece, start, length, crc, kept = [], [], [], [], [], []
            texts = [x or "" for x in batch.column(1).to_pylist()]
            for i, ids in enumerate(encoder.encode(texts)):
                ids = np.append(ids, np.uint32(end)).astype("<u4", copy=False)
                for k, a in enumerate(range(0, len(ids), capacity)):
                    own = ids[a : a + capacity]
                    raw = own.tobytes()
                    which.append(i)
                    piece.append(k)
                    start.append(a)
                    length.append(len(own))
                    crc.append(zlib.crc32(raw))
                    if keep_ids:
                        kept.append(raw)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(which, pa.int32())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), *([pa.array(kept, pa.binary())] if keep_ids else [])],
                ["id", "piece", "start", "length", "ids_crc32", *(["ids"] if keep_ids else [])],
            )

    return run


# -- the plan, on the histogram alone -------------------------------------------------


def grouped(counts: np.ndarray, least: int, groups: int = GROUPS) -> list[tuple[int, int, int]]:
    """(size, first, last): ranks first..last-1 of the large pieces in descending order of length are rounded up to size."""
    lengths = np.arange(len(counts))[::-1]
    large = np.where(lengths >= least, counts[::-1], 0)
    total = int(large.sum())
    ends = np.cumsum(large)
    out = []
    for k in range(groups):
        a, b = total * k // groups, total * (k + 1) // groups
        if b > a:
            out.append((int(lengths[np.searchsorted(ends, a, "right")]), a, b))
    merged: list[tuple[int, int, int]] = []
    for size, a, b in out:
        if merged and merged[-1][0] == size:
            merged[-1] = (size, merged[-1][1], b)
        else:
            merged.append((size, a, b))
    return merged


def _best_configuration(sizes: np.ndarray, value: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack over the sizes."""
    best = np.zeros(capacity + 1)
    pick = np.full(capacity + 1, -1)
    for room in range(int(sizes.min()), capacity + 1):
        fits = sizes <= room
        worth = np.where(fits, best[room - np.where(fits, sizes, 0)] + value, -1.0)
        k = int(worth.argmax())
        if worth[k] > best[room - 1] + 1e-12:
            best[room], pick[room] = worth[k], k
        else:
            best[room] = best[room - 1]
    used, room = np.zeros(len(sizes)), capacity
    while room > 0:
        if pick[room] < 0:
            room -= 1
            continue
        used[pick[room]] += 1
        room -= int(sizes[pick[room]])
    return float(best[capacity]), used


def configurations(sizes: list[int], demand: list[int], capacity: int, rounds: int = 2000) -> list[tuple[np.ndarray, float]]:
    """(pieces of each size, how many sequences): a basic optimum of the linear programme by column generation."""
    s, d = np.array(sizes), np.array(demand, dtype=float)
    basis = np.diag((capacity // s).astype(float))
    x = d / (capacity // s)
    inverse = np.linalg.inv(basis)
    for step in range(rounds):
        value, column = _best_configuration(s, np.ones(len(s)) @ inverse, capacity)
        if value <= 1 + 1e-7:
            break
        way = inverse @ column
        ratio = np.where(way > 1e-9, x / np.where(way > 1e-9, way, 1), np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        basis[:, out] = column
        x = x - ratio[out] * way
        x[out] = ratio[out]
        if step % 50 == 49:
            inverse = np.linalg.inv(basis)
            x = inverse @ d
        else:
            pivot = inverse[out] / way[out]
            inverse = inverse - np.outer(way, pivot)
            inverse[out] = pivot
    return [(basis[:, k].astype(int), float(v)) for k, v in enumerate(np.maximum(x, 0)) if v > 1e-9]


class Plan:
    """Runs of equal sequences: (how many, room, ((length, first rank), ...)); sequence b of a run holds rank first + b."""

    def __init__(self, counts: np.ndarray, capacity: int, groups: int = GROUPS, small: float = 1 / 4):
        self.capacity, self.least = capacity, max(1, int(capacity * small) + 1)
        self.free: dict[int, list[tuple[int, int]]] = {}  # ranges of ranks that no configuration took
        self.used = np.zeros(len(counts), dtype=np.int64)  # ranks given out, of each length
        self.runs: list[tuple[int, int, tuple]] = []
        counts = counts.astype(np.int64).copy()
        full = int(counts[capacity])
        if full:
            self.runs.append((full, 0, ((capacity, 0),)))
            self.used[capacity] = full
        counts[capacity] = 0
        self._large(counts, grouped(counts, self.least, groups))
        self._small(counts)

    def _large(self, counts: np.ndarray, sizes: list[tuple[int, int, int]]) -> None:
        if not sizes:
            return
        lengths = np.arange(len(counts))[::-1]
        ends = np.cumsum(counts[::-1])
        at = np.array([a for _, a, _ in sizes])
        last = np.array([b for _, _, b in sizes])
        for config, times in configurations([s for s, _, _ in sizes], [b - a for _, a, b in sizes], self.capacity):
            times = int(min([times + 1e-9, *(((last - at)[config > 0]) // config[config > 0])]))
            if not times:
                continue
            # each slot takes the next `times` pieces of its group; a run ends wherever a slot's length changes
            slots, cuts = [], {0, times}
            for g in np.flatnonzero(config):
                for _ in range(int(config[g])):
                    slots.append(int(at[g]))
                    a, b = at[g], at[g] + times
                    inner = ends[np.searchsorted(ends, a, "right") : np.searchsorted(ends, b, "left")]
                    cuts.update((inner - a).tolist())
                    at[g] += times
            edges = sorted(c for c in cuts if 0 <= c <= times)
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                held = []
                for first in slots:
                    k = int(np.searchsorted(ends, first + a, "right"))
                    held.append((int(lengths[k]), int(first + a - (ends[k] - counts[lengths[k]]))))
                self.runs.append((b - a, self.capacity - sum(x for x, _ in held), tuple(held)))
        # what a slot took counts as used; the rest of each length is no longer one range of ranks
        for (_, _, b), a in zip(sizes, at.tolist(), strict=True):
            while a < b:
                k = int(np.searchsorted(ends, a, "right"))
                to = min(b, int(ends[k]))
                length = int(lengths[k])
                self.free.setdefault(length, []).append((int(a - (ends[k] - counts[length])), to - a))
                a = to
        counts[self.least :] = 0

    def _small(self, counts: np.ndarray) -> None:
        left = dict(self.free)
        for length in np.flatnonzero(counts).tolist():
            left.setdefault(length, []).append((0, int(counts[length])))
        rooms: dict[int, list[tuple[int, tuple]]] = {}
        done: list[tuple[int, int, tuple]] = []
        for n, room, held in self.runs:
            rooms.setdefault(room, []).append((n, held))
        order = sorted(rooms)
        for length in sorted(left, reverse=True):
            for first, n in left[length]:
                while n:
                    k = bisect_left(order, length)
                    if k == len(order):
                        fit = self.capacity // length
                        new = max(1, n // fit)
                        fit = min(fit, n)
                        held = tuple((length, first + j * new) for j in range(fit))
                        rest = self.capacity - fit * length
                        self._add(rooms, order, rest, new, held)
                        first, n = first + fit * new, n - fit * new
                        continue
                    room = order[k]
                    have, held = rooms[room].pop()
                    if not rooms[room]:
                        del rooms[room], order[k]
                    take = min(have, n)
                    if have > take:
                        self._add(rooms, order, room, have - take, tuple((x, r + take) for x, r in held))
                    self._add(rooms, order, room - length, take, (*held, (length, first)))
                    first, n = first + take, n - take
        for room, runs in rooms.items():
            done += [(n, room, held) for n, held in runs]
        self.runs = done

    @staticmethod
    def _add(rooms: dict, order: list, room: int, n: int, held: tuple) -> None:
        if room not in rooms:
            rooms[room] = []
            insort(order, room)
        rooms[room].append((n, held))

    def places(self) -> dict[str, np.ndarray]:
        """Ranges of ranks of each length: (key, how many, first sequence, offset), sorted; rows grow with the lengths, not with the documents."""
        rows, sequence = [], 0
        for n, _, held in sorted(self.runs, key=lambda r: r[2]):
            offset = 0
            for length, first in held:
                rows.append(((length << 44) + first, sequence, offset))
                offset += length
            sequence += n
        rows.sort()
        table = np.array(rows, dtype=np.int64).reshape(-1, 3)
        return {"key": table[:, 0], "sequence": table[:, 1], "offset": table[:, 2]}

    def sequences(self) -> int:
        return sum(n for n, _, _ in self.runs)


def best_plan(counts: np.ndarray, capacity: int) -> Plan:
    return min((Plan(counts, capacity, small=share) for share in SMALL), key=Plan.sequences)


def _place(table: dict[str, np.ndarray], base: dict[str, np.ndarray], keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            col = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            length, salt, rank = (col[x].to_numpy(zero_copy_only=False).astype(np.int64) for x in ("length", "salt", "rank"))
            key = (length << 44) + base["before"][np.searchsorted(base["key"], (length << 32) + salt)] + rank
            at = np.searchsorted(table["key"], key, "right") - 1
            names = ["id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays(
                [*(col[x] for x in names), pa.array(table["sequence"][at] + key - table["key"][at]), pa.array(table["offset"][at]), *([col["ids"]] if keep_ids else [])],
                [*names, "sequence_id", "offset", *(["ids"] if keep_ids else [])],
            )

    return run


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end: int = 0, path: str | None = None, keep_ids: bool = False) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset (and ids, little-endian, if kept)."""
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    more = ", ids binary" if keep_ids else ""
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    pieces = scratch.keep(texts.mapInArrow(_tokenize(path or tokens.default_path(), capacity, end, keep_ids), f"id {kind}, piece int, start long, length long, ids_crc32 long{more}"))
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in pieces.groupBy("length").count().collect():  # at most `capacity` rows
        counts[length] = n
    table = best_plan(counts, capacity).places()

    # ranks within a length: hot lengths are salted, so that no key holds more than a task's share
    share = max(64, int(counts.sum()) // (8 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    salts = F.broadcast(spark.createDataFrame([(i, int(-(-n // share))) for i, n in enumerate(counts.tolist()) if n] or [(0, 1)], "length long, salts int"))  # at most `capacity` rows
    salted = pieces.join(salts, "length").withColumn("salt", F.pmod(F.xxhash64("id", "piece", "ids_crc32"), F.col("salts")).cast("int"))
    found = sorted((r.length, r.salt, r.n) for r in salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n")).collect())  # lengths + 8 x partitions rows
    before: dict[int, int] = {}
    keys, first = [], []
    for length, salt, n in found:
        keys.append((length << 32) + salt)
        first.append(before.get(length, 0))
        before[length] = first[-1] + n
    base = {"key": np.array(keys, dtype=np.int64), "before": np.array(first, dtype=np.int64)}
    window = Window.partitionBy("length", "salt").orderBy("id", "piece", "ids_crc32")
    ranked = salted.withColumn("rank", F.row_number().over(window) - 1).drop("salts")
    out = ranked.mapInArrow(_place(table, base, keep_ids), f"id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long{more}")
    return out.withColumnRenamed("id", id_col)
