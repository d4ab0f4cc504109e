"""K-d tree sharding: shards of near equal bytes.

Equal texts are a group and go to one shard.  The tree is built over the groups,
weighted by bytes: a node with k leaves is split along its widest metadata
dimension at the weighted quantile floor(k / 2) / k, found by histograms that are
counted in parallel and refined until the cut's bin is light.  The dimensions have
one unit, powers of two: of a text's size, and of how rare a metadata value is, by
bytes (values as rare as each other lie together by their hash).  Ties along a
dimension are parted by the text's hash.  Groups heavier than a fiftieth of a
shard (at most 50 x shards of them) are dealt to the sides largest first, the cut
makes up for them; a group heavier than a shard is cut into portions, as no other
way keeps bytes equal.

Defined results: a null text has size 16 and the empty text's checksum; null
metadata are a value of their own; repeated rows each get a slot; with fewer
groups than shards some shards stay empty; an empty table gives an empty result.
Only the named columns are read.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import scratch

#: Bits of a cut's key: coordinate along the dimension, then the text's hash.
COORDINATE, TIE = 20, 42
#: Low bits of a metadata coordinate: the value's hash.  The others count 64ths of a power of two.
VALUE = 8
BINS = 2048
OVERHEAD = 16


@dataclass
class Node:
    leaves: int
    first: int  # number of its first leaf
    number: int
    heavy: list[tuple[int, int, int]] = field(default_factory=list)  # (weight, group, portion)
    left: Node | None = None
    right: Node | None = None


def _small(df: DataFrame, rows: list[tuple], schema: str) -> DataFrame:
    """A few rows a node, for a broadcast join."""
    return F.broadcast(df.sparkSession.createDataFrame(rows, schema))


def _octaves(x: Column) -> Column:
    """log2 of x >= 1 as a coordinate, its last VALUE bits free."""
    steps = F.least(F.lit((1 << (COORDINATE - VALUE)) - 1), F.floor(F.log2(F.greatest(x, F.lit(1.0))) * 64))
    return F.shiftleft(steps.cast("long"), VALUE)


def _key(dimensions: int) -> Column:
    """The key of the dimension named in the column `dim`."""
    out = F.col("k0")
    for i in range(1, dimensions):
        out = F.when(F.col("dim") == i, F.col(f"k{i}")).otherwise(out)
    return out


def _quantiles(state: DataFrame, dimensions: int, dims: dict[int, int], want: dict[int, float], span: dict[int, tuple[int, int]], fine: float) -> dict[int, int]:
    """For each node the key up to which its groups weigh about `want`: counted in bins, refined where the cut falls."""
    below = dict.fromkeys(dims, 0.0)
    cuts: dict[int, int] = {}
    while open_ := [n for n in dims if n not in cuts]:
        asked = [(n, dims[n], *span[n], max(1, -(-(span[n][1] - span[n][0] + 1) // BINS))) for n in open_]
        inside = state.join(_small(state, asked, "node int, dim int, low long, high long, step long"), "node").withColumn("key", _key(dimensions)).where("key between low and high")
        binned = inside.groupBy("node", F.expr("cast((key - low) div step as int)").alias("bin")).agg(F.sum("bytes").alias("w"), F.min("key").alias("a"), F.max("key").alias("b"))
        rows: dict[int, list] = {}
        for r in binned.collect():  # BINS rows a node at most
            rows.setdefault(r.node, []).append((r.bin, r.w, r.a, r.b))
        for n in open_:
            if not rows.get(n):
                cuts[n] = span[n][0] - 1
                continue
            last = span[n][0] - 1
            for _, w, a, b in sorted(rows[n]):
                if below[n] + w <= want[n]:
                    below[n] += w
                    last = b
                    continue
                if w > fine and a < b:  # look into this bin
                    span[n] = (a, b)
                else:  # the nearer side
                    cuts[n] = b if want[n] - below[n] > w / 2 else max(last, a - 1)
                break
            else:
                cuts[n] = last
    return cuts


def build(light: DataFrame, dimensions: int, shards: int, total: int, heavy: list[tuple[int, int, int]]) -> tuple[Node, DataFrame]:
    """The tree over light groups (g, bytes, k0, k1, ...) and heavy ones (weight, group, portion); also (g, light_shard)."""
    root = Node(shards, 0, 0, heavy)
    state = scratch.keep(light.withColumn("node", F.lit(0)))
    level, number = [root], 1
    shard_of = {0: 0}
    while level := [n for n in level if n.leaves > 1]:
        stats = state.groupBy("node").agg(F.sum("bytes").alias("w"), *(f(f"k{i}").alias(f"{a}{i}") for i in range(dimensions) for f, a in ((F.min, "a"), (F.max, "b"))))
        known = {r.node: r for r in stats.collect()}  # one row a node
        dims, want, span, turns = {}, {}, {}, []
        for n in level:
            row = known.get(n.number)
            weight = (row.w if row else 0) + sum(w for w, _, _ in n.heavy)
            k = n.leaves // 2
            goal = [weight * k / n.leaves, weight * (n.leaves - k) / n.leaves]
            sides: list[list] = [[], []]
            for item in sorted(n.heavy, reverse=True):
                side = 0 if goal[0] / k >= goal[1] / (n.leaves - k) else 1
                sides[side].append(item)
                goal[side] -= item[0]
            n.left, n.right = Node(k, n.first, number, sides[0]), Node(n.leaves - k, n.first + k, number + 1, sides[1])
            number += 2
            shard_of.pop(n.number)
            shard_of |= {n.left.number: n.left.first, n.right.number: n.right.first}
            if row:
                dims[n.number] = max(range(dimensions), key=lambda i, row=row: ((row[f"b{i}"] - row[f"a{i}"]) >> TIE, -i))
                want[n.number] = goal[0]
                span[n.number] = (row[f"a{dims[n.number]}"], row[f"b{dims[n.number]}"])
        cuts = _quantiles(state, dimensions, dims, want, span, total / shards / 500)
        turns = [(n.number, dims[n.number], cuts[n.number], n.left.number, n.right.number) for n in level if n.number in dims] or [(-1, 0, 0, 0, 0)]
        turned = state.join(_small(state, turns, "node int, dim int, cut long, to_left int, to_right int"), "node", "left")
        new = scratch.keep(turned.withColumn("node", F.when(F.col("dim").isNull(), F.col("node")).when(_key(dimensions) <= F.col("cut"), F.col("to_left")).otherwise(F.col("to_right"))).drop("dim", "cut", "to_left", "to_right"))
        scratch.drop(state)
        state = new
        level = [c for n in level for c in (n.left, n.right)]
    return root, state.join(_small(state, list(shard_of.items()), "node int, light_shard int"), "node").select("g", "light_shard")


def _leaves(node: Node) -> list[Node]:
    return [node] if node.left is None else _leaves(node.left) + _leaves(node.right)


def shard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 40, metadata: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """One row per document: id, size, text_crc32, law ('bytes'), shard, slot (gapless in its shard), grown_shard (null)."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = [F.xxhash64(F.col(c).cast("string").isNull(), F.col(c).cast("string")) for c in metadata if c in docs.columns]
    size = (F.octet_length(text) + OVERHEAD).cast("long")
    meta = docs.select(F.col(id_col).alias("id"), size.alias("size"), F.crc32(text.cast("binary")).alias("crc"), F.xxhash64(text).alias("g"), *(c.alias(f"y{i}") for i, c in enumerate(own)))
    meta = scratch.keep(meta.withColumn("row", F.monotonically_increasing_id()))
    dims = len(own) + 1
    whole = meta.groupBy("g").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"), F.min("size").alias("one"), *(F.min(f"y{i}").alias(f"x{i + 1}") for i in range(len(own))))
    tie = F.shiftrightunsigned(F.col("g"), 64 - TIE)
    whole = scratch.keep(whole)
    total, rows = whole.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    placed_at = whole
    for i in range(len(own)):
        value = f"x{i + 1}"
        rare = scratch.small(whole.groupBy(value).agg((F.lit(float(max(total, 1))) / F.sum("bytes")).alias(f"rare{i + 1}")))
        placed_at = placed_at.join(rare, value)
    coordinates = [_octaves(F.col("one")), *(_octaves(F.col(f"rare{i + 1}")).bitwiseOR(F.shiftrightunsigned(F.col(f"x{i + 1}"), 64 - VALUE)) for i in range(len(own)))]
    groups = scratch.keep(placed_at.select("g", "bytes", "n", *(F.shiftleft(x, TIE).bitwiseOR(tie).alias(f"k{i}") for i, x in enumerate(coordinates))))
    scratch.drop(whole)
    leaf = max(1.0, total / shards)

    large = groups.where(F.col("bytes") > leaf / 50).select("g", "bytes", "n").collect()  # 50 x shards groups at most
    heavy, portions = [], []
    for r in large:
        # whole, unless it outweighs a shard: then in portions of a tenth of one, or single rows
        parts = 1 if r.bytes <= leaf else min(r.n, int(-(-r.bytes * 10 // leaf)))
        portions.append((r.g, parts))
        heavy += [(r.bytes // parts, r.g, p) for p in range(parts)]
    light = groups.where(F.col("bytes") <= leaf / 50).drop("n")
    tree, placed = build(light, dims, shards, total, heavy)
    dealt = [(g, p, leaf_.first) for leaf_ in _leaves(tree) for _, g, p in leaf_.heavy] or [(0, -1, 0)]
    parts_df = F.broadcast(spark.createDataFrame(portions or [(0, 0)], "g long, parts int"))  # 50 x shards rows at most
    dealt_df = F.broadcast(spark.createDataFrame(dealt, "g long, portion int, heavy_shard int"))  # 60 x shards rows at most

    # portions of a group by its rows' hash: as equal as chance makes them
    put = meta.select("id", "size", "crc", "g", "row").join(parts_df, "g", "left").withColumn("portion", F.when(F.col("parts") > 0, F.pmod(F.xxhash64("row"), "parts").cast("int")))
    put = put.join(dealt_df, ["g", "portion"], "left")
    small = put.where("heavy_shard is null").join(placed, "g").withColumn("shard", F.col("light_shard"))
    cols = ["id", "size", "crc", "row", "shard"]
    all_ = small.select(cols).unionAll(put.where("heavy_shard is not null").withColumn("shard", F.col("heavy_shard")).select(cols))

    share = max(64, rows // (8 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    salts = int(max(1, -(-rows // (shards * share)) * 2))
    salted = scratch.keep(all_.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(salts)).cast("int")))
    counted = sorted((r.shard, r.salt, r["count"]) for r in salted.groupBy("shard", "salt").count().collect())  # 16 x partitions + 2 x shards rows at most
    before, offsets = {}, []
    for s, salt, n in counted:
        offsets.append((s, salt, before.get(s, 0)))
        before[s] = before.get(s, 0) + n
    base = F.broadcast(spark.createDataFrame(offsets or [(0, 0, 0)], "shard int, salt int, before long"))
    window = Window.partitionBy("shard", "salt").orderBy("id", "row")
    out = salted.join(base, ["shard", "salt"])
    scratch.drop(groups)
    return out.select(
        F.col("id").alias(id_col),
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("before") + F.row_number().over(window) - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
