"""Threshold-scaled document sketches, in DataFrame functions only.

A document's sketch holds every five-word shingle hash below a fixed fraction of
the hash range.  Sketches of documents of any lengths can be compared and merged:
shared hashes over all hashes estimate similarity, over one side's hashes
containment.  A document with shingles but none below the threshold keeps its
smallest hash, so that short texts can still be told apart; it is compared by
that hash only where neither side has any below the threshold.

Defined results: a text of one to four words has one shingle; a text without
words (null, empty, punctuation) has the empty sketch, like (1.0) another empty
one and unlike (0.0) all others.  Repeated rows count as documents of their own;
with one row the next document is the row itself; rows with a null id come last.
An empty table gives an empty result.  Only the two named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

N = 5
#: One hash in so many is retained.
SCALE = 4
_LEAST = -(1 << 63)
THRESHOLD = _LEAST + (1 << 64) // SCALE
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Ranges of ids that a column expression tells apart; each is cut evenly into as many as are needed.
RANGES = 64
#: Bytes of texts that go into a range, about; a range is one window, and the driver keeps a row for each.
RANGE_BYTES = 128 << 20
#: An id with more than this share of the rows, and more than HOT_ROWS, is cut into ranges of its own, by its texts' hashes.
HOT_SHARE, HOT_ROWS = 1 / 64, 1_000


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def hashes(own: Column, n: int = N) -> Column:
    """Hashes of all shingles of an array of words."""
    runs = F.transform(F.sequence(F.lit(0), F.size(own) - n), lambda i: F.xxhash64(*(F.get(own, i + k) for k in range(n))))
    return F.when(F.size(own) >= n, runs).when(F.size(own) > 0, F.array(F.xxhash64(F.concat_ws(" ", own)))).otherwise(F.array().cast("array<bigint>"))


def retain(all_: Column, threshold: int = THRESHOLD) -> Column:
    """The sketch: distinct hashes below the threshold, ascending; else the smallest one."""
    kept = F.filter(all_, lambda h: h < threshold)
    return F.when(F.size(kept) > 0, F.array_sort(F.array_distinct(kept))).when(F.size(all_) > 0, F.array(F.array_min(all_))).otherwise(F.array().cast("array<bigint>"))


def _regular(sketch: Column, threshold: int = THRESHOLD) -> Column:
    return (F.size(sketch) > 0) & (F.get(sketch, F.lit(0)) < threshold)


def likeness(a: Column, b: Column, threshold: int = THRESHOLD) -> Column:
    """Estimated Jaccard similarity of two sketches, 0 to 1."""
    both = F.size(F.array_intersect(a, b))
    return (
        F.when(_regular(a, threshold) & _regular(b, threshold), both / (F.size(a) + F.size(b) - both))
        .when(_regular(a, threshold) | _regular(b, threshold), F.lit(0.0))
        .otherwise((a == b).cast("double"))
    )


def containment(a: Column, b: Column, threshold: int = THRESHOLD) -> Column:
    """Estimated share of a's shingles that are in b; null where a has no hash below the threshold."""
    return F.when(_regular(a, threshold), F.size(F.array_intersect(a, b)) / F.size(a))


def merge(a: Column, b: Column, threshold: int = THRESHOLD) -> Column:
    """The sketch of two documents together."""
    return retain(F.concat(a, b), threshold)


def printed(sketch: Column) -> Column:
    return F.concat_ws(",", F.transform(sketch, lambda h: F.lower(F.hex(h))))


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and sketch (array of hashes) of each whole text."""
    return docs.select(id_col, words(F.col(text_col)).alias("words")).select(id_col, hashes(F.col("words")).alias("hashes")).select(id_col, retain(F.col("hashes")).alias("sketch"))


def _ranges(docs: DataFrame, parts: int) -> Column:
    """Number of an id's range: quantiles of the ids, each cut evenly; equal ids share a range, larger ids have larger numbers."""
    coarse = min(RANGES, parts)
    shares = [k / coarse for k in range(coarse + 1)]
    known = docs.select(F.percentile_approx("id", F.array(*map(F.lit, shares)), F.lit(10_000)).alias("q"), F.min("id").alias("a"), F.max("id").alias("b")).first()
    if known.q is None:
        return F.lit(-1)
    edges = sorted({known.a, *known.q, known.b})
    fine = max(1, -(-parts // coarse))

    def cut(low: int, high: int) -> Column:
        if high - low <= 1:
            a, b = edges[low], edges[min(high, len(edges) - 1)]
            step = max(1, -(-(b - a + 1) // fine))
            return F.lit(low * fine) + F.least(F.lit(fine - 1), F.expr(f"cast((`id` - {a}L) div {step}L as int)"))
        middle = (low + high) // 2
        return F.when(F.col("id") < edges[middle], cut(low, middle)).otherwise(cut(middle, high))

    return F.coalesce(cut(0, len(edges)), F.lit(-1))


#: Range numbers leave room for this many ranges of hot ids within one.
_FINEST = 1 << 32


def _within(docs: DataFrame, rows: int, parts: int) -> Column:
    """Number within a range, in the order of descending ids: more than one only where the range holds a hot id."""
    key = F.coalesce("id", F.lit(_LEAST))
    hot = docs.groupBy(key.alias("id")).count().where(F.col("count") > max(HOT_ROWS, HOT_SHARE * rows)).collect()  # 64 ids at most
    out = F.lit(0).cast("long")
    for r in sorted(hot, reverse=True):
        slice_ = 1 + F.floor((F.xxhash64("text") / 2.0**64 + 0.5) * parts).cast("long")
        out = out + F.when(key == r.id, slice_).when(key < r.id, F.lit(parts + 2).cast("long")).otherwise(F.lit(0).cast("long"))
    return out


def _with_next(docs: DataFrame) -> DataFrame:
    """Each document with the next one's text and sketch, by descending id; the last one's next is the first.

    One shuffle of the texts, by ranges of ids; each range also gets a copy of the document that follows its last.
    """
    spark = docs.sparkSession
    rows, size = docs.agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
    parts = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(size or 0) // RANGE_BYTES))
    ranged = docs.withColumn("tie", F.xxhash64("text")).withColumn("range", _ranges(docs, parts).cast("long") * _FINEST - _within(docs, rows, parts))
    heads = ranged.groupBy("range").agg(F.max(F.struct(F.coalesce("id", F.lit(_LEAST)).alias("id"), (-F.col("tie")).alias("tie"))).alias("head")).select("range", "head.*")
    follows = sorted(((r.range, r.id, -r.tie) for r in heads.collect()), reverse=True)  # one row a range
    if not follows:
        return docs.select("id", "text", F.col("text").alias("next"), F.array().cast("array<bigint>").alias("sketch"), F.array().cast("array<bigint>").alias("next_sketch"))
    copies = [(own[0], after[1], after[2]) for own, after in zip(follows, follows[1:] + follows[:1], strict=True)]
    wanted = F.broadcast(spark.createDataFrame(copies, "to long, of_id long, of_tie long"))  # one row a range
    same = (F.coalesce(F.col("id"), F.lit(_LEAST)) == F.col("of_id")) & (F.xxhash64("text") == F.col("of_tie"))
    copied = docs.join(wanted, same).dropDuplicates(["to"]).select("id", "text", F.col("to").alias("range"), F.lit(True).alias("copy"))
    both = ranged.select("id", "text", "range", F.lit(False).alias("copy")).unionByName(copied)
    sketched = both.withColumn("words", words(F.col("text"))).withColumn("hashes", hashes(F.col("words"))).withColumn("sketch", retain(F.col("hashes"))).select("id", "text", "range", "copy", "sketch")
    down = Window.partitionBy("range").orderBy("copy", F.col("id").desc_nulls_last(), F.xxhash64("text"))
    return sketched.withColumn("next", F.lead("text").over(down)).withColumn("next_sketch", F.lead("sketch").over(down)).where(~F.col("copy")).select("id", "text", "sketch", "next", "next_sketch")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text, and their likeness to each other and to the next document's."""
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    size = F.char_length("text")
    cut = F.floor(size / 3).cast("int")
    edited = _with_next(own).select("id", size.cast("long").alias("n_chars"), F.concat(F.substring("text", F.lit(1), size - cut), F.substring("next", F.lit(1), cut)).alias("edited"), "sketch", "next_sketch")
    worded = edited.withColumn("words", words(F.col("edited"))).withColumn("hashes", hashes(F.col("words"))).withColumn("edited_sketch", retain(F.col("hashes")))
    kind = docs.schema[id_col].dataType
    return worded.select(
        F.col("id").cast(kind).alias(id_col),
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        printed(F.col("sketch")).alias("fingerprint"),
        printed(F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )
