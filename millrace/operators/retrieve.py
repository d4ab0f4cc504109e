"""Semantic and hybrid retrieval over the eligible set.

Scores are computed natively; rows that rounding could bring among the first k
are ranked again with exact arithmetic.  Nothing outside scope and filters is
ever scored, and fewer eligible rows give fewer results.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors
from ..plans.compile import Plan
from ..plans.errors import refuse
from ..sources.bindings import Binding, column, vector_column
from .records import eligible, released


def _eligible(spark: SparkSession, plan: Plan, binding: Binding, more: set[str] = frozenset()) -> DataFrame:
    df = eligible(spark, plan, binding, more, {plan.spec.id})
    return df.where(F.col(vector_column(plan.spec.id)).isNotNull())


def admit(df: DataFrame, plan: Plan) -> int:
    """How many rows are eligible; refuses above the limit, before any vector is read."""
    limit = plan.exact_limit
    n = df.select(column(plan.dataset.id_field)).count()
    if n > limit:
        raise refuse("EXACT_SCAN_LIMIT_EXCEEDED", "/search/accuracy", details={"limit": limit, "eligibleCount": n})
    return n


def _first(query: list[float], metric: str, k: int) -> Callable:
    """The k nearest of each task's rows (id, vector), in exact order, ties by id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[tuple] = []
        schema = None
        for batch in batches:
            schema = batch.schema
            rows = list(zip(batch.column(0).to_pylist(), map(tuple, batch.column(1).to_pylist()), strict=True))
            exact = {v: vectors.exact(v, query, metric) for v in {v for _, v in rows}}  # copies tie: once a batch
            best = heapq.nsmallest(k, [*best, *((exact[v], i.encode(), v) for i, v in rows)], key=lambda r: r[:2])
        if best:
            yield pa.RecordBatch.from_arrays([pa.array([r[1].decode() for r in best], schema.field(0).type), pa.array([r[2] for r in best], schema.field(1).type)], schema=schema)

    return run


def nearest(df: DataFrame, plan: Plan, query: list[float], k: int) -> list[str]:
    """Ids of the k nearest rows, in exact order, ties by id."""
    key, name = column(plan.dataset.id_field), vector_column(plan.spec.id)
    metric = plan.spec.metric
    if metric == "cosine" and not any(query):
        raise refuse("SCHEMA_INVALID_VALUE", "/search/text", ["Zero vectors have no cosine."])
    scored = df.select(key, name, vectors.score(F.col(name), query, metric).alias("score"))
    scored = scored.withColumn("slack", vectors.slack(F.col("score"), F.col(name), query, metric))
    if metric == "cosine":
        zero = F.forall(name, lambda x: x == 0)
        scored = scored.withColumn("score", F.when(zero, F.raise_error(F.lit("SCHEMA_INVALID_VALUE@/search/using@")).cast("double")).otherwise(F.col("score")))
    best = scored.orderBy(F.col("score").desc(), key).limit(k).agg(F.min(F.col("score") - F.col("slack")).alias("low")).first()
    if best.low is None:
        return []
    # however many tie at the edge, a task returns k rows at most
    near = scored.where(F.col("score") + F.col("slack") >= best.low).select(key, name)
    rows = near.mapInArrow(_first(query, metric, k), near.schema).collect()
    ranked = sorted((vectors.exact(r[name], query, metric), r[key].encode(), r[key]) for r in rows)
    return [r[2] for r in ranked[:k]]


def lexical(df: DataFrame, plan: Plan, needle: str, k: int) -> list[str]:
    """Ids of rows that hold the needle literally: most occurrences first, then shorter texts, then ids."""
    key, text = column(plan.dataset.id_field), F.col(column(plan.lexical.id))
    times = (F.length(text) - F.length(F.replace(text, F.lit(needle), F.lit("")))) / max(1, len(needle))
    found = df.where(text.isNotNull() & text.contains(needle)).select(key, times.alias("times"), F.length(text).alias("size"))
    return [r[key] for r in found.orderBy(F.col("times").desc(), "size", key).limit(k).collect()]


def ids(spark: SparkSession, plan: Plan, binding: Binding, query: list[float]) -> list[str]:
    """Ranked ids of a retrieval; at most `take`."""
    if len(query) != plan.spec.dimension:
        raise refuse("EMBEDDING_UNINDEXED", "/search/using", details={"embeddingSpec": plan.spec.id})
    query = vectors.f32(query)
    df = _eligible(spark, plan, binding, {plan.lexical.id} if plan.lexical else set())
    if plan.cohort and not released(df, plan):
        return []
    if plan.search["kind"] == "semantic":
        if plan.search["accuracy"] == "exact":
            admit(df, plan)
        return nearest(df, plan, query, plan.take)
    depth = min(4 * plan.take, 400)
    return vectors.rrf([nearest(df, plan, query, depth), lexical(df, plan, plan.search["lexical"]["text"], depth)], plan.take)


def build(spark: SparkSession, plan: Plan, binding: Binding, query: list[float]) -> DataFrame:
    """Selected fields by field id, and rank; scope and filters are applied again to the payload."""
    ranked = ids(spark, plan, binding, query)
    names = {f.id for f in plan.select}
    key = column(plan.dataset.id_field)
    ranks = spark.createDataFrame([(i, n) for n, i in enumerate(ranked, 1)], "ranked string, rank int")  # at most `take` rows
    payload = eligible(spark, plan, binding, names).join(F.broadcast(ranks), F.col(key) == F.col("ranked"))
    return payload.orderBy("rank").select(*(F.col(column(f.id)).alias(f.id) for f in plan.select), "rank")
