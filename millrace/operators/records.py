"""Ordered records: scope, filters, order by all keys with nulls last, a bounded take."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.compile import Key, Plan
from ..sources.bindings import Binding, column
from . import predicates


def order_by(keys: tuple[Key, ...], name=column) -> list[Column]:
    return [F.col(name(k.by)).desc_nulls_last() if k.descending else F.col(name(k.by)).asc_nulls_last() for k in keys]


def eligible(spark: SparkSession, plan: Plan, binding: Binding, more: set[str] = frozenset(), specs: set[str] = frozenset()) -> DataFrame:
    """Rows within scope that pass the filters, with just the columns needed."""
    names = {plan.dataset.id_field, *(plan.scope or {}), *more, *predicates.fields_of(plan.where)}
    df = predicates.scoped(binding.frame(spark, plan.dataset, names, specs), plan.dataset, plan.scope or {})
    return df.where(predicates.build(plan.where)) if plan.where is not None else df


def released(df: DataFrame, plan: Plan) -> bool:
    """Whether the whole eligible set has the minimum number of records; reads no more of them than that."""
    return df.select(column(plan.dataset.id_field)).distinct().limit(plan.cohort).count() >= plan.cohort


def build(spark: SparkSession, plan: Plan, binding: Binding, extra: int = 0) -> DataFrame:
    """At most take + extra rows in total order, columns by field id."""
    names = {f.id for f in plan.select} | {k.by for k in plan.order}
    df = eligible(spark, plan, binding, names)
    if plan.cohort and not released(df, plan):
        df = df.limit(0)
    return df.orderBy(*order_by(plan.order)).limit(plan.take + extra).select(*(F.col(column(f.id)).alias(f.id) for f in plan.select))
