"""Exact aggregates: one group-by with map-side combination, then a finaliser over the groups.

Sums run on whole-number or fixed-scale decimals and never on floating point.
Averages and ratios are divided natively, by exact steps; those of any scale are
finished over grouped rows with exact integers.  Both come before having, order and take.
Calendar buckets group by the native civil date of the period's start; the
period's UTC bounds follow from that date.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator
from decimal import Decimal
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import civil
from ..plans.catalog import Field
from ..plans.compile import Dimension, Metric, Plan, output_field
from ..plans.values import EXACT, INTEGER_LIMIT, divide
from ..sources.bindings import Binding, column, join_limbs, split_limbs
from . import predicates
from .records import eligible, order_by

_LIMBS = "struct<i:decimal(38,0),f1:decimal(38,0),f2:decimal(38,0)>"


def bucket_key(c: Column, grain: str, calendar: civil.Calendar) -> Column:
    """The first local date of the period that holds an instant.

    The native civil date is moved on where the next period's boundary, the earlier
    of a repeated local time, has already passed.
    """
    start = dt.time(0) if grain == "day" else calendar.fiscal
    seconds = start.hour * 3600 + start.minute * 60 + start.second
    shift = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(seconds))
    zone = F.lit(calendar.timezone)

    def first(day: Column) -> Column:
        if grain == "week":
            return F.date_sub(day, F.pmod(F.weekday(day) - civil.DAYS.index(calendar.week_start), F.lit(7)))
        return F.trunc(day, "MM") if grain == "month" else day

    key = first((F.from_utc_timestamp(c, zone) - shift).cast("date"))
    later = F.add_months(key, 1) if grain == "month" else F.date_add(key, 7 if grain == "week" else 1)
    return F.when(c >= F.to_utc_timestamp(later.cast("timestamp") + shift, zone), later).otherwise(key)


def _fail(code: str, path: str) -> Column:
    return F.raise_error(F.lit(f"{code}@{path}@"))


def _raw(m: Metric) -> dict[str, Column]:
    """Partial results of a metric, by suffix."""
    passes = predicates.build(m.where) if m.where is not None else None
    only = (lambda c: F.when(passes, c)) if passes is not None else (lambda c: c)
    if m.op == "count":
        return {"": F.count(only(F.lit(1)))}
    f = m.field
    c = F.col(column(f.id))
    if m.op == "countDistinct":
        return {"": F.count_distinct(only(c))}
    if m.op in ("min", "max"):
        return {"": (F.min if m.op == "min" else F.max)(only(c))}
    out = {"n": F.count(only(c))}
    amount = c["amount"] if f.kind == "money" else c
    if f.kind == "money":
        out |= {"low": F.min(only(c["currency"])), "high": F.max(only(c["currency"]))}
    if f.kind == "integer":
        out["s"] = F.sum(only(c).cast("decimal(20,0)"))
    elif f.precision:
        out["s"] = F.sum(only(amount).cast(f"decimal(38,{f.scale})"))
    else:
        out |= {k: F.sum(only(amount[k])) for k in ("i", "f1", "f2")}
    return out


def _wide(m: Metric, got: dict[str, Any]) -> Decimal | None:
    """The exact sum, from its partial results."""
    if not got["n"]:
        return None
    if "s" in got:
        return got["s"]
    return join_limbs(got)


def final_type(m: Metric) -> str:
    f = output_field(m)
    if m.op in ("min", "max"):
        kind = m.field
        if kind.kind == "money":
            return f"struct<currency:string,amount:{_amount(kind.precision, kind.scale)}>"
        return _amount(kind.precision, kind.scale) if kind.kind == "decimal" else {"integer": "bigint", "date": "date", "instant": "timestamp", "boolean": "boolean"}.get(kind.kind, "string")
    if m.kind == "integer":
        return "bigint"
    amount = _amount(f.precision, f.scale)
    return f"struct<currency:string,amount:{amount}>" if m.kind == "money" else amount


def _amount(precision: int | None, scale: int | None) -> str:
    return f"decimal(38,{scale})" if precision else _LIMBS


def _native(m: Metric, by_id: dict[str, Metric]) -> bool:
    """Whether the metric needs no finaliser in Python: all but what has any scale, or more digits than a decimal holds."""
    if m.op in ("count", "countDistinct", "min", "max"):
        return True
    if m.op == "ratio":
        return all(_whole(by_id[x]) for x in (m.numerator, m.denominator)) and m.scale is not None and m.scale <= 18
    if m.op == "sum":
        return m.field.kind == "integer" or bool(m.field.precision)
    places = _places(m.field)
    return places is not None and m.scale is not None and places <= m.scale <= 18 and (19 if m.field.kind == "integer" else m.field.precision - places) <= 37 - m.scale


def _whole(m: Metric) -> bool:
    return m.op in ("count", "countDistinct") or (m.op == "sum" and m.field.kind == "integer")


def _places(f: Field) -> int | None:
    """Fraction digits of a sum of the field, up to 18; None if they vary or are more."""
    if f.kind == "integer":
        return 0
    return f.scale if f.precision and f.scale <= 18 else None


def _decimal(c: Column, precision: int = 38, scale: int = 0) -> Column:
    return c.cast(f"decimal({precision},{scale})")


def quotient(total: Column, places: int, n: Column, scale: int) -> Column:
    """total (of `places` fraction digits) over n (whole, not zero, up to 19 digits), to `scale` places, half to even; null where total is.

    `places` <= `scale` <= 18, and the quotient has at most 37 - `scale` whole digits.

    A long division, 18 digits at a time: each step's dividend fits a decimal, and its
    digits come from an exact remainder, as Spark's own division rounds too early.
    """
    base = F.lit(10**18).cast("decimal(19,0)")
    size, divisor = F.abs(total), _decimal(F.abs(n), 19)
    whole = _decimal(F.floor(size)) if places else _decimal(size)
    fraction = _decimal(_decimal(size % _decimal(F.lit(1), 1), places + 1, places) * _decimal(F.lit(10**places), places + 1)) if places else None

    def exact(top: Column, bottom: Column) -> Column:
        return _decimal(top / bottom)

    low = whole % base
    rest = exact(whole - low, base)
    middle = rest % base
    digit = lambda by, c: F.struct(_decimal(F.lit(by), 19).alias("by"), _decimal(c, 19).alias("c"))
    steps = [digit(1, exact(rest - middle, base)), digit(10**18, middle), digit(10**18, low)]
    if places:
        steps.append(digit(10**places, fraction))
    if scale > places:
        steps.append(digit(10 ** (scale - places), F.lit(0)))

    def step(acc: Column, x: Column) -> Column:
        dividend = _decimal(acc["r"] * x["by"] + x["c"])

        def put(t: Column) -> Column:
            r = t % divisor
            return F.struct(_decimal(_decimal(acc["q"] * x["by"]) + exact(t - r, divisor)).alias("q"), _decimal(r, 19).alias("r"))

        return F.get(F.transform(F.array(dividend), put), F.lit(0))

    def finish(acc: Column) -> Column:
        twice = acc["r"] * 2
        up = (twice > divisor) | ((twice == divisor) & (acc["q"] % 2 == 1))
        return _decimal(acc["q"] + F.when(up, 1).otherwise(0))

    got = F.aggregate(F.array(*steps), F.struct(_decimal(F.lit(0)).alias("q"), _decimal(F.lit(0), 19).alias("r")), step, finish)

    def printed(q: Column) -> Column:
        unit = _decimal(F.lit(10**scale), scale + 1)
        part = q % unit
        small = _decimal(part, max(scale, 1)) * F.lit(Decimal(1).scaleb(-scale)).cast(f"decimal({max(scale, 1)},{scale})")
        return _decimal(_decimal(exact(q - part, unit), 37, scale) + small, 38, scale)

    value = F.get(F.transform(F.array(got), printed), F.lit(0))
    return F.when(total.isNotNull(), F.when((total < 0) != (n < 0), -value).otherwise(value))


def _finish_native(m: Metric) -> Column:
    if m.op in ("count", "countDistinct", "min", "max"):
        return F.col(f"r_{m.id}_")
    if m.op == "ratio":
        top, bottom = (F.col(f"{x}").cast("decimal(38,0)") for x in (f"t_{m.id}", f"b_{m.id}"))
        return F.when(bottom != 0, quotient(top, 0, bottom, m.scale)).cast(final_type(m))
    s = F.col(f"r_{m.id}_s")
    if m.op == "avg":
        mean = F.when(F.col(f"r_{m.id}_n") > 0, quotient(s.cast("decimal(38,0)") if m.field.kind == "integer" else s, _places(m.field), F.col(f"r_{m.id}_n"), m.scale))
        if m.kind != "money":
            return mean.cast(final_type(m))
        low, high = F.col(f"r_{m.id}_low"), F.col(f"r_{m.id}_high")
        return F.when(low != high, _fail("MONEY_CURRENCY_MIXED", m.path).cast(final_type(m))).when(low.isNotNull(), F.struct(low.alias("currency"), mean.alias("amount")))
    if m.field.kind == "integer":
        return F.when(F.abs(s) > INTEGER_LIMIT, _fail("NUMERIC_OVERFLOW", m.path).cast("bigint")).otherwise(s.cast("bigint"))
    if m.field.kind == "money":
        low, high = F.col(f"r_{m.id}_low"), F.col(f"r_{m.id}_high")
        return F.when(low != high, _fail("MONEY_CURRENCY_MIXED", m.path).cast(final_type(m))).when(low.isNotNull(), F.struct(low.alias("currency"), s.alias("amount")))
    return s


def _exact(plan: Plan, metrics: list[Metric], carried: list[str]):
    """Finishes averages, ratios and variable sums over grouped rows."""
    by_id = {m.id: m for m in plan.metrics}
    suffixes = {m.id: sorted(_raw_names(m)) for m in plan.metrics if m.op != "ratio"}

    def value(row: dict, m: Metric) -> Decimal | None:
        got = {s: row[f"r_{m.id}_{s}"] for s in suffixes[m.id]}
        if m.op in ("count", "countDistinct", "min", "max"):
            x = got[""]
            return x if x is None or isinstance(x, dict) else Decimal(x)
        if "low" in got and got["low"] != got["high"]:
            raise ValueError(f"MONEY_CURRENCY_MIXED@{m.path}@")
        total = _wide(m, got)
        if total is None or m.op == "sum":
            return total
        return divide(total, Decimal(got["n"]), m.scale)

    def checked(x: Decimal | None, m: Metric) -> Decimal | None:
        if x is not None and m.scale is not None and EXACT.abs(x).scaleb(m.scale, context=EXACT) >= Decimal(10) ** 38:
            raise ValueError(f"NUMERIC_OVERFLOW@{m.path}@")
        return x

    def ratio(row: dict, m: Metric) -> Decimal | None:
        top, bottom = (value(row, by_id[x]) for x in (m.numerator, m.denominator))
        if isinstance(top, dict):
            top = join_limbs(top)
        if isinstance(bottom, dict):
            bottom = join_limbs(bottom)
        return None if top is None or not bottom else divide(Decimal(top), Decimal(bottom), 9)

    def wire(x: Decimal | None, m: Metric, row: dict) -> Any:
        if x is None:
            return None
        amount = dict(zip(("i", "f1", "f2"), split_limbs(x), strict=True)) if m.scale is None else x
        return {"currency": row[f"r_{m.id}_low"], "amount": amount} if m.kind == "money" else amount

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            names = [*carried, *(f"m_{m.id}" for m in metrics)]
            out = [batch.column(batch.schema.get_field_index(c)) for c in carried]
            for m in metrics:
                values = [wire(checked(ratio(r, m) if m.op == "ratio" else value(r, m), m), m, r) for r in rows]
                out.append(pa.array(values, _arrow(m)))
            yield pa.RecordBatch.from_arrays(out, names)

    return run


def _raw_names(m: Metric) -> list[str]:
    if m.op in ("count", "countDistinct", "min", "max"):
        return [""]
    out = ["n", *(("low", "high") if m.field.kind == "money" else ())]
    return out + (["s"] if m.field.kind == "integer" or m.field.precision else ["i", "f1", "f2"])


def _arrow(m: Metric) -> pa.DataType:
    limb = pa.struct([(n, pa.decimal128(38, 0)) for n in ("i", "f1", "f2")])
    amount = limb if m.scale is None else pa.decimal128(38, m.scale)
    return pa.struct([("currency", pa.string()), ("amount", amount)]) if m.kind == "money" else amount


def grouped(spark: SparkSession, plan: Plan, binding: Binding) -> DataFrame:
    """All groups, finished: d_<dimension> (a bucket's is its first date) and m_<metric>; before having, order and take."""
    needed = set().union(*(predicates.fields_of(m.where) | ({m.field.id} if m.field else set()) for m in plan.metrics), {d.field.id for d in plan.dimensions})
    df = eligible(spark, plan, binding, needed)
    dims = [_dimension(d, plan).alias(f"d_{d.id}") for d in plan.dimensions]
    parts = [c.alias(f"r_{m.id}_{s}") for m in plan.metrics if m.op != "ratio" for s, c in _raw(m).items()]
    if plan.cohort:
        parts.append(F.count_distinct(column(plan.dataset.id_field)).alias("cohort"))
    out = df.groupBy(*dims).agg(*parts) if dims else df.agg(*parts)
    if plan.cohort:
        out = out.where(F.col("cohort") >= plan.cohort).drop("cohort")
    keys = [f"d_{d.id}" for d in plan.dimensions]
    by_id = {m.id: m for m in plan.metrics}
    native, exact = ([m for m in plan.metrics if _native(m, by_id) == side] for side in (True, False))
    for m in native:
        if m.op == "ratio":
            out = out.withColumns({f"{side}_{m.id}": F.col(f"r_{x}_" + ("" if by_id[x].op != "sum" else "s")) for side, x in (("t", m.numerator), ("b", m.denominator))})
    out = out.select("*", *(_finish_native(m).alias(f"m_{m.id}") for m in native))
    carried = [*keys, *(f"m_{m.id}" for m in native)]
    if not exact:
        return out.select(*carried)
    raw = [c for c in out.columns if c.startswith("r_")]
    schema = [f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema if f.name in carried] + [f"`m_{m.id}` {final_type(m)}" for m in exact]
    return out.select(*carried, *raw).mapInArrow(_exact(plan, exact, carried), ", ".join(schema))


def _dimension(d: Dimension, plan: Plan) -> Column:
    c = F.col(column(d.field.id))
    return bucket_key(c, d.grain, plan.calendar) if d.grain else c


def build(spark: SparkSession, plan: Plan, binding: Binding, extra: int = 0) -> DataFrame:
    """At most take + extra groups in total order; d_ and m_ columns in declaration order."""
    df = grouped(spark, plan, binding)
    if plan.having is not None:
        df = df.where(predicates.build(plan.having, lambda f: _comparable(f)))
    is_dim = {d.id for d in plan.dimensions}
    df = df.orderBy(*order_by(plan.order, lambda x: f"d_{x}" if x in is_dim else f"m_{x}")).limit(plan.take + extra)
    return df.select(*(f"d_{d.id}" for d in plan.dimensions), *(f"m_{m.id}" for m in plan.metrics))


def _comparable(f: Field) -> Column:
    """A metric's column, typed as the literals it is compared with."""
    return F.col(f"m_{f.id}")


def period_columns(df: DataFrame, plan: Plan, dimension: str) -> DataFrame:
    """A bucket's first date replaced by <id>_start, <id>_end (timestamps) and <id>_label."""
    d = next(x for x in plan.dimensions if x.id == dimension)
    name, calendar, grain = f"d_{dimension}", plan.calendar, d.grain
    rest = [c for c in df.columns if c != name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(batch.schema.get_field_index(name)).to_pylist()
            bounds = [(civil.boundary(k, grain, calendar), civil.boundary(civil.following(k, grain), grain, calendar), civil.label(k, grain)) if k else (None, None, None) for k in keys]
            at = pa.timestamp("us", "UTC")
            own = [pa.array([b[0] for b in bounds], at), pa.array([b[1] for b in bounds], at), pa.array([b[2] for b in bounds], pa.string())]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in rest), *own], [*rest, *(f"{dimension}_{x}" for x in ("start", "end", "label"))])

    schema = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name in rest] + [f"`{dimension}_start` timestamp", f"`{dimension}_end` timestamp", f"`{dimension}_label` string"]
    return df.mapInArrow(run, ", ".join(schema))
