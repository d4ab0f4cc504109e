"""Bindings: how a dataset's fields are read from a DataFrame.

Physical names come from here alone; nothing a caller writes becomes a column
name or SQL.  Kinds map to Spark types as follows: id, text, enum: string;
integer: bigint; fixed decimal: decimal(p,s); variable decimal: a struct of three
whole-number limbs (value = i + f1 / 10**19 + f2 / 10**38), which compares and
sums exactly; money: a struct with the currency first; date; instant: timestamp;
boolean; embedding: array<float>.
"""

from __future__ import annotations

import datetime as dt
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from decimal import Decimal
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.catalog import Dataset, Field
from ..plans.values import EXACT

LIMB = "decimal(38,0)"


@dataclass
class Binding:
    """load: a DataFrame with a column for each entry of columns, before scope and filters."""

    load: Callable[[SparkSession], DataFrame]
    columns: dict[str, str | Column] = field(default_factory=dict)  # field id -> expression; default: the local name
    embeddings: dict[str, str | Column] = field(default_factory=dict)  # spec id -> array column
    version: str = "binding-1"
    snapshot: Callable[[], str | None] = lambda: None
    deleted: str | None = None  # boolean column of soft-deleted rows

    def frame(self, spark: SparkSession, dataset: Dataset, names: set[str], specs: set[str] = frozenset()) -> DataFrame:
        """Typed columns c.<field> (and e.<spec>) for just what is needed: the scan reads no more."""
        df = self.load(spark)
        if self.deleted:
            df = df.where(~F.col(self.deleted))
        out = [typed(self._column(self.columns.get(f.id, f"`{f.local}`")), f).alias(column(f.id)) for f in dataset.fields.values() if f.id in names]
        out += [self._column(self.embeddings.get(s, f"`embedding:{s}`")).cast("array<float>").alias(vector_column(s)) for s in sorted(specs)]
        return df.select(*out)

    def indexed(self, spark: SparkSession, spec: str) -> bool:
        return spec in self.embeddings or f"embedding:{spec}" in self.load(spark).columns

    def faults(self, spark: SparkSession, dataset: Dataset) -> DataFrame:
        """Where the source breaks the catalog: (field, fault, rows) for each fault that occurs.

        One pass for nulls, types, codes and currencies, one over the texts that may not
        be in normal form, and one shuffle of the ids for repeated ones.
        """
        df = self.load(spark)
        if self.deleted:
            df = df.where(~F.col(self.deleted))
        raw = {f.id: self._column(self.columns.get(f.id, f"`{f.local}`")) for f in dataset.fields.values()}
        broken = [(f.id, name, test) for f in dataset.fields.values() for name, test in _tests(raw[f.id], f).items()]
        counted = df.agg(*(F.count_if(test).alias(f"n{i}") for i, (_, _, test) in enumerate(broken)))
        listed = F.array(*(F.struct(F.lit(at).alias("field"), F.lit(name).alias("fault"), F.col(f"n{i}").alias("rows")) for i, (at, name, _) in enumerate(broken)))
        out = counted.select(F.inline(listed))
        written = [f.id for f in dataset.fields.values() if f.kind in ("id", "text", "enum")]
        odd = df.select(*(F.when(raw[n].rlike(_MAY_CHANGE), raw[n]).alias(f"t{i}") for i, n in enumerate(written))).where(F.coalesce(*(F.col(f"t{i}") for i in range(len(written)))).isNotNull())
        out = out.unionAll(odd.mapInArrow(_unnormalised(written), "field string, fault string, rows long").groupBy("field", "fault").agg(F.sum("rows").alias("rows")))
        again = df.select(raw[dataset.id_field].alias("id")).where("id is not null").groupBy("id").count().where("count > 1")
        out = out.unionAll(again.agg(F.sum("count").alias("rows")).select(F.lit(dataset.id_field), F.lit("repeated"), "rows"))
        return out.where("rows > 0")

    @staticmethod
    def _column(x: str | Column) -> Column:
        return F.expr(x) if isinstance(x, str) else x


#: Texts without these are in normal form C, whatever else they hold.
_MAY_CHANGE = r"[^\x{0}-\x{2FF}]"


def _tests(raw: Column, f: Field) -> dict[str, Column]:
    """Faults of one field's values by name; none of them is true of a null but `null`."""
    out = {} if f.nullable else {"null": raw.isNull()}
    plain = {"integer": "bigint", "boolean": "boolean", "date": "date", "instant": "timestamp"}.get(f.kind)
    amount = raw["amount"] if f.kind == "money" else raw
    if plain:
        out["type"] = raw.isNotNull() & raw.try_cast(plain).isNull()
    elif f.kind in ("decimal", "money") and f.precision:
        kept = amount.try_cast(f"decimal({f.precision},{f.scale})")
        wide = amount.try_cast(f"decimal(38,{min(38, f.scale + 9)})")
        out["type"] = amount.isNotNull() & (kept.isNull() | F.coalesce(wide != kept, F.lit(False)))
    elif f.kind in ("decimal", "money"):
        out["type"] = amount.isNotNull() & ~amount.cast("string").rlike(r"^[+-]?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?$")
    if f.kind == "money":
        currency = raw["currency"]
        out["currency"] = raw.isNotNull() & (currency.isNull() | ~(currency.isin(*f.currencies) if f.currencies else currency.rlike("^[A-Z]{3}$")))
    if f.kind == "enum":
        out["code"] = raw.isNotNull() & ~raw.isin(*f.codes)
    return out


def _unnormalised(names: list[str]) -> Callable:
    """Counts of texts that aren't in normal form C, by field."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = dict.fromkeys(names, 0)
        for batch in batches:
            for name, texts in zip(names, batch.columns, strict=True):
                found[name] += sum(t.is_valid and not unicodedata.is_normalized("NFC", t.as_py()) for t in texts)
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(["normal form"] * len(names)), pa.array(list(found.values()), pa.int64())], ["field", "fault", "rows"])

    return run


def column(name: str) -> str:
    return "c_" + name.replace(".", "__")


def vector_column(spec: str) -> str:
    return "e_" + spec.replace("@", "__")


def limbs(text: Column) -> Column:
    """Canonical decimal text as limbs of one sign."""
    sign = F.when(text.startswith("-"), F.lit(-1)).otherwise(F.lit(1)).cast("decimal(1,0)")
    body = F.regexp_replace(text, "^[+-]", "")
    places = F.rpad(F.when(body.contains("."), F.substring_index(body, ".", -1)).otherwise(F.lit("")), 38, "0")
    parts = (F.substring_index(body, ".", 1), F.substring(places, 1, 19), F.substring(places, 20, 19))
    # a limb of up to 37 digits stays exact under the product with the sign
    return F.when(text.isNotNull(), F.struct(*((p.cast("decimal(37,0)") * sign).cast(LIMB).alias(n) for p, n in zip(parts, ("i", "f1", "f2"), strict=True))))


def typed(c: Column, f: Field) -> Column:
    if f.kind == "integer":
        return c.cast("bigint")
    if f.kind == "decimal":
        return c.cast(f"decimal({f.precision},{f.scale})") if f.precision else limbs(c.cast("string"))
    if f.kind == "money":
        amount = c["amount"].cast(f"decimal({f.precision},{f.scale})") if f.precision else limbs(c["amount"].cast("string"))
        return F.when(c.isNotNull(), F.struct(c["currency"].cast("string").alias("currency"), amount.alias("amount")))
    return c.cast({"boolean": "boolean", "date": "date", "instant": "timestamp", "null": "void"}.get(f.kind, "string"))


def split_limbs(value: Decimal) -> tuple[Decimal, Decimal, Decimal]:
    sign = -1 if value < 0 else 1
    whole = EXACT.abs(value)
    i = int(whole)
    rest = int(EXACT.multiply(EXACT.subtract(whole, Decimal(i)), Decimal(10) ** 38))
    return Decimal(sign * i), Decimal(sign * (rest // 10**19)), Decimal(sign * (rest % 10**19))


def join_limbs(x: Any) -> Decimal:
    out = EXACT.add(Decimal(x["i"]), EXACT.multiply(Decimal(x["f1"]), Decimal(1).scaleb(-19)))
    return EXACT.add(out, EXACT.multiply(Decimal(x["f2"]), Decimal(1).scaleb(-38)))


def lit(value: Any, f: Field) -> Column:
    """A typed literal for comparison with a field's column."""
    if value is None:
        return F.lit(None)
    if f.kind == "decimal":
        return _decimal(value, f)
    if f.kind == "money":
        return F.struct(F.lit(value[0]).alias("currency"), _decimal(value[1], f).alias("amount"))
    if f.kind == "instant":
        return F.lit(value.astimezone(dt.UTC).strftime("%Y-%m-%d %H:%M:%S.%f").rjust(26, "0") + "+00:00").cast("timestamp")
    if f.kind == "integer":
        return F.lit(value).cast("bigint")
    return F.lit(value)


def _decimal(value: Decimal, f: Field) -> Column:
    if f.precision:
        return F.lit(f"{value:f}").cast(f"decimal({f.precision},{f.scale})")
    return F.struct(*(F.lit(f"{x:f}").cast(LIMB).alias(n) for x, n in zip(split_limbs(value), ("i", "f1", "f2"), strict=True)))
