"""Two-valued predicates as columns that are never null and still reach the scan.

Because every leaf is true or false, `~` is the exact complement.
"""

from __future__ import annotations

import operator
from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.catalog import Dataset, Field
from ..plans.compile import Leaf, Node
from ..sources.bindings import column, lit

Name = Callable[[Field], Column]


def _named(f: Field) -> Column:
    return F.col(column(f.id))


def build(node: Any, name: Name = _named) -> Column:
    if isinstance(node, Node):
        items = [build(x, name) for x in node.items]
        if node.kind == "not":
            return ~items[0]
        return reduce(operator.and_ if node.kind == "and" else operator.or_, items)
    return leaf(node, name(node.field))


_ORDERED = {"lt": operator.lt, "lte": operator.le, "gt": operator.gt, "gte": operator.ge}


def leaf(x: Leaf, c: Column) -> Column:
    if x.op == "isNull":
        return c.isNull()
    if x.op == "isNotNull":
        return c.isNotNull()
    if x.op in ("eq", "ne"):
        same = c.isNull() if x.value is None else c.isNotNull() & (c == lit(x.value, x.field))
        return same if x.op == "eq" else ~same
    if x.op in ("in", "notIn"):
        known = [lit(v, x.field) for v in x.value if v is not None]
        found = (c.isNotNull() & c.isin(*known)) if known else F.lit(False)
        if len(known) < len(x.value):
            found = found | c.isNull()
        return found if x.op == "in" else ~found
    if x.op == "window":
        low, high, closed = x.value
        below = c <= lit(high, x.field) if closed else c < lit(high, x.field)
        return c.isNotNull() & (c >= lit(low, x.field)) & below
    if x.op == "contains":
        return c.isNotNull() & c.contains(x.value)
    if x.op == "startsWith":
        return c.isNotNull() & c.startswith(x.value)
    return c.isNotNull() & _ORDERED[x.op](c, lit(x.value, x.field))


def scoped(df: DataFrame, dataset: Dataset, allowed: dict[str, list[Any]]) -> DataFrame:
    """The rows a scope may see; comes before everything a caller asks for.  Empty `allowed`: rows with an id."""
    if not allowed:
        return df.where(F.col(column(dataset.id_field)).isNotNull())
    for name, values in allowed.items():
        f = dataset.fields[name]
        df = df.where(leaf(Leaf(f, "in", tuple(values)), F.col(column(name))))
    return df


def fields_of(node: Any) -> set[str]:
    if node is None:
        return set()
    if isinstance(node, Node):
        return set().union(*(fields_of(x) for x in node.items))
    return {node.field.id}


def shapes(node: Any) -> set[str]:
    """Kinds of predicates in a filter: its shape, for certifications."""
    if node is None:
        return set()
    if isinstance(node, Node):
        return {node.kind}.union(*(shapes(x) for x in node.items))
    return {node.op}


def holds(node: Any, row: dict[str, Any]) -> bool:
    """A having tree over one row of plain numbers and nulls."""
    if isinstance(node, Node):
        items = [holds(x, row) for x in node.items]
        return not items[0] if node.kind == "not" else all(items) if node.kind == "and" else any(items)
    value = row[node.field.id]
    if node.op in ("isNull", "isNotNull"):
        return (value is None) == (node.op == "isNull")
    if node.op in ("eq", "ne"):
        return (value == node.value) == (node.op == "eq")
    return value is not None and _ORDERED[node.op](value, node.value)
