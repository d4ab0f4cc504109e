"""Registered queries of the engine over the driver's tables, each with SQL for the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import scratch
from .engine import Engine
from .functions import vectors
from .operators import aggregate
from .plans.catalog import Catalog, Policy, Scope
from .plans.values import INTEGER_LIMIT
from .sources.bindings import Binding

ANCHOR = "2024-01-20T12:00:00Z"


def _field(name: str, kind: str, nullable: bool = False, **more) -> dict:
    extra = {"normalization": "NFC", "collation": "unicode-codepoint-v0"} if kind == "text" else {}
    return {"id": name, "description": name, "kind": kind, "nullable": nullable, **extra, **more}


def _enum(name: str, codes: str) -> dict:
    return _field(name, "enum", values=[{"code": c, "label": c} for c in codes.split()])


def _dataset(name: str, fields: list[dict], **more) -> dict:
    return {"id": name, "description": name, "idField": f"{name}.id", "profiles": ["records.v0", "aggregate.v0", "retrieve.semantic.v0", "retrieve.hybrid.v0", "ingest.canonical.v0"], "rowScope": {"kind": "none", "reason": "test data"}, "fields": [_field(f"{name}.id", "id"), *fields], **more}


def catalog(timezone: str = "UTC", week: str = "monday", fiscal: str = "00:00:00", default_filters: list | None = None, partition: str | None = None) -> Catalog:
    amount = {"precision": 14, "scale": 2}
    money = {"currencies": ["EUR", "USD"], **amount}
    events = _dataset(
        "events",
        [
            _field("events.at", "instant", precision="microsecond"),
            _field("events.user", "integer"),
            _enum("events.type", "click error purchase signup view"),
            _field("events.value", "decimal", **amount),
            _field("events.maybe", "decimal", True, **amount),
            _field("events.free", "decimal"),
            _field("events.paid", "money", **money),
            _field("events.day", "date"),
            _field("events.even", "boolean"),
        ],
        defaultFilters=default_filters or [],
        **({"rowScope": {"kind": "partition", "dimensions": [partition]}} if partition else {}),
    )
    orders = _dataset("orders", [_enum("orders.status", "F O P"), _field("orders.total", "decimal", **amount), _field("orders.placed", "instant", precision="second"), _field("orders.priority", "text"), _field("orders.customer", "integer")])
    customers = _dataset("customers", [_field("customers.name", "text"), _field("customers.balance", "decimal", True, **amount), _field("customers.segment", "text"), _field("customers.nation", "integer")])
    texts = _dataset("texts", [_field("texts.body", "text"), _field("texts.lang", "text"), _field("texts.size", "integer")])
    items = _dataset("items", [_field("items.label", "integer"), _field("items.body", "text", True)], embeddings={m: f"{m}@1" for m in ("cosine", "dot", "near")})
    nations = _dataset("nations", [_field("nations.name", "text"), _field("nations.region", "integer")])
    spec = lambda name, metric: {"id": f"{name}@1", "sourceFields": ["items.body"], "inputTransform": "plain-v1", "model": {"id": "hashed", "revision": "1"}, "dimension": 64, "metric": metric, "vectorEncoding": "float32", "chunking": "none", "privacyClass": "public"}
    return Catalog.load(
        {
            "version": "workload-1",
            "calendar": {"timezone": timezone, "timezoneDatabase": "fixed-offset", "weekStart": week, "fiscalDayStart": fiscal},
            "embeddingSpecs": [spec("cosine", "cosine"), spec("dot", "dotProduct"), spec("near", "squaredEuclidean")],
            "qualityProfiles": [{"id": "baseline-unset-v0", "searchKinds": ["semantic", "hybrid"], "thresholds": None}],
            "datasets": [events, orders, customers, texts, items, nations],
        }
    )


def bindings(sf_dir: str) -> dict[str, Binding]:
    table = lambda name: lambda spark: spark.read.parquet(f"{sf_dir}/{name}.parquet")

    def items(spark: SparkSession) -> DataFrame:  # all vectors; only lexical search reads the texts
        return table("embeddings")(spark).join(table("documents")(spark), F.col("vec_id") == F.col("doc_id"), "left")

    vector = dict.fromkeys(("cosine@1", "dot@1", "near@1"), "embedding")
    return {
        "events": Binding(
            table("events"),
            {
                "events.id": "cast(event_id as string)",
                "events.at": "cast(ts as timestamp)",
                "events.user": "user_id",
                "events.type": "event_type",
                "events.value": "cast(value as decimal(14,2))",
                "events.maybe": "case when user_id % 5 = 0 then null else cast(value as decimal(14,2)) end",
                "events.free": "cast(cast(value as decimal(14,2)) as string)",
                "events.paid": "struct(case when user_id % 2 = 0 then 'EUR' else 'USD' end as currency, cast(value as decimal(14,2)) as amount)",
                "events.day": "cast(ts as date)",
                "events.even": "user_id % 2 = 0",
            },
        ),
        "orders": Binding(table("orders"), {"orders.id": "cast(o_orderkey as string)", "orders.status": "o_orderstatus", "orders.total": "cast(o_totalprice as decimal(14,2))", "orders.placed": "cast(o_orderdate as timestamp)", "orders.priority": "o_orderpriority", "orders.customer": "o_custkey"}),
        "customers": Binding(table("customer"), {"customers.id": "cast(c_custkey as string)", "customers.name": "c_name", "customers.balance": "cast(nullif(c_acctbal, 0) as decimal(14,2))", "customers.segment": "c_mktsegment", "customers.nation": "c_nationkey"}),
        "texts": Binding(table("documents"), {"texts.id": "cast(doc_id as string)", "texts.body": "text", "texts.lang": "lang", "texts.size": "n_chars"}),
        "items": Binding(items, {"items.id": "cast(vec_id as string)", "items.label": "label", "items.body": "text"}, vector),
        "nations": Binding(table("nation"), {"nations.id": "cast(n_nationkey as string)", "nations.name": "n_name", "nations.region": "n_regionkey"}),
    }


def engine(spark: SparkSession, sf_dir: str, policy: Policy | None = None, **calendar) -> Engine:
    scratch.prepare(spark)
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return Engine(spark, catalog(**calendar), bindings(sf_dir), policy or Policy(), exact_limit=INTEGER_LIMIT)


def everything(partitions: dict | None = None) -> Scope:
    """A scope that admits exact retrieval over any number of rows, as the queries' SQL ranks all there are."""
    return Scope.open(partitions, exactEligibleRecords=INTEGER_LIMIT)


def plain(df: DataFrame) -> DataFrame:
    """Result columns by their bare names, decimals and times as text, money as two columns."""
    out = []
    for f in df.schema:
        name = f.name.rpartition(".")[2].removeprefix("d_").removeprefix("m_")
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DecimalType):
            out.append(c.cast("string").alias(name))
        elif isinstance(f.dataType, T.TimestampType):
            out.append(F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(name))
        elif isinstance(f.dataType, T.DateType):
            out.append(c.cast("string").alias(name))
        elif isinstance(f.dataType, T.StructType) and "currency" in f.dataType.names:
            out += [c["currency"].alias(f"{name}_currency"), c["amount"].cast("string").alias(f"{name}_amount")]
        elif isinstance(f.dataType, T.StructType):  # limbs of a decimal of any scale
            whole = c["i"].cast("decimal(29,0)") + c["f1"].cast("decimal(19,0)") * F.lit("0.0000000000000000001").cast("decimal(19,19)").cast("decimal(19,19)")
            out.append(whole.cast("decimal(38,9)").cast("string").alias(name))
        else:
            out.append(c.alias(name))
    return df.select(*out)


# -- definitions ---------------------------------------------------------------------

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

EVENTS = "(SELECT CAST(event_id AS VARCHAR) AS id, ts AS moment, user_id AS user, event_type AS type, CAST(value AS DECIMAL(14,2)) AS value, CASE WHEN user_id % 5 = 0 THEN NULL ELSE CAST(value AS DECIMAL(14,2)) END AS maybe, CASE WHEN user_id % 2 = 0 THEN 'EUR' ELSE 'USD' END AS currency, CAST(ts AS DATE) AS day, user_id % 2 = 0 AS even FROM events) e"
ORDERS = "(SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderstatus AS status, CAST(o_totalprice AS DECIMAL(14,2)) AS total, o_orderdate AS placed, o_orderpriority AS priority, o_custkey AS customer FROM orders) o"
TEXTS = "(SELECT CAST(doc_id AS VARCHAR) AS id, text AS body, lang, n_chars AS size FROM documents) t"


def sql_half_even(total: str, count: str, scale: int = 2) -> str:
    """SQL text of total / count, to nine places, half to even, as text; total has `scale` places."""
    n = f"(CAST(({total}) * {10**scale} AS HUGEINT) * {10 ** (9 - scale)})"
    a, d = f"abs({n})", f"CAST({count} AS HUGEINT)"
    q = f"({a} // {d} + CASE WHEN 2 * ({a} % {d}) > {d} OR (2 * ({a} % {d}) = {d} AND ({a} // {d}) % 2 = 1) THEN 1 ELSE 0 END)"
    return f"CASE WHEN ({total}) IS NULL OR {count} = 0 THEN NULL ELSE CAST(CAST(CASE WHEN {n} < 0 THEN -{q} ELSE {q} END AS DECIMAL(29,0)) * CAST('0.000000001' AS DECIMAL(9,9)) AS VARCHAR) END"


def _add(name: str, query: dict, sql: str, finish: Callable[[DataFrame], DataFrame] = plain, scope: dict | None = None, policy: dict | None = None, **calendar) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = engine(spark, sf_dir, Policy(policy), **calendar)
        uses = "inLast" in str(query) or "inCurrent" in str(query) or "inPrevious" in str(query)
        return finish(e.dataframe(query, everything(scope), anchor=ANCHOR if uses else None))

    QUERIES[name], ORACLES[name] = run, sql


def _leaf(field: str, op: str, value=None, **more) -> dict:
    return {"kind": "predicate", "field": field, "op": op, **({"value": value} if value is not None else {}), **more}


def _metric(name: str, op: str, field: str | None = None, **more) -> dict:
    return {"id": name, "op": op, **({"field": field} if field else {}), **more}


def _group(source: str, dims: list, metrics: list, order: list | None = None, take: int = 1000, **more) -> dict:
    first = [(d["id"] if isinstance(d, dict) else d) for d in dims][:1] or [metrics[0]["id"]]
    dims = [d if isinstance(d, dict) else {"kind": "field", "field": f"{source}.{d}", "id": d} for d in dims]
    return {"version": "0", "mode": "aggregate", "from": source, "dimensions": dims, "metrics": metrics, "order": order or [{"by": first[0], "dir": "asc"}], "take": take, **more}


def _records(source: str, select: list[str], order: list[tuple[str, str]], take: int = 1000, **more) -> dict:
    return {"version": "0", "mode": "records", "from": source, "select": [f"{source}.{s}" for s in select], "order": [{"by": f"{source}.{b}", "dir": d} for b, d in order], "take": take, **more}


# Predicates: each over the whole table, its rows counted and summed by type.
_PREDICATES = {
    "f1_eq": (_leaf("events.type", "eq", "click"), "type = 'click'"),
    "f2_ne": (_leaf("events.maybe", "ne", "10.00"), "maybe IS DISTINCT FROM 10.00"),
    "f3_lt": (_leaf("events.value", "lt", "50.00"), "value < 50.00"),
    "f4_lte": (_leaf("events.maybe", "lte", "50.00"), "coalesce(maybe <= 50.00, false)"),
    "f5_gt": (_leaf("events.user", "gt", 40), "user > 40"),
    "f6_gte": (_leaf("events.day", "gte", "2024-01-15"), "day >= DATE '2024-01-15'"),
    "f7_decimal_any_scale": (_leaf("events.free", "lt", "42.5"), "value < 42.5"),
    "f8_money_order": (_leaf("events.paid", "gt", {"amount": "25.00", "currency": "EUR"}), "(currency > 'EUR' OR (currency = 'EUR' AND value > 25.00))"),
    "f9_in": (_leaf("events.type", "in", values=["click", "view"]), "type IN ('click', 'view')"),
    "f9_in_null": (_leaf("events.maybe", "in", values=[None, "10.00"]), "(maybe IS NULL OR maybe = 10.00)"),
    "f10_not_in": (_leaf("events.type", "notIn", values=["click", "view"]), "type NOT IN ('click', 'view')"),
    "f11_is_null": (_leaf("events.maybe", "isNull"), "maybe IS NULL"),
    "f12_is_not_null": (_leaf("events.maybe", "isNotNull"), "maybe IS NOT NULL"),
    "f15_in_last": (_leaf("events.at", "inLast", amount=7, unit="day"), "moment >= TIMESTAMP '2024-01-13 12:00:00' AND moment <= TIMESTAMP '2024-01-20 12:00:00'"),
    "f16_in_current": (_leaf("events.at", "inCurrent", unit="week"), "moment >= TIMESTAMP '2024-01-15' AND moment < TIMESTAMP '2024-01-22'"),
    "f17_in_previous": (_leaf("events.at", "inPrevious", unit="week"), "moment >= TIMESTAMP '2024-01-08' AND moment < TIMESTAMP '2024-01-15'"),
    "f18_instant_range": ({"kind": "and", "items": [_leaf("events.at", "gte", "2024-01-05T00:00:00.000000Z"), _leaf("events.at", "lt", "2024-01-09T00:00:00.000000Z")]}, "moment >= TIMESTAMP '2024-01-05' AND moment < TIMESTAMP '2024-01-09'"),
    "f19_and": ({"kind": "and", "items": [_leaf("events.type", "eq", "view"), _leaf("events.value", "gt", "20.00")]}, "type = 'view' AND value > 20.00"),
    "f20_or": ({"kind": "or", "items": [_leaf("events.type", "eq", "view"), _leaf("events.value", "gt", "90.00")]}, "type = 'view' OR value > 90.00"),
    "f21_not": ({"kind": "not", "item": _leaf("events.maybe", "lt", "50.00")}, "NOT coalesce(maybe < 50.00, false)"),
    "f22_half_open": ({"kind": "and", "items": [_leaf("events.value", "gte", "10.00"), _leaf("events.value", "lt", "20.00")]}, "value >= 10.00 AND value < 20.00"),
    "f_boolean": (_leaf("events.even", "eq", True), "even"),
}
_COUNTED = [_metric("n", "count"), _metric("users", "countDistinct", "events.user"), _metric("total", "sum", "events.value")]
for _name, (_tree, _where) in _PREDICATES.items():
    _add(_name, _group("events", ["type"], _COUNTED, where=_tree), f"SELECT type, count(*) AS n, count(DISTINCT user) AS users, CAST(sum(value) AS VARCHAR) AS total FROM {EVENTS} WHERE {_where} GROUP BY type")

_BY_LANG = [_metric("n", "count"), _metric("chars", "sum", "texts.size")]
for _name, _op, _needle, _where in (("f13_contains", "contains", "ing th", "contains(body, 'ing th')"), ("f14_starts_with", "startsWith", "The", "starts_with(body, 'The')")):
    _add(_name, _group("texts", ["lang"], _BY_LANG, where=_leaf("texts.body", _op, _needle)), f"SELECT lang, count(*) AS n, CAST(sum(size) AS BIGINT) AS chars FROM {TEXTS} WHERE {_where} GROUP BY lang")

_add("f23_default_filter", _group("events", ["type"], _COUNTED), f"SELECT type, count(*) AS n, count(DISTINCT user) AS users, CAST(sum(value) AS VARCHAR) AS total FROM {EVENTS} WHERE type <> 'error' GROUP BY type", default_filters=[_leaf("events.type", "ne", "error")])
_add("f24_row_scope", _group("events", ["type"], _COUNTED, where={"kind": "or", "items": [_leaf("events.type", "eq", "click"), _leaf("events.type", "isNotNull")]}), f"SELECT type, count(*) AS n, count(DISTINCT user) AS users, CAST(sum(value) AS VARCHAR) AS total FROM {EVENTS} WHERE type IN ('click', 'purchase') GROUP BY type", scope={"events.type": ["purchase", "click"]}, partition="events.type")
_add("f26_having", _group("events", ["user"], [_metric("n", "count"), _metric("mean", "avg", "events.value")], having={"kind": "and", "items": [{"kind": "predicate", "metric": "n", "op": "gte", "value": 2}, {"kind": "predicate", "metric": "mean", "op": "gt", "value": "20.000000000"}]}), f"SELECT user, n, mean FROM (SELECT user, count(*) AS n, {sql_half_even('sum(value)', 'count(value)')} AS mean FROM {EVENTS} GROUP BY user) WHERE n >= 2 AND CAST(mean AS DECIMAL(38,9)) > 20 ORDER BY user LIMIT 1000")

# Aggregates.
_add("flagship", _group("orders", ["status"], [_metric("n", "count"), _metric("total", "sum", "orders.total"), _metric("mean", "avg", "orders.total")], take=10), f"SELECT status, count(*) AS n, CAST(sum(total) AS VARCHAR) AS total, {sql_half_even('sum(total)', 'count(total)')} AS mean FROM {ORDERS} GROUP BY status")
_add("a1_group_by", _group("orders", ["status", "priority"], [_metric("n", "count"), _metric("total", "sum", "orders.total")]), f"SELECT status, priority, count(*) AS n, CAST(sum(total) AS VARCHAR) AS total FROM {ORDERS} GROUP BY status, priority")
_add("a2_global", _group("orders", [], [_metric("n", "count"), _metric("customers", "countDistinct", "orders.customer"), _metric("low", "min", "orders.total"), _metric("high", "max", "orders.total")]), f"SELECT count(*) AS n, count(DISTINCT customer) AS customers, CAST(min(total) AS VARCHAR) AS low, CAST(max(total) AS VARCHAR) AS high FROM {ORDERS}")
_add("a2_empty_input", _group("events", [], [_metric("n", "count"), _metric("total", "sum", "events.value"), _metric("mean", "avg", "events.value")], where=_leaf("events.user", "lt", -5)), f"SELECT count(*) AS n, CAST(sum(value) AS VARCHAR) AS total, CAST(NULL AS VARCHAR) AS mean FROM {EVENTS} WHERE user < -5")
_add("a3_null_group", _group("events", ["maybe"], [_metric("n", "count")]), f"SELECT CAST(maybe AS VARCHAR) AS maybe, count(*) AS n FROM {EVENTS} GROUP BY maybe ORDER BY e.maybe NULLS LAST LIMIT 1000")
_add("a6_count_distinct_money", _group("events", ["type"], [_metric("amounts", "countDistinct", "events.paid"), _metric("some", "countDistinct", "events.maybe")]), f"SELECT type, count(DISTINCT currency || CAST(value AS VARCHAR)) AS amounts, count(DISTINCT maybe) AS some FROM {EVENTS} GROUP BY type")
_add("a7_sum_integer", _group("events", ["type"], [_metric("total", "sum", "events.user")]), f"SELECT type, CAST(sum(user) AS BIGINT) AS total FROM {EVENTS} GROUP BY type")
_add("a8_sum_any_scale", _group("events", ["type"], [_metric("total", "sum", "events.free")]), f"SELECT type, CAST(CAST(sum(value) AS DECIMAL(38,9)) AS VARCHAR) AS total FROM {EVENTS} GROUP BY type")
_add("a9_sum_money", _group("events", ["even"], [_metric("paid", "sum", "events.paid")]), f"SELECT even, min(currency) AS paid_currency, CAST(sum(value) AS VARCHAR) AS paid_amount FROM {EVENTS} GROUP BY even")
_add("a10_avg_integer", _group("events", ["type"], [_metric("mean", "avg", "events.user")]), f"SELECT type, {sql_half_even('sum(user)', 'count(user)', 0)} AS mean FROM {EVENTS} GROUP BY type")
_add("a11_avg_decimal", _group("events", ["type"], [_metric("mean", "avg", "events.maybe")]), f"SELECT type, {sql_half_even('sum(maybe)', 'count(maybe)')} AS mean FROM {EVENTS} GROUP BY type")
_add("a11_avg_money", _group("events", ["even"], [_metric("mean", "avg", "events.paid")]), f"SELECT even, min(currency) AS mean_currency, {sql_half_even('sum(value)', 'count(value)')} AS mean_amount FROM {EVENTS} GROUP BY even")
_add("a12_min_max_kinds", _group("events", ["type"], [_metric("first", "min", "events.at"), _metric("last", "max", "events.at"), _metric("least", "min", "events.maybe"), _metric("most", "max", "events.paid"), _metric("day", "max", "events.day")]), f"SELECT type, strftime(min(moment), '%Y-%m-%d %H:%M:%S.%f') AS first, strftime(max(moment), '%Y-%m-%d %H:%M:%S.%f') AS last, CAST(min(maybe) AS VARCHAR) AS least, max(currency) AS most_currency, CAST(max(value) FILTER (currency = 'USD') AS VARCHAR) AS most_amount, CAST(max(day) AS VARCHAR) AS day FROM {EVENTS} GROUP BY type")
_add("a14_ratio", _group("events", ["user"], [_metric("buys", "count", where=_leaf("events.type", "eq", "purchase")), _metric("clicks", "count", where=_leaf("events.type", "eq", "click")), {"id": "rate", "op": "ratio", "numerator": "buys", "denominator": "clicks"}]), f"SELECT user, buys, clicks, {sql_half_even('buys', 'clicks', 0)} AS rate FROM (SELECT user, count(*) FILTER (type = 'purchase') AS buys, count(*) FILTER (type = 'click') AS clicks FROM {EVENTS} GROUP BY user) ORDER BY user LIMIT 1000")
_add("a15_filtered_metric", _group("events", ["day"], [_metric("n", "count"), _metric("bought", "sum", "events.value", where=_leaf("events.type", "eq", "purchase")), _metric("mean", "avg", "events.value", where=_leaf("events.type", "eq", "view"))]), f"SELECT CAST(day AS VARCHAR) AS day, count(*) AS n, CAST(sum(value) FILTER (type = 'purchase') AS VARCHAR) AS bought, {sql_half_even(chr(40) + 'sum(value) FILTER (type = ' + chr(39) + 'view' + chr(39) + ')' + chr(41), 'count(*) FILTER (type = ' + chr(39) + 'view' + chr(39) + ')')} AS mean FROM {EVENTS} GROUP BY day")
_add("a17_take_groups", _group("events", ["user"], [_metric("total", "sum", "events.value")], [{"by": "total", "dir": "desc"}], 25), f"SELECT user, CAST(sum(value) AS VARCHAR) AS total FROM {EVENTS} GROUP BY user ORDER BY sum(value) DESC, user LIMIT 25")
_add("a18_cohort", _group("orders", ["customer"], [_metric("n", "count"), _metric("total", "sum", "orders.total")]), f"SELECT customer, count(*) AS n, CAST(sum(total) AS VARCHAR) AS total FROM {ORDERS} GROUP BY customer HAVING count(DISTINCT id) >= 12 ORDER BY customer LIMIT 1000", policy={"version": "cohort", "release": {"principal": [{"kind": "minimumCohort", "minimum": 12}]}})

# Records.
_add("o1_nulls_last", _records("events", ["id", "maybe"], [("maybe", "desc")]), f"SELECT id, CAST(maybe AS VARCHAR) AS maybe FROM {EVENTS} ORDER BY e.maybe DESC NULLS LAST, id LIMIT 1000")
_add("o2_tie_break", _records("events", ["id", "type", "at"], [("type", "desc"), ("user", "asc")], 500), f"SELECT id, type, strftime(moment, '%Y-%m-%d %H:%M:%S.%f') AS \"at\" FROM {EVENTS} ORDER BY type DESC, user, id LIMIT 500")
_add("o3_aggregate_order", _group("events", ["user", "type"], [_metric("n", "count")], [{"by": "n", "dir": "desc"}], 300), f"SELECT user, type, count(*) AS n FROM {EVENTS} GROUP BY user, type ORDER BY n DESC, user, type LIMIT 300")
_add("o5_any_scale_order", _records("events", ["id", "free"], [("free", "desc")], 200), f"SELECT id, CAST(CAST(value AS DECIMAL(38,9)) AS VARCHAR) AS free FROM {EVENTS} ORDER BY value DESC, id LIMIT 200")
_add("o6_take", _records("customers", ["id", "name", "balance"], [("balance", "desc")], 100, where=_leaf("customers.segment", "eq", "BUILDING")), "SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS name, CAST(CAST(nullif(c_acctbal, 0) AS DECIMAL(14,2)) AS VARCHAR) AS balance FROM customer WHERE c_mktsegment = 'BUILDING' ORDER BY CAST(nullif(c_acctbal, 0) AS DECIMAL(14,2)) DESC NULLS LAST, CAST(c_custkey AS VARCHAR) LIMIT 100")
_add("p1_select", _records("events", ["at", "paid", "even", "id"], [("at", "asc")], 250), f"SELECT strftime(moment, '%Y-%m-%d %H:%M:%S.%f') AS \"at\", currency AS paid_currency, CAST(value AS VARCHAR) AS paid_amount, even, id FROM {EVENTS} ORDER BY moment, id LIMIT 250")

# Calendar buckets.
_STAMP = "'%Y-%m-%d %H:%M:%S.%f'"


def _buckets(grain: str) -> dict:
    return _group("events", [{"kind": "timeBucket", "field": "events.at", "grain": grain, "id": "period"}], [_metric("n", "count"), _metric("total", "sum", "events.value")])


def _bucket_query(name: str, grain: str, start: str, step: str, text: str, **calendar) -> None:
    """start: SQL of the period's first UTC instant, from `moment`; text: SQL of the label, from s."""
    query = _buckets(grain)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = engine(spark, sf_dir, **calendar)
        plan = e.compile(query, Scope.open())
        return plain(aggregate.period_columns(e.frame(plan), plan, "period"))

    QUERIES[name] = run
    ORACLES[name] = f"SELECT strftime(s, {_STAMP}) AS period_start, strftime({step}, {_STAMP}) AS period_end, {text} AS period_label, count(*) AS n, CAST(sum(value) AS VARCHAR) AS total FROM (SELECT {start} AS s, value FROM {EVENTS}) GROUP BY s"


_bucket_query("c1_day_utc", "day", "date_trunc('day', moment)", "s + INTERVAL 1 DAY", "strftime(s, '%Y-%m-%d')")
_bucket_query("c2_fiscal_day_new_york", "fiscalDay", "date_trunc('day', moment - INTERVAL 9 HOUR) + INTERVAL 9 HOUR", "s + INTERVAL 1 DAY", "strftime(s - INTERVAL 9 HOUR, '%Y-%m-%d')", timezone="America/New_York", fiscal="04:00:00")
_bucket_query("c3_week_sunday", "week", "date_trunc('day', moment) - CAST(extract('dow' FROM moment) AS INTEGER) * INTERVAL 1 DAY", "s + INTERVAL 7 DAY", "'2024-W' || lpad(CAST(CAST(date_diff('day', TIMESTAMP '2023-12-31', s) // 7 + 1 AS INTEGER) AS VARCHAR), 2, '0')", week="sunday")
_bucket_query("c4_month", "month", "date_trunc('month', moment)", "s + INTERVAL 1 MONTH", "strftime(s, '%Y-%m')")
_bucket_query("c8_day_fixed_offset", "day", "date_trunc('day', moment + INTERVAL '5 hours 30 minutes') - INTERVAL '5 hours 30 minutes'", "s + INTERVAL 1 DAY", "strftime(s + INTERVAL '5 hours 30 minutes', '%Y-%m-%d')", timezone="+05:30")

# Order days of New York over years, with its clock changes; the day starts at a time that is left out in spring.
_SPRING = "CAST(make_date(year({0}), 4, 1) + CAST((7 - dayofweek(make_date(year({0}), 4, 1))) % 7 AS INTEGER) AS DATE)"
_FALL = "CAST(make_date(year({0}), 10, 31) - CAST(dayofweek(make_date(year({0}), 10, 31)) AS INTEGER) AS DATE)"


def _gap_start(day: str) -> str:
    """SQL of the UTC instant of 02:30 in New York (rules of 1987 to 2006), or of the end of the gap over it."""
    spring, fall = _SPRING.format(day), _FALL.format(day)
    return f"(CAST({day} AS TIMESTAMP) + CASE WHEN {day} = {spring} THEN INTERVAL 420 MINUTE WHEN {day} > {spring} AND {day} < {fall} THEN INTERVAL 390 MINUTE ELSE INTERVAL 450 MINUTE END)"


def _order_days(name: str, direction: str, take: int, tail: str) -> None:
    dim = {"kind": "timeBucket", "field": "orders.placed", "grain": "fiscalDay", "id": "period"}
    query = _group("orders", [dim], [_metric("n", "count"), _metric("total", "sum", "orders.total")], [{"by": "period", "dir": direction}], take)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = engine(spark, sf_dir, timezone="America/New_York", fiscal="02:30:00")
        plan = e.compile(query, Scope.open())
        return plain(aggregate.period_columns(e.frame(plan), plan, "period"))

    QUERIES[name] = run
    # orders are placed at midnight UTC, the evening before in New York
    ORACLES[name] = f"SELECT strftime({_gap_start('d')}, {_STAMP}) AS period_start, strftime({_gap_start('(d + 1)')}, {_STAMP}) AS period_end, strftime(d, '%Y-%m-%d') AS period_label, n, total FROM (SELECT CAST(placed AS DATE) - 1 AS d, count(*) AS n, CAST(sum(total) AS VARCHAR) AS total FROM {ORDERS} GROUP BY 1) ORDER BY d {tail}"


_order_days("c5_clock_changes", "asc", 1000, "LIMIT 1000")
_order_days("o4_period_order", "desc", 40, "DESC LIMIT 40")

# Retrieval.
ITEMS = "(SELECT CAST(vec_id AS VARCHAR) AS id, CAST(label AS BIGINT) AS label, text AS body, CAST(embedding AS DOUBLE[]) AS v FROM embeddings LEFT JOIN documents ON vec_id = doc_id) i"
_TEXT = "market news"
_QUERY = "CAST([" + ", ".join(repr(x) for x in vectors.hashed(_TEXT, 64)) + "] AS DOUBLE[])"


def _semantic(spec: str, take: int, accuracy: str = "exact", **more) -> dict:
    quality = "exact-oracle-v0" if accuracy == "exact" else "baseline-unset-v0"
    return {"version": "0", "mode": "retrieve", "from": "items", "select": ["items.label"], "search": {"kind": "semantic", "using": f"{spec}@1", "text": _TEXT, "accuracy": accuracy, "quality": quality}, "take": take, **more}


_SCORES = {"cosine": f"-list_cosine_similarity(v, {_QUERY})", "dot": f"-list_dot_product(v, {_QUERY})", "near": f"list_distance(v, {_QUERY})"}
for _name, _spec in (("r6_cosine_topk", "cosine"), ("r7_dot_topk", "dot"), ("r8_euclidean_topk", "near")):
    _add(_name, _semantic(_spec, 20), f"SELECT id, label, CAST(row_number() OVER (ORDER BY {_SCORES[_spec]}, id) AS INTEGER) AS rank FROM {ITEMS} QUALIFY rank <= 20")
_add("r11_filter_before_rank", _semantic("cosine", 15, where=_leaf("items.label", "in", values=[1, 2])), f"SELECT id, label, CAST(row_number() OVER (ORDER BY {_SCORES['cosine']}, id) AS INTEGER) AS rank FROM {ITEMS} WHERE label IN (1, 2) QUALIFY rank <= 15")
_add("r12_approximate", _semantic("dot", 20, "approximate"), f"SELECT id, label, CAST(row_number() OVER (ORDER BY {_SCORES['dot']}, id) AS INTEGER) AS rank FROM {ITEMS} QUALIFY rank <= 20")
_HYBRID = {"version": "0", "mode": "retrieve", "from": "items", "search": {"kind": "hybrid", "semantic": {"using": "cosine@1", "text": _TEXT, "accuracy": "approximate"}, "lexical": {"field": "items.body", "text": "ing th"}, "fusion": "rrf-v0", "quality": "baseline-unset-v0"}, "take": 20}
_add(
    "r15_rrf",
    _HYBRID,
    f"WITH a AS (SELECT id, row_number() OVER (ORDER BY {_SCORES['cosine']}, id) AS r FROM {ITEMS} QUALIFY r <= 80), b AS (SELECT id, row_number() OVER (ORDER BY (length(body) - length(replace(body, 'ing th', ''))) / 6 DESC, length(body), id) AS r FROM {ITEMS} WHERE contains(body, 'ing th') QUALIFY r <= 80) SELECT id, CAST(row_number() OVER (ORDER BY round(coalesce(1 / (60 + a.r), 0) + coalesce(1 / (60 + b.r), 0), 15) DESC, id) AS INTEGER) AS rank FROM a FULL JOIN b USING (id) QUALIFY rank <= 20",
)


def _bound(name: str, source: str, change: Callable[[DataFrame], DataFrame], query: dict, sql: str, **more) -> None:
    """A query over a source's table as `change` makes it."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = engine(spark, sf_dir)
        own = e.bindings[source]
        e.bindings[source] = replace(own, load=lambda s: change(own.load(s)), **more)
        return plain(e.dataframe(query, everything()))

    QUERIES[name], ORACLES[name] = run, sql


# Each vector stands there twice, so that every score ties; the cut goes through a pair.
_bound(
    "r9_ties_by_id",
    "items",
    lambda df: df.unionByName(df.withColumn("vec_id", F.col("vec_id") + 1_000_000_000)),
    _semantic("cosine", 21),
    f"SELECT id, label, CAST(row_number() OVER (ORDER BY {_SCORES['cosine']}, id) AS INTEGER) AS rank FROM (SELECT * FROM {ITEMS} UNION ALL SELECT CAST(CAST(id AS BIGINT) + 1000000000 AS VARCHAR) AS id, label, body, v FROM {ITEMS}) QUALIFY rank <= 21",
)
_bound("f25_unpartitioned_scope", "orders", lambda df: df.withColumn("o_orderkey", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderkey"))), _group("orders", ["status"], [_metric("n", "count")]), f"SELECT status, count(*) AS n FROM {ORDERS} WHERE CAST(id AS BIGINT) % 7 <> 0 GROUP BY status")

_bound("s3_soft_deleted", "orders", lambda df: df.withColumn("gone", F.col("o_custkey") % 4 == 0), _group("orders", ["status"], [_metric("n", "count")]), f"SELECT status, count(*) AS n FROM {ORDERS} WHERE customer % 4 <> 0 GROUP BY status", deleted="gone")


# Ingest: every nation goes in, some are replaced, some deleted, one comes back.
def _written(spark: SparkSession, sf_dir: str, upto: str) -> DataFrame:
    scratch.prepare(spark)
    e = Engine(spark, catalog(), store=f"{scratch.folder(spark)}/store-{uuid.uuid4().hex}")
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").orderBy("n_nationkey").collect()  # the 25 records of the requests
    scope = Scope.open()
    records = [{"id": str(r.n_nationkey), "value": {"name": r.n_name, "region": r.n_regionkey}} for r in rows]
    put = lambda mode, some: e.put({"dataset": "nations", "mode": mode, "records": some, "embeddingPolicy": "catalog", "idempotencyKey": uuid.uuid4().hex}, scope)
    put("insertOnly", records)
    put("insertOnly", records[:3])  # refused one by one
    if upto != "insert":
        put("replace", [{**r, "value": {**r["value"], "name": r["value"]["name"] + "!"}} for r in records if int(r["id"]) % 3 == 0])
    if upto == "delete":
        put("delete", [{"id": r["id"]} for r in records if int(r["id"]) % 4 == 0])
        put("insertOnly", [r for r in records if r["id"] == "4"])
    table = e.writer("nations").table
    return table.rows().select("id", "name", "region", F.col("_version").alias("version"))


def _outcomes(spark: SparkSession, sf_dir: str, what: str) -> DataFrame:
    """Outcomes of the last of several requests, one row a record."""
    scratch.prepare(spark)
    e = Engine(spark, catalog(), store=f"{scratch.folder(spark)}/store-{uuid.uuid4().hex}")
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").orderBy("n_nationkey").collect()  # the 25 records of the requests
    records = [{"id": str(r.n_nationkey), "value": {"name": r.n_name, "region": r.n_regionkey}} for r in rows]
    put = lambda mode, some, key: e.put({"dataset": "nations", "mode": mode, "records": some, "embeddingPolicy": "catalog", "idempotencyKey": key}, Scope.open())
    if what == "versions":  # the expected version is right for even ids
        put("insertOnly", records, "a")
        result = put("replace", [{**r, "ifVersion": 1 + int(r["id"]) % 2} for r in records], "b")
    elif what == "siblings":  # every third is there already, and every fifth has the wrong type
        put("insertOnly", records[::3], "a")
        result = put("insertOnly", [{**r, "value": {**r["value"], "region": "none"}} if int(r["id"]) % 5 == 0 else r for r in records], "b")
    else:  # the same request again gets the first one's answer
        put("insertOnly", records, "a")
        result = put("insertOnly", records, "a")
    out = [(o["id"], o["status"], o["version"] and str(o["version"]), o["error"] and o["error"]["code"]) for o in result["outcomes"]]
    return spark.createDataFrame(out, "id string, status string, version string, code string")


for _name, _what, _case in (
    ("i4_if_version", "versions", "CASE WHEN n_nationkey % 2 <> 0 THEN 'VERSION_CONFLICT' END"),
    ("i5_outcomes", "siblings", "CASE WHEN n_nationkey % 5 = 0 THEN 'SCHEMA_TYPE_MISMATCH' WHEN n_nationkey % 3 = 0 THEN 'RECORD_EXISTS' END"),
    ("i6_idempotency", "again", "CAST(NULL AS VARCHAR)"),
):
    QUERIES[_name] = lambda spark, d, what=_what: _outcomes(spark, d, what)
    ORACLES[_name] = f"SELECT CAST(n_nationkey AS VARCHAR) AS id, CASE WHEN code IS NULL THEN 'accepted' ELSE 'refused' END AS status, CASE WHEN code IS NULL THEN '{2 if _what == 'versions' else 1}' END AS version, code FROM (SELECT n_nationkey, {_case} AS code FROM nation)"
QUERIES["i1_insert_only"] = lambda spark, d: _written(spark, d, "insert")
QUERIES["i2_replace"] = lambda spark, d: _written(spark, d, "replace")
QUERIES["i3_delete"] = lambda spark, d: _written(spark, d, "delete")
ORACLES["i1_insert_only"] = "SELECT CAST(n_nationkey AS VARCHAR) AS id, n_name AS name, CAST(n_regionkey AS BIGINT) AS region, CAST(1 AS BIGINT) AS version FROM nation"
ORACLES["i2_replace"] = "SELECT CAST(n_nationkey AS VARCHAR) AS id, n_name || CASE WHEN n_nationkey % 3 = 0 THEN '!' ELSE '' END AS name, CAST(n_regionkey AS BIGINT) AS region, CAST(CASE WHEN n_nationkey % 3 = 0 THEN 2 ELSE 1 END AS BIGINT) AS version FROM nation"
ORACLES["i3_delete"] = "SELECT CAST(n_nationkey AS VARCHAR) AS id, n_name || CASE WHEN n_nationkey % 3 = 0 THEN '!' ELSE '' END AS name, CAST(n_regionkey AS BIGINT) AS region, CAST(CASE WHEN n_nationkey = 4 THEN 3 WHEN n_nationkey % 3 = 0 THEN 2 ELSE 1 END AS BIGINT) AS version FROM nation WHERE n_nationkey % 4 <> 0 OR n_nationkey = 4"
