"""Contract evaluation over the orders with faults: every kind of rule, and rules that are broken in several ways."""

from __future__ import annotations

from pyspark.sql import functions as F

from opsloom.operators.contracts import run_contracts
from opsloom.plans.fixtures import fixture, table, with_
from opsloom.registry import query

#: contract, status, asset, rule, kind, column, argument, threshold, severity, window.
RULES = [
    ("c1", "active", "orders", "has_customer", "completeness", "customer_id", "", ">=99%", "high", "day"),
    ("c1", "active", "orders", "has_amount", "completeness", "customer_id", "", "<=10%", "info", "day"),
    ("c1", "active", "orders", "amount_range", "range", "amount", "0..400000", "<=5%", "warning", "day"),
    ("c1", "active", "orders", "id_form", "regex", "order_id", "[0-9]*[02468]", "<=60%", "info", None),
    ("c1", "active", "orders", "positive", "validity", "", "amount > 0", "<=0%", "blocking", "day"),
    ("c1", "active", "orders", "no_limit", "validity", "", "amount > 0", "about 1", "blocking", "day"),
    ("c2", "approved", "orders", "one_id", "uniqueness", "order_id", "", "<=0%", "critical", "day"),
    ("c2", "approved", "orders", "known", "referential", "customer_id", "customer.c_custkey", "<=5%", "critical", "day"),
    ("c2", "approved", "orders", "rows", "volume", "", "", "0.5", "high", "day"),
    ("c2", "approved", "orders", "fresh", "freshness", "", "", "<= 24h", "high", "day"),
    ("c2", "approved", "orders", "shape", "schema", "", "", "", "high", "day"),
    ("c2", "approved", "orders", "negative", "custom", "count(amount)", "count_if(amount < 0)", "<=1%", "warning", "day"),
    ("c2", "approved", "nowhere", "lost_table", "completeness", "x", "", "<=0%", "info", "day"),
    ("c2", "approved", "orders", "lost_parent", "referential", "customer_id", "nobody.k", "<=0%", "info", "day"),
    ("c2", "approved", "orders", "lost_column", "uniqueness", "nothing", "", "<=0%", "info", "day"),
    ("c2", "approved", "orders", "not_sql", "validity", "", "amount >", "<=0%", "info", "day"),
    ("c2", "approved", "orders", "no_predicate", "validity", "", "amount + 1", "<=0%", "info", "day"),
    ("c2", "approved", "orders", "fails_late", "validity", "", "cast(concat('x', order_id) as int) > 0", "<=0%", "info", "day"),
    ("c2", "approved", "orders", "no_kind", "magic", "order_id", "", "<=0%", "info", "day"),
    ("c2", "approved", "orders", "no_duration", "freshness", "", "", "soon", "info", "day"),
    ("c3", "draft", "orders", "not_run", "completeness", "amount", "", "<=0%", "info", "day"),
]
#: Declared columns of the contract c2: one is missing and one has another type.
COLUMNS = [("c2", "order_id", "long"), ("c2", "customer_id", "BIGINT"), ("c2", "amount", "decimal(18,2)"), ("c2", "shipped_at", "timestamp")]

_ROW = "SELECT {i} AS i, 'share' AS m, count(CASE WHEN {bad} THEN 1 END) AS n, count(*) AS d, (SELECT string_agg(id, ',' ORDER BY h, id) FROM (SELECT DISTINCT substr(md5(CAST(order_id AS string)), 1, 15) AS h, CAST(order_id AS string) AS id FROM dirty_orders WHERE {bad} ORDER BY 1, 2 LIMIT 5) AS s) AS keys FROM dirty_orders"
_KEY = "SELECT {i}, 'share', sum(CASE WHEN bad THEN n ELSE 0 END), sum(n), (SELECT string_agg(k, ',' ORDER BY h, k) FROM (SELECT substr(md5(coalesce(k, '')), 1, 15) AS h, k FROM {t} WHERE bad ORDER BY 1, 2 LIMIT 5) AS s) FROM {t}"
_BAD = {"has_customer": "customer_id IS NULL", "has_amount": "customer_id IS NULL", "amount_range": "NOT (amount >= 0 AND amount <= 400000)", "id_form": "NOT regexp_full_match(CAST(order_id AS string), '[0-9]*[02468]')", "positive": "NOT amount > 0", "no_limit": "NOT amount > 0"}
_AT = {r[3]: i for i, r in enumerate(RULES)}


def _text(x) -> str:
    return "NULL" if x is None else "'" + str(x).replace("'", "''") + "'"


_VALUES = ", ".join(f"({i}, {', '.join(map(_text, r))})" for i, r in enumerate(RULES) if r[1] != "draft")
_LIMITS = "CASE threshold WHEN '>=99%' THEN 0.01 WHEN '<=10%' THEN 0.1 WHEN '<=5%' THEN 0.05 WHEN '<=60%' THEN 0.6 WHEN '<=1%' THEN 0.01 WHEN '<=0%' THEN 0 END"
_ORACLE = (
    with_("dirty_orders")
    + f""", u AS (SELECT CAST(order_id AS string) AS k, count(*) AS n, count(*) > 1 AS bad FROM dirty_orders GROUP BY 1),
    f AS (SELECT CAST(customer_id AS string) AS k, count(*) AS n, count(c_custkey) = 0 AS bad FROM dirty_orders LEFT JOIN customer ON c_custkey = customer_id GROUP BY 1),
    p AS (SELECT median(n) AS usual FROM (SELECT count(*) AS n FROM orders GROUP BY year(o_orderdate) ORDER BY year(o_orderdate) DESC LIMIT 10) AS x),
    r(i, contract_id, st, asset, rule_id, dimension, col, arg, threshold, severity, win) AS (VALUES {_VALUES}),
    m AS ({" UNION ALL ".join(_ROW.format(i=_AT[name], bad=bad) for name, bad in _BAD.items())}
        UNION ALL {_KEY.format(i=_AT["one_id"], t="u")} UNION ALL {_KEY.format(i=_AT["known"], t="f")}
        UNION ALL SELECT {_AT["rows"]}, CASE WHEN count(*) / (SELECT usual FROM p) >= 0.5 THEN 'passed' ELSE 'violated' END, count(*), count(*), NULL FROM dirty_orders
        UNION ALL SELECT {_AT["fresh"]}, CASE WHEN epoch(TIMESTAMP '1998-12-31 00:00:00') - epoch(max(o_orderdate)) <= 86400 THEN 'passed' ELSE 'violated' END, epoch(TIMESTAMP '1998-12-31 00:00:00') - epoch(max(o_orderdate)), 0, NULL FROM orders
        UNION ALL SELECT {_AT["shape"]}, 'violated', 2, 4, NULL
        UNION ALL SELECT {_AT["negative"]}, 'share', count(CASE WHEN amount < 0 THEN 1 END), count(amount), NULL FROM dirty_orders)
    SELECT contract_id, rule_id, asset, dimension, CASE WHEN m IS NULL OR m = 'share' AND {_LIMITS} IS NULL THEN 'evaluation_error' WHEN m <> 'share' THEN m WHEN d > 0 AND n / d > {_LIMITS} THEN 'violated' ELSE 'passed' END AS status,
        CAST(n AS bigint) AS numerator, CAST(d AS bigint) AS denominator, CASE WHEN d > 0 THEN round(n / d, 8) END AS ratio, threshold, severity, win AS rule_window,
        substr(sha256(dimension || '|' || asset || '|' || col || '|' || arg), 1, 16) AS query_hash, keys AS sample_keys, m IS NULL OR m = 'share' AND {_LIMITS} IS NULL AS said_why FROM r LEFT JOIN m ON m.i = r.i"""
)


@query(_ORACLE)
def contract_results(spark, sf_dir):
    contracts = spark.createDataFrame(RULES, "contract_id string, status string, asset string, rule_id string, kind string, column string, argument string, threshold string, severity string, window string")
    columns = spark.createDataFrame(COLUMNS, "contract_id string, column_name string, data_type string")
    orders = table(spark, sf_dir, "orders")
    writes = orders.selectExpr("'orders' asset", "o_orderdate timestamp")
    history = orders.groupBy(F.year("o_orderdate").alias("y")).agg(F.count(F.lit(1)).alias("numerator")).selectExpr("'orders' asset", "'rows' rule_id", "numerator", "'passed' status", "y evaluated_at", "cast(y as string) result_id")
    now = spark.sql("SELECT timestamp'1998-12-31 00:00:00'").first()[0]
    out = run_contracts(contracts, {"orders": fixture(spark, sf_dir, "dirty_orders"), "customer": table(spark, sf_dir, "customer")}, now, columns, writes, history, {"orders": ["order_id"]})
    keys = F.when(F.size("sample_keys") > 0, F.array_join("sample_keys", ","))
    return out.select("contract_id", "rule_id", "asset", "dimension", "status", "numerator", "denominator", F.round("ratio", 8).alias("ratio"), "threshold", "severity", F.col("window").alias("rule_window"), "query_hash", keys.alias("sample_keys"), F.col("error_message").isNotNull().alias("said_why"))
