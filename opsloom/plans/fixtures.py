"""Tables of the operators' shapes, derived from the TPC-H-like and event tables by portable SQL.

Each fixture is one SELECT that Spark and an ANSI engine read alike, so a query and its oracle start from the same
rows. Only arithmetic, CASE and string joins are used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _price_period(k: int) -> str:
    """The k-th of three validity periods of each brand's price."""
    start, end = ("1990-01-01", "1995-01-01", "1997-01-01")[k], ("1995-01-01", "1997-01-01", None)[k]
    until = f"TIMESTAMP '{end} 00:00:00'" if end else "CAST(NULL AS timestamp)"
    return f"""
        SELECT p_brand AS sku_name, CAST({k} AS int) AS period, CAST(MIN(p_size) + {k} AS bigint) AS price_cents,
               CASE WHEN MIN(p_size) % 11 = 10 THEN 'EUR' ELSE 'USD' END AS currency,
               TIMESTAMP '{start} 00:00:00' AS price_start, {until} AS price_end
        FROM part WHERE p_brand <> 'Brand#55' GROUP BY p_brand"""


def _hypothesis(k: int) -> str:
    """The k-th of three hypotheses of each incident."""
    code = ("skew_join_change", "volume_growth", "change_temporal_only")[k]
    return f"""
        SELECT 'inc-' || CAST(event_id AS string) AS incident_id, 'h' || CAST(event_id AS string) || '-{k}' AS hypothesis_id,
               '{code}' AS code, CAST((event_id * {k + 3}) % 100 AS double) / 100 AS confidence, event_id, {k} AS k
        FROM events WHERE event_type = 'error'"""


#: name -> SELECT.
SQL: dict[str, str] = {
    "runs": """
        SELECT CAST(o_orderkey AS string) AS run_id, 'job-' || CAST(o_custkey % 20 AS string) AS job_id,
               '[dev x] Job-' || CAST(o_custkey % 20 AS string) || CASE WHEN o_custkey % 3 = 0 THEN '-prod' ELSE '' END AS job_name,
               o_orderdate + INTERVAL '1' MINUTE * CAST(o_orderkey % 1440 AS int) AS start_time,
               o_orderdate + INTERVAL '1' MINUTE * CAST(o_orderkey % 1440 AS int) + INTERVAL '1' SECOND * CAST(o_orderkey % 180 + 40 AS int) AS end_time,
               CAST(40 + (CAST(floor(o_totalprice) AS bigint) % 7919) / 400.0 + CASE WHEN o_orderkey % 29 = 0 THEN 300 ELSE 0 END AS double) AS execution_s,
               CAST(o_orderkey % 180 AS double) AS setup_s,
               CAST(40 + o_orderkey % 180 AS double) AS duration_s,
               CASE WHEN o_orderkey % 3 = 0 THEN CAST(4800000 AS bigint) WHEN o_orderkey % 3 = 1 THEN CAST(6000000 AS bigint) ELSE CAST(60000000 AS bigint) END AS input_rows,
               CASE WHEN o_orderkey % 17 <> 0 THEN 'SUCCESS' ELSE 'FAILED' END AS result_state,
               'sha' || CAST(o_orderkey % 7 AS string) || '00000' AS git_sha,
               CAST(1 + o_orderkey % 12 AS double) AS skew_ratio
        FROM orders""",
    "usage": """
        SELECT 'u' || CAST(l_orderkey AS string) || '-' || CAST(l_linenumber AS string) AS usage_id, p_brand AS sku_name,
               CAST(l_quantity AS bigint) AS usage_quantity, l_shipdate AS usage_start, l_shipdate + INTERVAL '1' HOUR AS usage_end,
               CASE WHEN l_linenumber % 4 = 1 THEN 'job-' || CAST(l_suppkey % 20 AS string) END AS job_id,
               CASE WHEN l_linenumber % 4 = 1 THEN CAST(l_orderkey AS string) END AS run_id,
               CASE WHEN l_linenumber % 4 = 2 THEN 'pipe-' || CAST(l_suppkey % 5 AS string) END AS pipeline_id,
               CASE WHEN l_linenumber % 4 = 3 THEN 'wh-' || CAST(l_suppkey % 5 AS string) END AS warehouse_id,
               CASE WHEN l_linenumber % 8 = 4 THEN 'app-' || CAST(l_suppkey % 3 AS string) END AS app_id
        FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "prices": " UNION ALL ".join(_price_period(k) for k in range(3)),
    "edges": """
        SELECT source, target, entity_type, entity_id, seen FROM (
            SELECT 'region.' || CAST(n_regionkey AS string) AS source, 'nation.' || CAST(n_nationkey AS string) AS target, 'pipeline' AS entity_type, 'p' || CAST(n_nationkey AS string) AS entity_id, TIMESTAMP '2024-01-20 00:00:00' AS seen FROM nation
            UNION ALL
            SELECT 'nation.' || CAST(s_nationkey AS string), 'supplier.' || CAST(s_suppkey AS string), CASE WHEN s_suppkey % 4 = 0 THEN 'dashboard' WHEN s_suppkey % 4 = 1 THEN 'job' WHEN s_suppkey % 4 = 2 THEN 'pipeline' ELSE '' END, CASE WHEN s_suppkey % 4 = 3 THEN '' ELSE 'e' || CAST(s_suppkey AS string) END, TIMESTAMP '2024-01-25 00:00:00' - INTERVAL '1' DAY * CAST(s_suppkey % 60 AS int) FROM supplier
            UNION ALL
            SELECT 'supplier.' || CAST(l_suppkey AS string), CASE WHEN l_partkey % 9 = 0 THEN '' ELSE 'part.' || CAST(l_partkey AS string) END, CASE WHEN l_partkey % 9 = 0 THEN 'dashboard' ELSE 'job' END, 'x' || CAST(l_partkey % 50 AS string), TIMESTAMP '2024-01-28 00:00:00' FROM lineitem
            UNION ALL
            SELECT 'supplier.' || CAST(s_suppkey AS string), 'region.' || CAST(s_suppkey % 5 AS string), 'pipeline', 'back', TIMESTAMP '2024-01-15 00:00:00' FROM supplier WHERE s_suppkey % 10 = 0) AS e""",
    "observations": """
        SELECT CAST(event_id AS string) AS id, event_type AS type, 'job/' || CAST(user_id % 50 AS string) AS subject, ts AS time, value, props AS data, event_id, user_id FROM events""",
    "incidents": """
        SELECT 'inc-' || CAST(event_id AS string) AS incident_id, 'job-' || CAST(user_id % 25 AS string) AS subject,
               CASE WHEN event_id % 4 = 0 THEN 'runtime_regression' WHEN event_id % 4 = 1 THEN 'contract_violation' WHEN event_id % 4 = 2 THEN 'cost_regression' ELSE 'sla_risk' END AS type,
               CASE WHEN event_id % 5 = 0 THEN 'recovered' WHEN event_id % 5 = 1 THEN 'closed' WHEN event_id % 5 = 2 THEN 'triaged' ELSE 'detected' END AS state,
               CASE WHEN event_id % 7 = 0 THEN 'critical' WHEN event_id % 7 = 1 THEN 'blocking' WHEN event_id % 7 = 2 THEN 'info' WHEN event_id % 7 = 3 THEN 'high' ELSE 'warning' END AS severity,
               ts AS detected_at, ts + INTERVAL '1' MINUTE * CAST(event_id % 4000 AS int) AS updated_at,
               CASE WHEN event_id % 3 = 0 THEN ts + INTERVAL '1' MINUTE * CAST(event_id % 90 AS int) END AS acknowledged_at,
               'asset.' || CAST(user_id % 40 AS string) AS asset, CAST(event_id % 97 AS double) / 100 AS impact_score, event_id, user_id
        FROM events WHERE event_type = 'error'""",
    "queries_log": """
        SELECT 'wh-' || CAST(user_id % 5 AS string) AS warehouse_id, ts AS start_time, CASE WHEN event_id % 50 <> 0 THEN ts + INTERVAL '1' MINUTE * CAST(event_id % 200 AS int) END AS end_time, event_id
        FROM events WHERE event_type IN ('view', 'click')""",
    "dirty_orders": """
        SELECT CASE WHEN o_orderkey % 41 = 0 THEN 41 ELSE o_orderkey END AS order_id, CASE WHEN o_orderkey % 23 = 0 THEN NULL WHEN o_orderkey % 37 = 0 THEN -o_custkey ELSE o_custkey END AS customer_id,
               CASE WHEN o_orderkey % 31 = 0 THEN -o_totalprice WHEN o_orderkey % 29 = 0 THEN NULL ELSE o_totalprice END AS amount, o_orderdate AS order_ts FROM orders""",
    "rule_results": """
        SELECT 'r' || CAST(o_orderkey AS string) AS result_id, 'rule-' || CAST(o_orderkey % 6 AS string) AS rule_id, 'asset.' || CAST(o_custkey % 30 AS string) AS asset,
               CASE WHEN o_orderkey % 4 = 0 THEN 'completeness' WHEN o_orderkey % 4 = 1 THEN 'uniqueness' WHEN o_orderkey % 4 = 2 THEN 'freshness' ELSE 'volume' END AS dimension,
               CASE WHEN o_orderkey % 11 = 0 THEN 'evaluation_error' WHEN o_orderkey % 5 = 0 THEN 'violated' ELSE 'passed' END AS status,
               o_orderkey % 50 AS numerator, CAST(100 AS bigint) AS denominator,
               CASE WHEN o_orderkey % 7 = 0 THEN 'critical' WHEN o_orderkey % 7 = 1 THEN 'blocking' WHEN o_orderkey % 7 = 2 THEN 'info' WHEN o_orderkey % 7 = 3 THEN 'high' ELSE 'warning' END AS severity,
               o_orderdate + INTERVAL '1' SECOND * CAST(o_orderkey % 86400 AS int) AS evaluated_at FROM orders""",
    "changes": """
        SELECT 'c' || CAST(o_orderkey AS string) AS sha, CASE WHEN o_orderkey % 13 = 0 THEN 'renovate[bot]' ELSE 'dev' || CAST(o_custkey % 9 AS string) END AS author,
               o_orderdate + INTERVAL '1' MINUTE * CAST(o_orderkey % 1440 AS int) AS committed_at, 'src/part.' || CAST(o_custkey % 200 AS string) || '.py' AS file,
               CAST(o_orderkey % 14 AS bigint) AS n_files, CASE WHEN o_orderkey % 5 = 0 THEN '+df.join(x)' WHEN o_orderkey % 5 = 1 THEN '+Window.partitionBy(k)' ELSE '+x = 1' END || chr(10) || '-y = 2' || chr(10) || ' z' AS patch,
               CASE WHEN o_orderkey % 19 = 0 THEN 'fix' || chr(10) || 'Co-authored-by: a-bot' ELSE 'work' END AS message FROM orders""",
    "hypotheses": " UNION ALL ".join(_hypothesis(k) for k in range(3)),
    "reviews": """
        SELECT 'h' || CAST(event_id AS string) || '-' || CAST(event_id % 3 AS string) AS hypothesis_id, CASE WHEN event_id % 2 = 0 THEN 'confirmed' ELSE 'rejected' END AS decision, ts AS reviewed_at, event_id
        FROM events WHERE event_type = 'error' AND event_id % 4 <> 0
        UNION ALL SELECT 'h' || CAST(event_id AS string) || '-0', 'rejected', ts + INTERVAL '1' HOUR, event_id FROM events WHERE event_type = 'error' AND event_id % 6 = 0""",
}
#: Tables that each fixture reads.
NEEDS = {"runs": ["orders"], "usage": ["lineitem", "part"], "prices": ["part"], "edges": ["nation", "supplier", "lineitem"], "observations": ["events"], "incidents": ["events"], "queries_log": ["events"], "dirty_orders": ["orders"], "rule_results": ["orders"], "changes": ["orders"], "hypotheses": ["events"], "reviews": ["events"]}
#: The fixed instant that stands for "now" in queries over events, and over orders.
NOW = "2024-01-31 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fixture as a DataFrame: its SELECT over the tables it needs."""
    text = SQL[name]
    args = {}
    for t in NEEDS[name]:
        args[t] = table(spark, sf_dir, t)
    for t in NEEDS[name]:
        for word in ("FROM", "JOIN"):
            text = text.replace(f"{word} {t}", f"{word} {{{t}}}")
    return spark.sql(text, **args)


def with_(*names: str) -> str:
    """The WITH clause that defines fixtures for an oracle."""
    return "WITH " + ", ".join(f"{n} AS ({SQL[n]})" for n in names)
