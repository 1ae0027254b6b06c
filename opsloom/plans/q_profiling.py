"""Queries of profiles, the monitored workload and data-contract rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from opsloom.functions.columns import normalized_job, severity_name, severity_rank, violation_limit, volume_band
from opsloom.operators import profiling as P
from opsloom.operators import quality as Q
from opsloom.operators import workload as WL
from opsloom.plans.fixtures import fixture, table, with_
from opsloom.registry import query


@query("""WITH p AS (SELECT CAST(o_custkey AS string) AS k, count(*) AS n FROM orders GROUP BY 1)
    SELECT CAST(sum(n) AS bigint) AS rows, count(*) AS distinct_keys, max(n) AS max_key_rows, CAST(greatest(quantile_disc(n, 0.5), 1) AS bigint) AS median_key_rows,
    round(max(n) / quantile_disc(n, 0.5), 6) AS skew_ratio, round(max(n) / sum(n), 8) AS top_key_share, (SELECT k FROM p ORDER BY n DESC, k LIMIT 1) AS hot_key FROM p""")
def key_distribution(spark, sf_dir):
    return P.key_distribution(table(spark, sf_dir, "orders"), "o_custkey").withColumn("skew_ratio", F.round("skew_ratio", 6)).withColumn("top_key_share", F.round("top_key_share", 8))


# a plan of one node a line item of an order, some of them twice; the plan of the order before it is the one it is compared with
_NODE = "CASE l_linenumber % 5 WHEN 0 THEN 'Window' WHEN 1 THEN 'SortMergeJoin' WHEN 2 THEN 'HashAggregate' WHEN 3 THEN 'BroadcastHashJoin' ELSE 'Scan' END"
_PLAIN = "('Window', 'SortMergeJoin', 'HashAggregate', 'BroadcastHashJoin')"


@query(f"""WITH n AS (SELECT DISTINCT l_orderkey AS k, CASE WHEN l_partkey % 3 = 0 THEN 'Window' ELSE {_NODE} END AS op FROM lineitem), o AS (SELECT k, list_sort(list(op) FILTER (op IN {_PLAIN})) AS ops FROM n GROUP BY k),
    p AS (SELECT k, coalesce(ops, []) AS ops FROM o)
    SELECT p.k, array_to_string(p.ops, ',') AS operators, array_to_string(list_filter(p.ops, lambda x: NOT list_contains(coalesce(b.ops, []), x)), ',') AS added FROM p LEFT JOIN p AS b ON b.k = p.k - 1""")
def plan_operators(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey k", "l_linenumber n", f"case when l_partkey % 3 = 0 then 'Window' else {_NODE} end op", "l_suppkey s")
    line = "repeat(' ', x.n) || case when x.s % 2 = 0 then '+- ' else '*(' || x.n || ') ' end || x.op || ' [key#' || x.s || ']'"
    nodes = li.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("n", "s", "op"))).alias("nodes"))  # lines are written after the shuffle
    plans = nodes.select("k", F.array_join(F.expr(f"transform(nodes, x -> {line})"), "\n").alias("text"))
    ops = plans.select("k", P.plan_operators(F.col("text")).alias("ops"))
    both = ops.join(ops.select((F.col("k") + 1).alias("k"), F.col("ops").alias("before")), "k", "left")
    added = P.new_operators(F.col("ops"), F.coalesce("before", F.array().cast("array<string>")))
    return both.select("k", F.array_join(F.array_sort("ops"), ",").alias("operators"), F.array_join(F.array_sort(added), ",").alias("added"))


@query("""SELECT CAST(l_orderkey AS string) AS run_id, CASE WHEN count(*) = count(CASE WHEN l_linenumber % 5 <> 4 OR l_orderkey % 3 > 0 THEN 1 END) THEN round(sum(l_linenumber * 100) / 1000, 6) END AS setup_s,
    CASE WHEN count(*) = count(CASE WHEN l_linenumber % 5 <> 4 OR l_orderkey % 3 > 0 THEN 1 END) THEN round(sum(l_quantity * 1000) / 1000, 6) END AS execution_s FROM lineitem GROUP BY 1""")
def run_timing(spark, sf_dir):
    tasks = table(spark, sf_dir, "lineitem").selectExpr("cast(l_orderkey as string) run_id", "l_linenumber * 100 setup_ms", "case when l_linenumber % 5 <> 4 or l_orderkey % 3 > 0 then l_quantity * 1000 end execution_ms")
    return P.run_timing(tasks).withColumn("setup_s", F.round("setup_s", 6)).withColumn("execution_s", F.round("execution_s", 6))


@query(with_("runs") + "SELECT DISTINCT job_name, 'job-' || regexp_extract(job_name, '[0-9]+') AS name FROM runs")
def normalized_job_names(spark, sf_dir):
    return fixture(spark, sf_dir, "runs").select("job_name", normalized_job(F.col("job_name")).alias("name")).distinct()


_CONTRACTS = ", k AS (SELECT 'c' || CAST(c_custkey AS string) AS contract_id, CASE WHEN c_custkey % 4 = 0 THEN 'missing' ELSE 'Job-' || CAST(c_custkey % 20 AS string) END AS producer FROM customer), j AS (SELECT DISTINCT CASE WHEN job_id = 'job-3' THEN job_id || 'x' || CAST(CAST(run_id AS bigint) % 2 AS string) ELSE job_id END AS job_id, 'job-' || regexp_extract(job_name, '[0-9]+') AS name FROM runs), n AS (SELECT name, list_sort(list(job_id)) AS ids FROM j GROUP BY name)"


@query(with_("runs") + _CONTRACTS + " SELECT contract_id, producer, CASE WHEN len(ids) = 1 THEN ids[1] END AS job_id, CASE WHEN ids IS NULL THEN 'not_found' WHEN len(ids) > 1 THEN 'ambiguous' ELSE 'resolved' END AS reason FROM k LEFT JOIN n ON n.name = lower(k.producer)")
def resolved_producers(spark, sf_dir):
    contracts = table(spark, sf_dir, "customer").selectExpr("'c' || c_custkey contract_id", "case when c_custkey % 4 = 0 then 'missing' else 'Job-' || (c_custkey % 20) end producer")
    jobs = fixture(spark, sf_dir, "runs").selectExpr("case when job_id = 'job-3' then job_id || 'x' || (cast(run_id as bigint) % 2) else job_id end job_id", "job_name").distinct()
    return P.resolve_producer(contracts, jobs)


@query(with_("runs") + ", l AS (SELECT job_id, arg_max(result_state, end_time) AS s FROM runs WHERE end_time > TIMESTAMP '1997-06-01 06:00:00' - INTERVAL '6' HOUR AND end_time <= TIMESTAMP '1997-06-01 06:00:00' GROUP BY job_id) SELECT d.job_id, coalesce(s = 'SUCCESS', false) AS succeeded FROM (SELECT DISTINCT job_id FROM runs) AS d LEFT JOIN l ON l.job_id = d.job_id")
def producer_states(spark, sf_dir):
    runs = fixture(spark, sf_dir, "runs")
    return P.producer_states(runs, runs, F.to_timestamp(F.lit("1997-06-01 06:00:00")))


@query(with_("runs") + "SELECT run_id, CAST(floor(log2(input_rows)) AS int) AS band FROM runs")
def volume_bands(spark, sf_dir):
    return fixture(spark, sf_dir, "runs").select("run_id", volume_band(F.col("input_rows")).alias("band"))


@query("""SELECT p_partkey, sha256('{"p_brand":"' || p_brand || '","p_size":' || CAST(p_size AS string) || '}') AS env_hash FROM part""")
def config_hashes(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", P.config_hash(F.struct("p_brand", "p_size")).alias("env_hash"))


@query("SELECT CAST(o_orderkey AS string) AS run_id, CAST(o_custkey % 20 AS string) AS job_id, CAST(o_orderkey % 100 AS double) AS duration_s, CASE WHEN o_orderkey % 3 = 0 THEN 'SUCCESS' ELSE 'UNKNOWN' END AS result_state, 'def' AS mode FROM orders WHERE o_orderkey % 5 <> 0")
def canonical_runs(spark, sf_dir):
    raw = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey run_id", "o_custkey % 20 job_id", "1000000000000 + o_orderkey start_time", "1000000000000 + o_orderkey + (o_orderkey % 100) * 1000 end_time",
        "named_struct('life_cycle_state', case when o_orderkey % 5 = 0 then 'RUNNING' else 'TERMINATED' end, 'result_state', case when o_orderkey % 3 = 0 then 'SUCCESS' end) state",
        "array(named_struct('name', 'mode', 'value', cast(null as string), 'default', 'def')) job_parameters")
    return P.canonical_run(raw).select("run_id", "job_id", "duration_s", "result_state", F.col("job_parameters")["mode"].alias("mode"))


@query(with_("changes") + "SELECT sha, CASE WHEN substr(patch, 1, 3) = '+df' THEN '+df.join(x)' WHEN substr(patch, 1, 2) = '+W' THEN '+Window.partitionBy(k)' ELSE '' END AS patch FROM changes")
def relevant_patches(spark, sf_dir):
    return fixture(spark, sf_dir, "changes").select("sha", P.relevant_patch(F.col("patch")).alias("patch"))


_SALES = """WITH o AS (SELECT o_orderkey AS order_id, o_custkey AS customer_id, o_orderdate AS order_ts, CAST(o_orderdate AS date) AS order_date, o_totalprice AS amount FROM orders),
    c AS (SELECT c_custkey AS customer_id, r_name AS region FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
    s AS (SELECT c_custkey AS customer_id, c_mktsegment AS segment, CAST(c_custkey % 10 AS double) AS discount_pct FROM customer WHERE c_custkey % 7 <> 0)"""


def _sales(spark, sf_dir):
    o = table(spark, sf_dir, "orders").selectExpr("o_orderkey order_id", "o_custkey customer_id", "o_orderdate order_ts", "cast(o_orderdate as date) order_date", "o_totalprice amount")
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).selectExpr("c_custkey customer_id", "r_name region")
    s = table(spark, sf_dir, "customer").filter("c_custkey % 7 <> 0").selectExpr("c_custkey customer_id", "c_mktsegment segment", "cast(c_custkey % 10 as double) discount_pct")
    return o, c, s


_NET = """, j AS (SELECT o.*, region, segment, amount * (1 - discount_pct / 100) AS net FROM o LEFT JOIN c ON c.customer_id = o.customer_id LEFT JOIN s ON s.customer_id = o.customer_id),
    w AS (SELECT *, row_number() OVER b AS seq, sum(net) OVER (PARTITION BY customer_id ORDER BY order_ts) AS running,
                 max(net) OVER (b ROWS BETWEEN 19999 PRECEDING AND CURRENT ROW) AS mx, min(net) OVER (b ROWS BETWEEN 19999 PRECEDING AND CURRENT ROW) AS mn, dense_rank() OVER r AS rk, percent_rank() OVER r AS pct
          FROM j WINDOW b AS (PARTITION BY customer_id ORDER BY order_ts, order_id), r AS (PARTITION BY customer_id ORDER BY net DESC NULLS LAST))
    SELECT CAST(order_date AS string) AS order_date, region, segment, round(sum(net), 4) AS revenue, count(*) AS orders, count(DISTINCT customer_id) AS customers,
           CAST(max(seq) AS int) AS max_seq, round(max(mx), 4) AS max_recent, CAST(max(rk) AS int) AS ticket_levels"""


@query(_SALES + _NET + ", round(max(running), 4) AS max_running, round(min(mn), 4) AS min_recent, round(avg(pct), 6) AS avg_pct FROM w GROUP BY 1, 2, 3")
def sales_daily(spark, sf_dir):
    df = WL.sales_daily(*_sales(spark, sf_dir)).withColumn("order_date", F.col("order_date").cast("string"))
    return df.withColumns({c: F.round(c, 4) for c in ("revenue", "max_running", "max_recent", "min_recent")} | {"avg_pct": F.round("avg_pct", 6)})


@query(_SALES + " SELECT CAST(order_date AS string) AS order_date, region, round(sum(amount), 4) AS revenue, count(*) AS orders, count(DISTINCT o.customer_id) AS customers FROM o LEFT JOIN c ON c.customer_id = o.customer_id GROUP BY 1, 2")
def sales_daily_light(spark, sf_dir):
    o, c, _ = _sales(spark, sf_dir)
    return WL.sales_daily_light(o, c).withColumn("order_date", F.col("order_date").cast("string")).withColumn("revenue", F.round("revenue", 2))


@query(_SALES + _NET + " FROM w GROUP BY 1, 2, 3")
def sales_daily_heavy(spark, sf_dir):
    df = WL.sales_daily_heavy(*_sales(spark, sf_dir)).withColumn("order_date", F.col("order_date").cast("string"))
    return df.withColumns({c: F.round(c, 4) for c in ("revenue", "max_recent")})


@query("""WITH f AS (SELECT o_orderkey % 50 AS sha, o_orderkey % 3 AS k FROM orders GROUP BY 1, 2)
    SELECT sha, string_agg('--- f' || CAST(k AS string) || chr(10) || CASE k WHEN 0 THEN '+df.join(x)' ELSE '-Window.partitionBy(skew)' END, chr(10) ORDER BY k) AS patch FROM f WHERE k < 2 GROUP BY sha""")
def relevant_file_patches(spark, sf_dir):
    files = table(spark, sf_dir, "orders").selectExpr("o_orderkey % 50 sha", "o_orderkey % 3 k").distinct()
    text = "case k when 0 then '+df.join(x)\n+JOIN\n y' when 1 then ' join\n-Window.partitionBy(skew)\n+z' else '+z' end"
    return P.relevant_patch_of_files(files.selectExpr("sha", "'f' || k file", f"{text} patch"))


@query(_SALES + " SELECT CAST(order_date AS string) AS order_date, round(sum(amount), 2) AS revenue FROM o GROUP BY 1")
def revenue_by_day(spark, sf_dir):
    o, c, _ = _sales(spark, sf_dir)
    return WL.revenue_by(WL.sales_daily_light(o, c), "order_date").select(F.col("order_date").cast("string").alias("order_date"), F.round("revenue", 2).alias("revenue"))


@query(_SALES + " SELECT region, round(sum(amount), 1) AS revenue FROM o LEFT JOIN c ON c.customer_id = o.customer_id GROUP BY 1")
def revenue_by_region(spark, sf_dir):
    o, c, _ = _sales(spark, sf_dir)
    return WL.revenue_by(WL.sales_daily_light(o, c), "region").withColumn("revenue", F.round("revenue", 1))


@query(with_("dirty_orders") + """ SELECT rule_id, dimension, CAST(numerator AS bigint) AS numerator, CAST(denominator AS bigint) AS denominator, threshold, CAST(lim AS double) AS lim, round(numerator / denominator, 6) AS ratio, CASE WHEN lim IS NULL THEN 'evaluation_error' WHEN numerator / denominator > lim THEN 'violated' ELSE 'passed' END AS status FROM (
    SELECT 'complete_customer_id' AS rule_id, 'completeness' AS dimension, count(*) - count(customer_id) AS numerator, count(*) AS denominator, '>=99%' AS threshold, 0.01 AS lim FROM dirty_orders
    UNION ALL SELECT 'complete_amount', 'completeness', count(*) - count(amount), count(*), '<=10%', 0.1 FROM dirty_orders
    UNION ALL SELECT 'positive', 'validity', count(CASE WHEN NOT amount > 0 THEN 1 END), count(*), '==0', NULL FROM dirty_orders
    UNION ALL SELECT 'unique_order_id', 'uniqueness', sum(CASE WHEN k > 1 THEN k ELSE 0 END), sum(k), '<=0%', 0 FROM (SELECT order_id, count(*) AS k FROM dirty_orders GROUP BY order_id)
    UNION ALL SELECT 'ref_customer_id', 'referential', count(*) - count(c_custkey), count(*), '<=5%', 0.05 FROM dirty_orders LEFT JOIN customer ON c_custkey = customer_id) AS r""")
def contract_rules(spark, sf_dir):
    df = fixture(spark, sf_dir, "dirty_orders")
    rules = Q.scan_rules(df, {"customer_id": ">=99%", "amount": "<=10%"}, {"positive": ("amount > 0", "==0")})
    rules = rules.unionByName(Q.uniqueness(df, "order_id")).unionByName(Q.referential(df, "customer_id", table(spark, sf_dir, "customer"), "c_custkey", "<=5%"))
    return Q.judged(rules).withColumnRenamed("limit", "lim").withColumn("ratio", F.round("ratio", 6)).withColumn("lim", F.round("lim", 6))


@query("SELECT p_partkey, CAST(CASE p_partkey % 4 WHEN 0 THEN 0.01 WHEN 1 THEN 0.02 WHEN 2 THEN NULL ELSE 0.05 END AS double) AS allowed FROM part")
def violation_limits(spark, sf_dir):
    text = F.expr("case p_partkey % 4 when 0 then '>=99%' when 1 then '<= 2 %' when 2 then '==0' else '>=0.95' end")
    return table(spark, sf_dir, "part").select("p_partkey", violation_limit(text).alias("allowed"))


@query(with_("rule_results") + """, h AS (SELECT asset, median(numerator) AS usual, count(*) AS known FROM (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY evaluated_at DESC, result_id DESC) AS n FROM rule_results WHERE status <> 'evaluation_error') AS x WHERE n <= 10 GROUP BY asset),
    c AS (SELECT 'asset.' || CAST(c_custkey % 35 AS string) AS asset, sum(CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END) AS rows FROM customer GROUP BY 1)
    SELECT c.asset, CAST(c.rows AS bigint) AS rows, h.usual, coalesce(known, 0) AS known, CASE WHEN coalesce(known, 0) < 3 OR usual = 0 OR rows / usual >= 0.5 THEN 'passed' ELSE 'violated' END AS status FROM c LEFT JOIN h ON h.asset = c.asset""")
def volume_rule(spark, sf_dir):
    counts = table(spark, sf_dir, "customer").groupBy(F.expr("'asset.' || cast(c_custkey % 35 as string)").alias("asset")).agg(F.sum(F.expr("case when c_custkey % 3 = 0 then 1 else 0 end")).alias("rows"))
    return Q.volume_rule(counts, fixture(spark, sf_dir, "rule_results"))


@query(with_("observations") + """, w AS (SELECT subject AS asset, max(time) AS last_write FROM observations WHERE user_id % 3 <> 0 GROUP BY 1), l AS (SELECT DISTINCT subject AS asset, CAST(3600 * (1 + user_id % 50) AS bigint) AS limit_s FROM observations)
    SELECT l.asset, l.limit_s, CAST(epoch(TIMESTAMP '2024-01-31 00:00:00') - floor(epoch(last_write)) AS bigint) AS age_s, CASE WHEN epoch(TIMESTAMP '2024-01-31 00:00:00') - floor(epoch(last_write)) <= l.limit_s THEN 'passed' ELSE 'violated' END AS status FROM l LEFT JOIN w ON w.asset = l.asset""")
def freshness_rule(spark, sf_dir):
    o = fixture(spark, sf_dir, "observations")
    writes = o.filter("user_id % 3 <> 0").selectExpr("subject asset", "time timestamp")
    limits = o.selectExpr("subject asset", "cast(3600 * (1 + user_id % 50) as bigint) limit_s").distinct()
    return Q.freshness_rule(writes, limits, F.to_timestamp(F.lit("2024-01-31 00:00:00"))).drop("last_write")


_TYPES = "WITH c AS (SELECT 'a' || CAST(CAST(floor(c_custkey / 37) AS bigint) AS string) AS asset, 'col' || CAST(c_custkey % 37 AS string) AS column_name, CASE WHEN c_custkey % 2 = 0 THEN 'integer' ELSE 'DECIMAL(10,2)' END AS w FROM customer WHERE c_custkey % 5 <> 0), a AS (SELECT 'a' || CAST(CAST(floor(c_custkey / 37) AS bigint) AS string) AS asset, 'COL' || CAST(c_custkey % 37 AS string) AS column_name, CASE WHEN c_custkey % 2 = 0 THEN CASE WHEN c_custkey % 16 = 0 THEN 'text' ELSE 'int' END ELSE 'decimal(18,4)' END AS h FROM customer WHERE c_custkey % 7 <> 0)"


@query(_TYPES + """, j AS (SELECT coalesce(c.asset, a.asset) AS asset, CASE w WHEN 'integer' THEN 'int' WHEN 'DECIMAL(10,2)' THEN 'decimal' END AS want, CASE h WHEN 'text' THEN 'string' WHEN 'int' THEN 'int' WHEN 'decimal(18,4)' THEN 'decimal' END AS have FROM c FULL JOIN a ON a.asset = c.asset AND lower(a.column_name) = c.column_name)
    SELECT asset, count(CASE WHEN want = have THEN 1 END) AS numerator, count(want) AS denominator, count(CASE WHEN have IS NULL THEN 1 END) AS missing, count(CASE WHEN want <> have THEN 1 END) AS mismatched, count(CASE WHEN want IS NULL THEN 1 END) AS extra, 'conformance' AS ratio_kind, CASE WHEN count(CASE WHEN have IS NULL OR want <> have THEN 1 END) > 0 THEN 'violated' ELSE 'passed' END AS status FROM j GROUP BY asset""")
def schema_rule(spark, sf_dir):
    t = table(spark, sf_dir, "customer")
    c = t.filter("c_custkey % 5 <> 0").selectExpr("'a' || floor(c_custkey / 37) asset", "'col' || (c_custkey % 37) column_name", "case when c_custkey % 2 = 0 then 'integer' else 'DECIMAL(10,2)' end data_type")
    a = t.filter("c_custkey % 7 <> 0").selectExpr("'a' || floor(c_custkey / 37) asset", "'COL' || (c_custkey % 37) column_name", "case when c_custkey % 2 = 0 then case when c_custkey % 16 = 0 then 'text' else 'int' end else 'decimal(18,4)' end data_type")
    return Q.schema_rule(c, a)


_LATEST = with_("rule_results") + ", latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY asset, rule_id ORDER BY evaluated_at DESC, result_id DESC) AS n FROM rule_results) AS x WHERE n = 1)"


@query(_LATEST + " SELECT asset, rule_id, result_id, status FROM latest")
def latest_per_rule(spark, sf_dir):
    return Q.latest_per_rule(fixture(spark, sf_dir, "rule_results")).select("asset", "rule_id", "result_id", "status")


_LADDER = "CASE severity WHEN 'blocking' THEN 4 WHEN 'critical' THEN 3 WHEN 'high' THEN 2 WHEN 'warning' THEN 1 ELSE 0 END"


@query(_LATEST + f""" SELECT asset, count(*) AS n, ['info', 'warning', 'high', 'critical', 'blocking'][max({_LADDER}) + 1] AS severity, count(CASE WHEN severity = 'blocking' THEN 1 END) AS blocking, CAST(count(*) AS string) || ' rule(s): ' || array_to_string(list_sort(list(rule_id)), ', ') AS summary FROM latest WHERE status = 'violated' GROUP BY asset""")
def grouped_violations(spark, sf_dir):
    return Q.group_violations(Q.latest_per_rule(fixture(spark, sf_dir, "rule_results"))).drop("rules")


@query(_LATEST + f""" SELECT asset, count(*) AS n, ['info', 'warning', 'high', 'critical', 'blocking'][max({_LADDER}) + 1] AS severity, count(CASE WHEN severity = 'blocking' THEN 1 END) AS blocking, CAST(count(*) AS string) || ' rule(s): ' || array_to_string(list_sort(list(rule_id)), ', ') AS summary FROM latest WHERE status = 'evaluation_error' GROUP BY asset""")
def grouped_errors(spark, sf_dir):
    return Q.group_violations(Q.latest_per_rule(fixture(spark, sf_dir, "rule_results")), "evaluation_error").drop("rules")


@query(with_("rule_results") + " SELECT result_id FROM rule_results WHERE evaluated_at > TIMESTAMP '1996-03-01 12:00:00' - INTERVAL '240' HOUR AND evaluated_at <= TIMESTAMP '1996-03-01 12:00:00'")
def recent_results(spark, sf_dir):
    return Q.recent_results(fixture(spark, sf_dir, "rule_results"), F.to_timestamp(F.lit("1996-03-01 12:00:00")), 240).select("result_id")


@query("WITH b AS (SELECT o_orderkey, o_orderdate AS observed_at FROM orders) SELECT o_orderkey FROM b WHERE observed_at = (SELECT max(observed_at) FROM b) AND observed_at > (SELECT max(observed_at) FROM b) - INTERVAL '6' HOUR")
def latest_batch(spark, sf_dir):
    b = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "o_orderdate observed_at")
    now = b.agg(F.max("observed_at")).first()[0]
    return Q.latest_batch(b, F.lit(now)).select("o_orderkey")


@query(f"WITH s AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'critical' WHEN o_orderkey % 3 = 1 THEN 'odd' ELSE 'high' END AS severity FROM orders) SELECT o_orderkey, CAST({_LADDER} AS int) AS rank, least(CAST({_LADDER} AS int), 2) AS capped, ['info', 'warning', 'high', 'critical', 'blocking'][{_LADDER} + 1] AS name FROM s")
def severity_ranks(spark, sf_dir):
    s = F.expr("case when o_orderkey % 3 = 0 then 'critical' when o_orderkey % 3 = 1 then 'odd' else 'high' end")
    return table(spark, sf_dir, "orders").select("o_orderkey", severity_rank(s).alias("rank"), severity_rank(s, "high").alias("capped"), severity_name(severity_rank(s)).alias("name"))


@query(with_("dirty_orders") + ", b AS (SELECT CASE WHEN amount IS NULL THEN -1 WHEN amount < 0 THEN 0 WHEN amount < 100000 THEN 1 WHEN amount < 300000 THEN 2 ELSE 3 END AS bin FROM dirty_orders) SELECT bin, count(*) AS n, round(count(*) / (SELECT count(*) FROM b), 8) AS share FROM b GROUP BY bin")
def distribution_rule(spark, sf_dir):
    return Q.distribution_rule(fixture(spark, sf_dir, "dirty_orders"), "amount", [0.0, 100000.0, 300000.0]).withColumn("share", F.round("share", 8))


@query("WITH a AS (SELECT o_custkey AS k, sum(o_totalprice) AS x FROM orders GROUP BY 1), b AS (SELECT o_custkey AS k, sum(o_totalprice) AS y FROM orders WHERE o_orderkey % 11 <> 0 GROUP BY 1) SELECT a.k AS k, round(coalesce(x, 0) - coalesce(y, 0), 2) AS gap FROM a LEFT JOIN b ON b.k = a.k WHERE abs(coalesce(x, 0) - coalesce(y, 0)) > 1000")
def reconciliation_rule(spark, sf_dir):
    o = table(spark, sf_dir, "orders").selectExpr("o_custkey k", "o_totalprice v", "o_orderkey")
    return Q.reconciliation_rule(o, o.filter("o_orderkey % 11 <> 0"), ["k"], "v", 1000.0).select("k", F.round("gap", 2).alias("gap"))
