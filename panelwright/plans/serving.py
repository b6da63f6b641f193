"""Serving reads: portfolio, pages, scope, checklists, clusters, forecasts, accuracy."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from panelwright.functions.scalars import case_chain, three_state
from panelwright.operators import aggregates as A
from panelwright.operators import serving as S
from panelwright.operators import windows
from panelwright.plans.registry import query
from panelwright.sources.tables import read


def current(spark, sf_dir):
    """One row a customer: place, balance, orders and last order."""
    orders = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count("*").alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.max("o_orderdate").alias("last_order"), F.count_if(F.col("o_orderstatus") == "O").alias("n_open")
    )
    places = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return read(spark, sf_dir, "customer").join(orders, "c_custkey", "left").join(places, F.col("c_nationkey") == F.col("n_nationkey"), "left")


CURRENT_SQL = """cur AS (SELECT c.*, o.*, n_name, n_regionkey, r_name FROM customer c LEFT JOIN (SELECT o_custkey, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total, max(o_orderdate) AS last_order, count(*) FILTER (WHERE o_orderstatus = 'O') AS n_open FROM orders GROUP BY 1) o ON o_custkey = c_custkey
  LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey)"""


@query("serve_current", f"WITH {CURRENT_SQL} SELECT c_custkey, n_name, r_name, c_acctbal, n_orders, total, last_order, n_open FROM cur")
def serve_current(spark, sf_dir):
    return current(spark, sf_dir).select("c_custkey", "n_name", "r_name", "c_acctbal", "n_orders", "total", "last_order", "n_open")


@query("serve_page", f"WITH {CURRENT_SQL} SELECT c_custkey, total FROM cur WHERE r_name = (SELECT min(r_name) FROM region) AND n_orders BETWEEN 5 AND 20 ORDER BY total DESC NULLS LAST, c_custkey LIMIT 25 OFFSET 25")
def serve_page(spark, sf_dir):
    """Second page of a filtered list; the page is the feature."""
    region = read(spark, sf_dir, "region").agg(F.min("r_name").alias("r_name"))
    rows = S.where(current(spark, sf_dir), between={"n_orders": (5, 20)}, among={"r_name": region})
    return S.page(rows, {"total": F.col("total"), "orders": F.col("n_orders")}, "total", "c_custkey", 2, 25).select("c_custkey", "total")


@query(
    "serve_portfolio",
    f"""WITH {CURRENT_SQL} SELECT coalesce(r_name, '*') AS region, coalesce(c_mktsegment, '*') AS segment, count(*) AS customers, CAST(sum(coalesce(n_orders, 0)) AS BIGINT) AS orders, round(sum(total), 2) AS total, round(median(c_acctbal), 4) AS median_balance
    FROM cur GROUP BY GROUPING SETS ((r_name), (c_mktsegment), ())""",
)
def serve_portfolio(spark, sf_dir):
    by = current(spark, sf_dir).groupingSets([["r_name"], ["c_mktsegment"], []], "r_name", "c_mktsegment").agg(
        F.count("*").alias("customers"), F.sum(F.coalesce("n_orders", F.lit(0))).alias("orders"), F.round(F.sum("total"), 2).alias("total"), F.round(F.percentile("c_acctbal", 0.5), 4).alias("median_balance")
    )
    return by.select(F.coalesce("r_name", F.lit("*")).alias("region"), F.coalesce("c_mktsegment", F.lit("*")).alias("segment"), "customers", "orders", "total", "median_balance")


@query(
    "serve_scope",
    f"WITH {CURRENT_SQL} SELECT c_nationkey, c_mktsegment, count(*) AS n FROM cur WHERE (c_nationkey, c_mktsegment) IN (SELECT s_nationkey, 'BUILDING' FROM supplier WHERE s_acctbal > 5000) GROUP BY 1, 2",
)
def serve_scope(spark, sf_dir):
    grants = read(spark, sf_dir, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("c_nationkey"), F.lit("BUILDING").alias("c_mktsegment"))
    return S.in_scope(current(spark, sf_dir), grants, ["c_nationkey", "c_mktsegment"]).groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n"))


@query("serve_in_order", "SELECT c_custkey, CAST(CASE c_custkey WHEN 7 THEN 0 WHEN 3 THEN 1 WHEN 99 THEN 2 END AS INTEGER) AS place FROM customer WHERE c_custkey IN (7, 3, 99)")
def serve_in_order(spark, sf_dir):
    return S.in_order(read(spark, sf_dir, "customer"), "c_custkey", [7, 3, 99]).select("c_custkey", "place")


@query(
    "serve_checklist",
    f"""WITH {CURRENT_SQL}, t AS (SELECT c_custkey, unnest([{{'d': 'balance', 's': CASE WHEN coalesce(c_acctbal < 0, false) THEN 'flagged' WHEN coalesce(c_acctbal >= 0, false) THEN 'clear' ELSE 'unknown' END, 'e': CAST(n_orders AS VARCHAR)}},
      {{'d': 'open orders', 's': CASE WHEN coalesce(n_open >= 8, false) THEN 'flagged' WHEN coalesce(n_open < 4, false) THEN 'clear' ELSE 'unknown' END, 'e': CAST(n_open AS VARCHAR)}},
      {{'d': 'idle', 's': CASE WHEN coalesce(last_order < TIMESTAMP '1998-01-01', false) THEN 'flagged' WHEN coalesce(last_order >= TIMESTAMP '1998-01-01', false) THEN 'clear' ELSE 'unknown' END, 'e': CAST(year(last_order) AS VARCHAR)}}]) AS r FROM cur)
    SELECT c_custkey, r.d AS dimension, r.s AS state, r.e AS evidence FROM t""",
)
def serve_checklist(spark, sf_dir):
    idle = F.col("last_order") < "1998-01-01"
    items = [
        ("balance", three_state(F.col("c_acctbal") < 0, F.col("c_acctbal") >= 0), F.col("n_orders")),
        ("open orders", three_state(F.col("n_open") >= 8, F.col("n_open") < 4), F.col("n_open")),
        ("idle", three_state(idle, ~idle), F.year("last_order")),
    ]
    return S.checklist(current(spark, sf_dir), "c_custkey", items)


@query(
    "serve_flags_wide",
    f"WITH {CURRENT_SQL} SELECT c_custkey, coalesce(c_acctbal < 0, false) AS balance, coalesce(n_open >= 8, false) AS open_orders FROM cur",
)
def serve_flags_wide(spark, sf_dir):
    """The checklist, pivoted to a flag a column."""
    items = [("balance", three_state(F.col("c_acctbal") < 0, F.lit(True)), F.lit("")), ("open_orders", three_state(F.col("n_open") >= 8, F.lit(True)), F.lit(""))]
    long = S.checklist(current(spark, sf_dir), "c_custkey", items)
    return long.groupBy("c_custkey").pivot("dimension", ["balance", "open_orders"]).agg(F.bool_or(F.col("state") == "flagged"))


@query(
    "serve_clusters",
    """WITH m AS (SELECT l_suppkey, l_returnflag, l_linestatus, l_quantity FROM lineitem WHERE l_discount > 0.08)
    SELECT l_returnflag, l_linestatus, count(DISTINCT l_suppkey) AS n_members, round(avg(l_quantity), 6) AS severity, min(l_suppkey) AS first_member, 'BN-' || substr(sha1(l_returnflag || '|' || l_linestatus), 1, 10) AS cluster_id FROM m GROUP BY 1, 2 HAVING count(DISTINCT l_suppkey) >= 3""",
)
def serve_clusters(spark, sf_dir):
    members = read(spark, sf_dir, "lineitem").where("l_discount > 0.08")
    return S.clusters(members, "l_suppkey", ["l_returnflag", "l_linestatus"], "l_quantity", 3)


@query(
    "serve_top_members",
    f"WITH {CURRENT_SQL} SELECT r_name, c_custkey, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY r_name ORDER BY total DESC NULLS LAST, c_custkey) AS place FROM cur) WHERE place <= 5",
)
def serve_top_members(spark, sf_dir):
    return S.top_members(current(spark, sf_dir), ["r_name"], F.col("total"), "c_custkey", 5).select("r_name", "c_custkey", "place")


@query(
    "serve_case_order",
    "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 0 WHEN o_orderstatus = 'O' AND o_totalprice > 100000 THEN 1 WHEN o_orderstatus = 'O' THEN 2 ELSE 3 END AS lane FROM orders",
)
def serve_case_order(spark, sf_dir):
    s = F.col("o_orderstatus")
    lane = case_chain([(s == "P", 0), ((s == "O") & (F.col("o_totalprice") > 100000), 1), (s == "O", 2)], 3)
    return read(spark, sf_dir, "orders").select("o_orderkey", lane.alias("lane"))


@query(
    "serve_fair_batch",
    f"WITH {CURRENT_SQL}, r AS (SELECT *, c_custkey % 4 = 0 AS w, row_number() OVER (PARTITION BY c_custkey % 4 = 0 ORDER BY last_order ASC NULLS FIRST, c_acctbal DESC NULLS LAST, c_custkey) AS p FROM cur) SELECT c_custkey FROM r ORDER BY CASE WHEN w AND p <= 5 THEN 0 ELSE 1 END, last_order ASC NULLS FIRST, c_acctbal DESC NULLS LAST, c_custkey LIMIT 10",
)
def serve_fair_batch(spark, sf_dir):
    return S.fair_batch(current(spark, sf_dir), "c_custkey", F.col("c_custkey") % 4 == 0, "last_order", F.col("c_acctbal"), 10).select("c_custkey")


@query(
    "serve_scenarios",
    f"""WITH {CURRENT_SQL}, h AS (SELECT r_name, avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0 END) / 10 AS hz FROM orders JOIN cur ON cur.c_custkey = orders.o_custkey GROUP BY 1)
    SELECT r_name, CAST(step AS INTEGER) AS step, round(1 - power(1 - hz, step), 9) AS p FROM h CROSS JOIN range(1, 9) t(step)""",
)
def serve_scenarios(spark, sf_dir):
    """Chance of the event within 1 to 8 quarters at a region's hazard."""
    orders = read(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey").join(current(spark, sf_dir).select("c_custkey", "r_name"), "c_custkey")
    hazard = orders.groupBy("r_name").agg((F.avg((F.col("o_orderstatus") == "F").cast("double")) / 10).alias("hz"))
    steps = hazard.select("r_name", "hz", F.explode(F.sequence(F.lit(1), F.lit(8))).alias("step"))
    return steps.select("r_name", "step", F.round(windows.survival(F.col("hz"), ["r_name"], "step"), 9).alias("p"))


@query(
    "serve_live_accuracy",
    """WITH t AS (SELECT year(o_orderdate) AS y, floor(o_totalprice / 5000) / 100 AS p, (o_orderstatus = 'F')::INT AS hit FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01'), g AS (SELECT y, p, count(*) AS n, sum(hit) AS pos FROM t GROUP BY 1, 2),
    c AS (SELECT *, sum(n) OVER (PARTITION BY y ORDER BY p DESC) AS cn, sum(pos) OVER (PARTITION BY y ORDER BY p DESC) AS cp FROM g) SELECT CAST(y AS INTEGER) AS y, round(sum(pos * cp / cn) / sum(pos), 9) AS ap FROM c GROUP BY y""",
)
def serve_live_accuracy(spark, sf_dir):
    """Average precision of the logged scores of each cohort whose outcome is known."""
    scored = read(spark, sf_dir, "orders").where("o_orderdate < '1998-01-01'").select(F.year("o_orderdate").alias("y"), (F.floor(F.col("o_totalprice") / 5000) / 100).alias("p"), (F.col("o_orderstatus") == "F").alias("hit"))
    return A.average_precision(scored, ["y"], "p", "hit").select("y", F.round("ap", 9).alias("ap"))


@query(
    "serve_agency_matrix",
    """WITH t AS (SELECT l_suppkey AS a, avg(l_discount) AS m, count(*) AS n, median(l_quantity) AS q FROM lineitem GROUP BY 1), g AS (SELECT sum(m * n) / sum(n) AS prior FROM t)
    SELECT a, n, round(CASE WHEN n < 700 THEN prior + (m - prior) * n / (n + 700.0) ELSE m END, 9) AS rate, round(q, 6) AS q, n < 560 AS hidden FROM t CROSS JOIN g""",
)
def serve_agency_matrix(spark, sf_dir):
    """Suppliers' rates, shrunk where rows are few and hidden where they are very few."""
    by = read(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("a")).agg(F.avg("l_discount").alias("m"), F.count("*").alias("n"), F.percentile("l_quantity", 0.5).alias("q"))
    prior = by.agg((F.sum(F.col("m") * F.col("n")) / F.sum("n")).alias("prior"))
    m, n, p = F.col("m"), F.col("n"), F.col("prior")
    rate = F.when(n < 700, p + (m - p) * n / (n + 700.0)).otherwise(m)
    return by.crossJoin(F.broadcast(prior)).select("a", "n", F.round(rate, 9).alias("rate"), F.round("q", 6).alias("q"), (n < 560).alias("hidden"))


@query(
    "serve_feed_heat",
    """WITH now AS (SELECT max(ts) AS now FROM events), f AS (SELECT user_id, event_type FROM events CROSS JOIN now WHERE ts > now - INTERVAL 30 DAY AND event_type <> 'view')
    SELECT coalesce(event_type, '*') AS category, count(*) AS n, count(DISTINCT user_id) AS users FROM f GROUP BY GROUPING SETS ((event_type), ())""",
)
def serve_feed_heat(spark, sf_dir):
    events = read(spark, sf_dir, "events")
    now = F.broadcast(events.agg(F.max("ts").alias("now")))
    recent = events.crossJoin(now).where((F.col("ts") > F.col("now") - F.expr("interval 30 days")) & (F.col("event_type") != "view"))
    by = recent.groupingSets([["event_type"], []], "event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))
    return by.select(F.coalesce("event_type", F.lit("*")).alias("category"), "n", "users")


@query(
    "serve_lead_time",
    """WITH f AS (SELECT user_id, min(ts) FILTER (WHERE event_type = 'error') AS flagged FROM events GROUP BY 1), l AS (SELECT f.user_id, flagged, min(ts) AS hit FROM f LEFT JOIN events e ON e.user_id = f.user_id AND e.event_type = 'purchase' AND e.ts > flagged GROUP BY 1, 2)
    SELECT user_id, date_diff('day', CAST(flagged AS DATE), CAST(hit AS DATE)) AS days FROM l WHERE flagged IS NOT NULL""",
)
def serve_lead_time(spark, sf_dir):
    """Days from a user's first error to the next purchase."""
    events = read(spark, sf_dir, "events")
    flagged = F.min(F.when(F.col("event_type") == "error", F.col("ts"))).over(Window.partitionBy("user_id"))
    after = events.withColumn("flagged", flagged).where("flagged IS NOT NULL")
    by = after.groupBy("user_id").agg(F.min("flagged").alias("flagged"), F.min(F.when((F.col("event_type") == "purchase") & (F.col("ts") > F.col("flagged")), F.col("ts"))).alias("hit"))
    return by.select("user_id", F.datediff("hit", "flagged").cast("long").alias("days"))


@query(
    "serve_high_water_marks",
    "SELECT 'orders' AS name, max(o_orderkey) AS high, count(*) AS n FROM orders UNION ALL SELECT 'events', max(event_id), count(*) FROM events",
)
def serve_high_water_marks(spark, sf_dir):
    mark = lambda name, key: read(spark, sf_dir, name).agg(F.max(key).alias("high"), F.count("*").alias("n")).select(F.lit(name).alias("name"), "high", "n")
    return mark("orders", "o_orderkey").unionByName(mark("events", "event_id"))
