"""Running, filling, run-length and ranking queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from panelwright.operators import relational, windows
from panelwright.plans.panel import PANEL_SQL, panel
from panelwright.plans.registry import query
from panelwright.sources.tables import read

_W = "(PARTITION BY user_id ORDER BY ts, event_id)"


@query(
    "win_fill",
    """SELECT event_id, last_value(CASE WHEN value > 50 THEN value END IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS filled,
      last_value(CASE WHEN value > 50 THEN value END IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous,
      CAST(count(*) FILTER (WHERE event_type = 'purchase') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS purchases
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""",
)
def win_fill(spark, sf_dir):
    w = windows.ordered(["user_id"], "ts", "event_id")
    high = F.when(F.col("value") > 50, F.col("value"))
    bought = (F.col("event_type") == "purchase").cast("long")
    return read(spark, sf_dir, "events").select("event_id", windows.forward_fill(high, w).alias("filled"), windows.previous_known(high, w).alias("previous"), windows.running(bought, w).alias("purchases"))


@query(
    "win_lag_lead",
    """SELECT event_id, lag(event_type) OVER w AS before, lead(event_type) OVER w AS after, value - lag(value) OVER w AS change,
      event_type = lag(event_type) OVER w AS same FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""",
)
def win_lag_lead(spark, sf_dir):
    w = windows.ordered(["user_id"], "ts", "event_id")
    before = F.lag("event_type").over(w)
    return read(spark, sf_dir, "events").select("event_id", before.alias("before"), F.lead("event_type").over(w).alias("after"), (F.col("value") - F.lag("value").over(w)).alias("change"), (F.col("event_type") == before).alias("same"))


@query(
    "win_since_event",
    f"""WITH {PANEL_SQL} SELECT k, q, CAST(q - coalesce(last_value(CASE WHEN done THEN q END IGNORE NULLS) OVER (PARTITION BY k ORDER BY q), first_value(q) OVER (PARTITION BY k ORDER BY q)) AS INTEGER) AS since FROM panel""",
)
def win_since_event(spark, sf_dir):
    return panel(spark, sf_dir).select("k", "q", windows.since_event(F.col("done"), F.col("q"), windows.ordered(["k"], "q")).alias("since"))


@query(
    "win_run_length",
    f"""WITH {PANEL_SQL}, b AS (SELECT k, q, q - lag(q) OVER w AS gap, coalesce(x < lag(x) OVER w, false) AS going FROM panel WINDOW w AS (PARTITION BY k ORDER BY q)),
    i AS (SELECT *, sum(CASE WHEN going THEN 0 ELSE 1 END) OVER (PARTITION BY k ORDER BY q) AS run FROM b)
    SELECT k, q, CAST(coalesce(sum(CASE WHEN going THEN gap END) OVER (PARTITION BY k, run ORDER BY q), 0) AS BIGINT) AS falling FROM i""",
)
def win_run_length(spark, sf_dir):
    w = windows.ordered(["k"], "q")
    rows = panel(spark, sf_dir).select("k", "q", (F.col("q") - F.lag("q").over(w)).alias("gap"), (F.col("x") < F.lag("x").over(w)).alias("going"))
    return windows.run_length(rows, ["k"], "q", F.col("gap"), F.col("going"), "falling").select("k", "q", "falling")


@query(
    "win_islands",
    """WITH b AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 3 DAY THEN 0 ELSE 1 END AS br FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    i AS (SELECT *, sum(br) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM b)
    SELECT user_id, CAST(island AS BIGINT) AS island, count(*) AS n, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END)::BIGINT AS errors, round(max(value), 6) AS top FROM i GROUP BY 1, 2""",
)
def win_islands(spark, sf_dir):
    """Bursts of a user's events, closed by three days without any."""
    w = windows.ordered(["user_id"], "ts", "event_id")
    rows = read(spark, sf_dir, "events").withColumn("breaks", ~F.coalesce(F.col("ts") - F.lag("ts").over(w) <= F.expr("interval 3 days"), F.lit(False)))
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    numbered = rows.withColumn("island", F.sum(F.col("breaks").cast("long")).over(upto))
    return numbered.groupBy("user_id", "island").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"), F.round(F.max("value"), 6).alias("top"))


@query(
    "win_consecutive_runs",
    f"WITH {PANEL_SQL}, r AS (SELECT k, q, q - row_number() OVER (PARTITION BY k ORDER BY q) AS run FROM panel) SELECT k, min(q) AS first, max(q) AS last, count(*) AS length FROM r GROUP BY k, run",
)
def win_consecutive_runs(spark, sf_dir):
    return windows.consecutive_runs(panel(spark, sf_dir), ["k"], "q")


@query(
    "win_range_days",
    """SELECT event_id, round(avg(value) OVER w, 9) AS mean, count(*) OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY epoch(date_trunc('second', ts))::BIGINT RANGE BETWEEN 864000 PRECEDING AND CURRENT ROW)""",
)
def win_range_days(spark, sf_dir):
    mean = windows.trailing_days(F.col("value"), ["user_id"], "ts", 10, F.avg)
    n = windows.trailing_days(F.lit(1), ["user_id"], "ts", 10, F.count)
    return read(spark, sf_dir, "events").select("event_id", F.round(mean, 9).alias("mean"), n.alias("n"))


@query(
    "win_rate_limit",
    """SELECT event_id, count(*) OVER w AS hits, count(*) OVER w > 3 AS limited FROM events
    WINDOW w AS (PARTITION BY user_id ORDER BY epoch(date_trunc('second', ts))::BIGINT RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW)""",
)
def win_rate_limit(spark, sf_dir):
    return windows.rate_limit(read(spark, sf_dir, "events"), ["user_id"], "ts", 86400, 3).select("event_id", "hits", "limited")


@query("win_group_median", "SELECT o_orderkey, median(o_totalprice) OVER (PARTITION BY o_orderpriority) AS middle FROM orders")
def win_group_median(spark, sf_dir):
    orders = read(spark, sf_dir, "orders")
    middle = orders.groupBy("o_orderpriority").agg(F.percentile("o_totalprice", 0.5).alias("middle"))
    return orders.join(middle, "o_orderpriority").select("o_orderkey", "middle")


@query(
    "win_latest_per_key",
    "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1",
)
def win_latest_per_key(spark, sf_dir):
    return windows.latest(read(spark, sf_dir, "orders"), ["o_custkey"], F.desc("o_orderdate"), F.desc("o_orderkey")).select("o_custkey", "o_orderkey", "o_totalprice")


@query(
    "topk_group",
    "SELECT * FROM (SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS place FROM orders) WHERE place <= 3",
)
def topk_group(spark, sf_dir):
    return windows.top_per_group(read(spark, sf_dir, "orders"), ["o_custkey"], 3, F.desc("o_totalprice"), "o_orderkey").select("o_custkey", "o_orderkey", "place")


@query(
    "rank_tiers",
    """WITH s AS (SELECT c_custkey, c_nationkey, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS score FROM customer), r AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey, score IS NOT NULL ORDER BY score DESC, c_custkey) * 1.0 / count(*) OVER (PARTITION BY c_nationkey, score IS NOT NULL) AS sh FROM s)
    SELECT c_custkey, CASE WHEN score IS NULL THEN 'Watch' WHEN sh <= 0.05 THEN 'Critical' WHEN sh <= 0.2 THEN 'High' WHEN sh <= 0.5 THEN 'Medium' ELSE 'Low' END AS tier FROM r""",
)
def rank_tiers(spark, sf_dir):
    rows = read(spark, sf_dir, "customer").withColumn("score", F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")))
    return relational.ranked_tiers(rows, "score", "c_custkey", ["c_nationkey"], [(0.05, "Critical"), (0.2, "High"), (0.5, "Medium")], "Low", "Watch").select("c_custkey", "tier")


@query(
    "win_survival",
    "WITH h AS (SELECT o_custkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS step, (o_orderkey % 10) / 21.0 AS hz FROM orders) SELECT k, step, round(1 - exp(sum(ln(1 - hz)) OVER (PARTITION BY k ORDER BY step)), 9) AS p FROM h",
)
def win_survival(spark, sf_dir):
    steps = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.row_number().over(windows.ordered(["o_custkey"], "o_orderkey")).cast("long").alias("step"), (F.col("o_orderkey") % 10 / 21.0).alias("hz"))
    return steps.select("k", "step", F.round(windows.survival(F.col("hz"), ["k"], "step"), 9).alias("p"))


@query(
    "win_conversation_turns",
    """WITH t AS (SELECT conv_id, turn, role, CASE WHEN role = lag(role) OVER (PARTITION BY conv_id ORDER BY turn) THEN 0 ELSE 1 END AS br FROM conversations),
    r AS (SELECT conv_id, turn, role, sum(br) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM t)
    SELECT conv_id, CAST(run AS BIGINT) AS run, min(role) AS role, count(*) AS turns, min(turn) AS first FROM r GROUP BY conv_id, run""",
)
def win_conversation_turns(spark, sf_dir):
    turns = read(spark, sf_dir, "conversations")
    changed = ~F.coalesce(F.col("role") == F.lag("role").over(windows.ordered(["conv_id"], "turn")), F.lit(False))
    runs = windows.islands(turns, ["conv_id"], "turn", changed, "run")
    return runs.groupBy("conv_id", "run").agg(F.min("role").alias("role"), F.count("*").alias("turns"), F.min("turn").alias("first"))
