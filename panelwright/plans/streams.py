"""Streaming flows over events, run over what is available and compared with their batch meaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelwright.plans.registry import query
from panelwright.sources.tables import read
from panelwright.streaming import flows


#: How late a row may come.
LATE = "1 hour"


def _run(spark, sf_dir, flow, mode, new_by=None):
    """Rows by batch of a flow over the events as they came in."""
    return flows.run_replayed(spark, read(spark, sf_dir, "events"), "ts", flow, mode, new_by=new_by)


@query("stream_tumbling", "SELECT event_type, date_trunc('day', ts) AS start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_tumbling(spark, sf_dir):
    flow = lambda events: flows.tumbling(events, "ts", "1 day", ["event_type"], LATE, [F.count("*").alias("n"), F.sum("value").alias("total")])
    rows = flows.latest(spark, _run(spark, sf_dir, flow, "update"), ["start", "event_type"])
    return rows.select("event_type", F.col("start").cast("timestamp_ntz").alias("start"), "n", F.round("total", 4).alias("total"))


@query(
    "stream_sliding",
    """WITH w AS (SELECT user_id, unnest([date_trunc('day', ts), date_trunc('day', ts) - INTERVAL 1 DAY]) AS start FROM events WHERE event_type = 'error') SELECT user_id, start, count(*) AS n FROM w GROUP BY 1, 2 HAVING count(*) >= 3""",
)
def stream_sliding(spark, sf_dir):
    """Two-day windows, every day, in which a user had at least three errors."""
    flow = lambda events: flows.sliding(events.where("event_type = 'error'"), "ts", "2 days", "1 day", ["user_id"], LATE, [F.count("*").alias("n")])
    rows = flows.latest(spark, _run(spark, sf_dir, flow, "update"), ["start", "user_id"])
    return rows.where("n >= 3").select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query(
    "stream_sessions",
    """WITH b AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS br FROM events), i AS (SELECT *, sum(br) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM b)
    SELECT user_id, min(ts) AS start, count(*) AS n FROM i GROUP BY user_id, s""",
)
def stream_sessions(spark, sf_dir):
    flow = lambda events: flows.sessions(events, "ts", "12 hours", ["user_id"], LATE, [F.count("*").alias("n")])
    rows = flows.last_batch(spark, _run(spark, sf_dir, flow, "complete"))
    return rows.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("stream_once", "SELECT user_id, event_type, count(*) AS n FROM (SELECT DISTINCT user_id, event_type, event_id FROM events) GROUP BY 1, 2")
def stream_once(spark, sf_dir):
    rows = spark.read.parquet(_run(spark, sf_dir, lambda events: flows.once(events, "ts", LATE, ["event_id"]), "append", ["event_id"]))
    return rows.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


@query(
    "stream_change_alerts",
    """WITH a AS (SELECT c_custkey AS k, round(c_acctbal / 100) AS v FROM customer WHERE c_custkey % 13 <> 0), b AS (SELECT c_custkey AS k, round(c_acctbal / 100) + CASE WHEN c_custkey % 9 = 0 THEN 1 ELSE 0 END AS v FROM customer WHERE c_custkey % 17 <> 0)
    SELECT k, CASE WHEN a.v IS NULL THEN 'added' WHEN b.v IS NULL THEN 'removed' ELSE 'changed' END AS change, a.v AS old_v, b.v AS new_v FROM a FULL JOIN b USING (k) WHERE a.v IS DISTINCT FROM b.v""",
)
def stream_change_alerts(spark, sf_dir):
    """Alerts of one snapshot against the next."""
    rows, key = read(spark, sf_dir, "customer"), F.col("c_custkey")
    v = F.round(F.col("c_acctbal") / 100)
    old = rows.where(key % 13 != 0).select(key.alias("k"), v.alias("v"))
    new = rows.where(key % 17 != 0).select(key.alias("k"), (v + F.when(key % 9 == 0, 1).otherwise(0)).alias("v"))
    return flows.change_alerts(old, new, ["k"], ["v"]).select("k", "change", "old_v", "new_v")


@query(
    "stream_late_fill",
    """SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 3 = 0 THEN 1 END, CASE WHEN o_orderstatus = 'F' THEN 2 END) AS realised FROM orders""",
)
def stream_late_fill(spark, sf_dir):
    """Outcomes arriving late fill only what is open."""
    orders = read(spark, sf_dir, "orders")
    log = orders.select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, 1).alias("realised"))
    late = orders.where("o_orderstatus = 'F'").select("o_orderkey", F.lit(2).alias("realised"))
    return flows.fill_open(log, late, ["o_orderkey"], "realised")


@query(
    "stream_new_by_either",
    """WITH t AS (SELECT doc_id, md5(text) AS text_hash, md5(source || lang || CAST(n_chars AS VARCHAR)) AS url_hash FROM documents), k AS (SELECT * FROM t WHERE doc_id % 5 = 0), b AS (SELECT * FROM t WHERE doc_id % 5 <> 0),
    u AS (SELECT *, row_number() OVER (PARTITION BY url_hash ORDER BY doc_id) AS n FROM b WHERE url_hash NOT IN (SELECT url_hash FROM k)), v AS (SELECT *, row_number() OVER (PARTITION BY text_hash ORDER BY doc_id) AS m FROM u WHERE n = 1 AND text_hash NOT IN (SELECT text_hash FROM k))
    SELECT doc_id FROM v WHERE m = 1""",
)
def stream_new_by_either(spark, sf_dir):
    """Signals new by address hash and by text hash."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("text_hash"), F.md5(F.concat("source", "lang", F.col("n_chars").cast("string"))).alias("url_hash"))
    return flows.new_by_either(docs.where("doc_id % 5 <> 0"), docs.where("doc_id % 5 = 0"), ("url_hash", "text_hash"), ["doc_id"]).select("doc_id")


@query(
    "stream_tier_alerts",
    """WITH t AS (SELECT user_id, ts, event_id, CASE WHEN value >= 150 THEN 'critical' WHEN value >= 80 THEN 'high' WHEN value >= 30 THEN 'medium' ELSE 'low' END AS tier FROM events WHERE value IS NOT NULL),
    l AS (SELECT *, lag(tier) OVER w AS was, ts - lag(ts) OVER w > INTERVAL 20 DAY AS forgotten FROM t WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    r AS (SELECT *, was IS NULL OR forgotten AS is_new, CASE tier WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END AS n, CASE was WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END AS m FROM l)
    SELECT CAST(user_id AS VARCHAR) AS key, event_id, CASE WHEN is_new THEN 'new' WHEN n < m THEN 'tier_up' ELSE 'tier_down' END AS kind,
      CASE WHEN is_new THEN CASE WHEN n < 2 THEN 2 ELSE 1 END WHEN n < m THEN CASE WHEN n = 0 THEN 3 ELSE 2 END ELSE 1 END AS severity, CASE WHEN NOT is_new THEN was END AS was, tier
    FROM r WHERE is_new OR n < m AND n < 2 OR n > m AND m < 2""",
)
def stream_tier_alerts(spark, sf_dir):
    """Alerts of users whose events' value moves them into or out of a watched tier, from state kept by user over several starts of the flow."""
    v = F.col("value")
    tier = F.when(v >= 150, "critical").when(v >= 80, "high").when(v >= 30, "medium").when(v.isNotNull(), "low")
    flow = lambda events: flows.tier_alerts(events.withColumn("tier", tier), "user_id", "ts", "event_id", "tier", LATE, 20)
    rows = spark.read.parquet(_run(spark, sf_dir, flow, "append"))
    return rows.select("key", F.col("seq").alias("event_id"), "kind", "severity", "was", "tier")


@query(
    "stream_realised",
    """SELECT o_orderkey, min(l_shipdate) AS shipped FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_linenumber = 1 AND l_shipdate >= o_orderdate AND l_shipdate <= o_orderdate + INTERVAL 60 DAY GROUP BY 1""",
)
def stream_realised(spark, sf_dir):
    """Orders, and as their outcome the shipment of the first item within 60 days; both arrive by time. What stays open at the end has no outcome."""
    made, came = flows.flow_folder(spark), flows.flow_folder(spark)
    orders = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("made"))
    items = read(spark, sf_dir, "lineitem").where("l_linenumber = 1").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_shipdate").cast("timestamp").alias("came"))
    folder = flows.flow_folder(spark)

    def arrive(part):
        part.where("side = 0").select("o_orderkey", F.col("at").alias("made")).write.mode("append").parquet(made)
        part.where("side = 1").select("o_orderkey", F.col("at").alias("came")).write.mode("append").parquet(came)
        joined = flows.realised_stream(flows.arrivals(spark, made, orders.schema), flows.arrivals(spark, came, items.schema), ["o_orderkey"], "made", "came", "60 DAYS", "1 day")
        flows.run_available(joined, folder, "append")

    both = orders.select("o_orderkey", F.col("made").alias("at"), F.lit(0).alias("side")).unionByName(items.select("o_orderkey", F.col("came").alias("at"), F.lit(1).alias("side")))
    flows.replayed(both, "at", 3, arrive)
    found = spark.read.parquet(f"{folder}/rows").where("came IS NOT NULL").groupBy("o_orderkey").agg(F.min("came").alias("shipped"))
    return orders.join(found, "o_orderkey", "left").select("o_orderkey", F.col("shipped").cast("timestamp_ntz").alias("shipped"))
