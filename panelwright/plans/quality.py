"""Data quality: rules, quarantine, duplicates, coverage and contradictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelwright.functions import dates as D
from panelwright.functions.scalars import hash_id, parse_number, privacy_mask, sentinel_to_null, three_state
from panelwright.operators import quality as Q
from panelwright.plans.registry import query
from panelwright.sources.tables import read


def _rules():
    return [
        ("quantity_range", ~F.col("l_quantity").between(1, 45)),
        ("high_discount", F.col("l_discount") > 0.09),
        ("ship_before_1993", F.col("l_shipdate") < "1993-01-01"),
        ("tax_over_discount", F.col("l_tax") > F.col("l_discount") + 0.07),
    ]


_LINES = """t AS (SELECT *, list_filter([CASE WHEN NOT l_quantity BETWEEN 1 AND 45 THEN 'quantity_range' END, CASE WHEN l_discount > 0.09 THEN 'high_discount' END,
  CASE WHEN l_shipdate < TIMESTAMP '1993-01-01' THEN 'ship_before_1993' END, CASE WHEN l_tax > l_discount + 0.07 THEN 'tax_over_discount' END], lambda x: x IS NOT NULL) AS f FROM lineitem)"""


@query("dq_rules", f"WITH {_LINES} SELECT l_orderkey, l_linenumber, array_to_string(f, ';') AS failed FROM t WHERE len(f) > 0")
def dq_rules(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").withColumn("f", Q.failed_rules(_rules()))
    return rows.where(F.size("f") > 0).select("l_orderkey", "l_linenumber", F.array_join("f", ";").alias("failed"))


@query("dq_quarantine", f"WITH {_LINES}, e AS (SELECT *, unnest(f) AS rule_id FROM t) SELECT rule_id, count(*) AS n_rows, count(DISTINCT l_orderkey) AS n_orders FROM e GROUP BY 1")
def dq_quarantine(spark, sf_dir):
    _, held = Q.split_by_rules(read(spark, sf_dir, "lineitem"), _rules())
    return held.groupBy("rule_id").agg(F.count("*").alias("n_rows"), F.count_distinct("l_orderkey").alias("n_orders"))


@query("dq_kept", f"WITH {_LINES} SELECT l_returnflag, count(*) AS n, round(sum(l_quantity), 4) AS qty FROM t WHERE len(f) = 0 GROUP BY 1")
def dq_kept(spark, sf_dir):
    kept, _ = Q.split_by_rules(read(spark, sf_dir, "lineitem"), _rules())
    return kept.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 4).alias("qty"))


@query(
    "dq_dedupe",
    """WITH t AS (SELECT o_custkey AS k, o_orderkey AS i, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS r, CASE WHEN o_orderkey % 3 > 0 THEN o_totalprice END AS price, CASE WHEN o_orderkey % 4 > 0 THEN o_orderpriority END AS prio FROM orders),
    o AS (SELECT *, row(r, -((price IS NOT NULL)::INT + (prio IS NOT NULL)::INT), i) AS ord FROM t)
    SELECT k, arg_min(i, ord) AS i, arg_min(price, ord) FILTER (WHERE price IS NOT NULL) AS price, arg_min(prio, ord) FILTER (WHERE prio IS NOT NULL) AS prio, count(*) AS n_rows FROM o GROUP BY k""",
)
def dq_dedupe(spark, sf_dir):
    key = F.col("o_orderkey")
    rows = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), key.alias("i"), "o_orderstatus", F.when(key % 3 > 0, F.col("o_totalprice")).alias("price"), F.when(key % 4 > 0, F.col("o_orderpriority")).alias("prio"))
    rank = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    return Q.dedupe(rows, ["k"], rank, ["price", "prio"], "i")


@query(
    "dq_calendar",
    """WITH t AS (SELECT DISTINCT c_nationkey AS k, CAST(year(o_orderdate) * 12 + month(o_orderdate) AS INTEGER) AS m FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderpriority LIKE '1%'),
    s AS (SELECT k, unnest(range(min(m), max(m) + 1)) AS m FROM t GROUP BY k) SELECT s.k, CAST(s.m AS INTEGER) AS m, t.m IS NOT NULL AS present FROM s LEFT JOIN t ON t.k = s.k AND t.m = s.m""",
)
def dq_calendar(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").where("o_orderpriority LIKE '1%'").join(read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return Q.calendar(orders.select(F.col("c_nationkey").alias("k"), D.month_index(F.col("o_orderdate")).alias("m")), "m", "k")


@query(
    "dq_stale_repeats",
    """SELECT l_orderkey, l_linenumber, (row_number() OVER w > 1 AND l_returnflag IS NOT DISTINCT FROM lag(l_returnflag) OVER w AND l_linestatus IS NOT DISTINCT FROM lag(l_linestatus) OVER w) AS stale FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice)""",
)
def dq_stale_repeats(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem").withColumn("place", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    return Q.repeats(lines, ["l_orderkey"], "place", ["l_returnflag", "l_linestatus"]).select("l_orderkey", "l_linenumber", "stale")


@query(
    "dq_list_overlap",
    """WITH t AS (SELECT DISTINCT CAST(year(o_orderdate) AS INTEGER) AS y, o_custkey AS k FROM orders) SELECT a.y, count(*) AS items, count(b.k) / count(*) AS overlap FROM t a LEFT JOIN t b ON b.y = a.y - 1 AND b.k = a.k GROUP BY 1""",
)
def dq_list_overlap(spark, sf_dir):
    return Q.list_overlap(read(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("y"), F.col("o_custkey").alias("k")), "y", "k")


@query("dq_orphans", "SELECT user_id, count(*) AS n FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) GROUP BY 1")
def dq_orphans(spark, sf_dir):
    parents = read(spark, sf_dir, "customer").where("c_acctbal > 0")
    return Q.orphans(read(spark, sf_dir, "events"), parents, "user_id", "c_custkey").groupBy("user_id").agg(F.count("*").alias("n"))


@query(
    "dq_conflicts",
    "SELECT l_partkey, count(DISTINCT l_returnflag) AS l_returnflag, count(DISTINCT l_linestatus) AS l_linestatus FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag) > 1 OR count(DISTINCT l_linestatus) > 1",
)
def dq_conflicts(spark, sf_dir):
    return Q.conflicting(read(spark, sf_dir, "lineitem"), "l_partkey", ["l_returnflag", "l_linestatus"])


@query(
    "dq_contradiction_rate",
    "SELECT l_returnflag, round(avg(CASE WHEN l_linestatus = 'F' AND l_shipdate > TIMESTAMP '1995-06-17' THEN 1.0 ELSE 0 END), 9) AS rate FROM lineitem GROUP BY 1",
)
def dq_contradiction_rate(spark, sf_dir):
    off = (F.col("l_linestatus") == "F") & (F.col("l_shipdate") > "1995-06-17")
    return read(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.round(F.avg(off.cast("double")), 9).alias("rate"))


@query(
    "dq_validation_errors",
    """SELECT event_id, array_to_string(list_filter([CASE WHEN value < 1 THEN 'value:small' END, CASE WHEN event_type NOT IN ('click', 'view', 'purchase') THEN 'event_type:enum' END, CASE WHEN CAST(json_extract_string(props, '$.k') AS INTEGER) > 90 THEN 'props.k:range' END], lambda x: x IS NOT NULL), ',') AS errors FROM events""",
)
def dq_validation_errors(spark, sf_dir):
    k = F.get_json_object("props", "$.k").try_cast("int")
    rules = [("value:small", F.col("value") < 1), ("event_type:enum", ~F.col("event_type").isin("click", "view", "purchase")), ("props.k:range", k > 90)]
    return read(spark, sf_dir, "events").select("event_id", F.array_join(Q.failed_rules(rules), ",").alias("errors"))


@query(
    "dq_three_state",
    """SELECT c_custkey, CASE WHEN coalesce(CASE WHEN c_custkey % 3 > 0 THEN c_acctbal END < 0, false) THEN 'flagged' WHEN coalesce(CASE WHEN c_custkey % 3 > 0 THEN c_acctbal END >= 1000, false) THEN 'clear' ELSE 'unknown' END AS state FROM customer""",
)
def dq_three_state(spark, sf_dir):
    known = F.when(F.col("c_custkey") % 3 > 0, F.col("c_acctbal"))
    return read(spark, sf_dir, "customer").select("c_custkey", three_state(known < 0, known >= 1000).alias("state"))


@query(
    "proj_parse_numbers",
    """WITH t AS (SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'n.a.' WHEN c_acctbal < 0 THEN '(' || CAST(-c_acctbal AS VARCHAR) || ')' ELSE CAST(c_acctbal AS VARCHAR) END AS s FROM customer)
    SELECT c_custkey, CASE WHEN s LIKE '(%)' THEN -TRY_CAST(s[2:-2] AS DOUBLE) ELSE TRY_CAST(s AS DOUBLE) END AS v, TRY_CAST(s AS DOUBLE) IS NULL AND s NOT LIKE '(%)' AS failed FROM t""",
)
def proj_parse_numbers(spark, sf_dir):
    """Numbers from printed text, minus in parentheses; what cannot be read is null and marked."""
    bal = F.col("c_acctbal")
    s = F.when(F.col("c_custkey") % 5 == 0, F.lit("n.a.")).when(bal < 0, F.concat(F.lit("("), (-bal).cast("string"), F.lit(")"))).otherwise(bal.cast("string"))
    return read(spark, sf_dir, "customer").select("c_custkey", parse_number(s).alias("v"), parse_number(s).isNull().alias("failed"))


@query(
    "proj_sentinels",
    "SELECT o_orderkey, CASE WHEN NOT (o_orderstatus = 'P' AND o_orderpriority = '1-URGENT') THEN o_orderpriority END AS priority FROM orders",
)
def proj_sentinels(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey", sentinel_to_null(F.col("o_orderpriority"), "1-URGENT", F.col("o_orderstatus") == "P").alias("priority"))


@query(
    "proj_dates",
    """SELECT o_orderkey, CAST(year(o_orderdate) * 4 + quarter(o_orderdate) - 1 AS INTEGER) AS q, CAST(year(o_orderdate) * 12 + month(o_orderdate) AS INTEGER) AS m, CAST(year(o_orderdate) - CASE WHEN month(o_orderdate) < 4 THEN 1 ELSE 0 END AS INTEGER) AS fy,
      CAST(date_trunc('quarter', o_orderdate) AS DATE) AS qs, CAST(CAST(o_orderdate AS DATE) + INTERVAL 7 MONTH AS DATE) AS later, round(date_diff('day', CAST(o_orderdate AS DATE), DATE '2000-01-01') / 30.4375, 9) AS months FROM orders""",
)
def proj_dates(spark, sf_dir):
    at = F.col("o_orderdate")
    return read(spark, sf_dir, "orders").select(
        "o_orderkey",
        D.quarter_index(at).alias("q"),
        D.month_index(at).alias("m"),
        D.fiscal_year(at).alias("fy"),
        D.quarter_start(at).alias("qs"),
        D.add_months(at, F.lit(7)).alias("later"),
        F.round(D.fractional_months_between(at, F.lit("2000-01-01").cast("date")), 9).alias("months"),
    )


@query(
    "proj_stage_at",
    "SELECT l_orderkey, max(CASE WHEN l_shipdate + INTERVAL 90 DAY <= TIMESTAMP '1996-01-01' THEN 'c paid' WHEN l_shipdate <= TIMESTAMP '1996-01-01' THEN 'b shipped' ELSE 'a open' END) AS stage FROM lineitem GROUP BY 1",
)
def proj_stage_at(spark, sf_dir):
    asof = F.lit("1996-01-01").cast("timestamp_ntz")
    ship = F.col("l_shipdate")
    stage = D.stage_at(asof, [("b shipped", ship), ("c paid", ship + F.expr("interval 90 days"))], "a open")
    return read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max(stage).alias("stage"))


@query("proj_hash_ids", "SELECT c_custkey, 'BN-' || substr(sha1(c_mktsegment || '|' || c_nationkey), 1, 10) AS id FROM customer")
def proj_hash_ids(spark, sf_dir):
    return read(spark, sf_dir, "customer").select("c_custkey", hash_id("BN-", F.col("c_mktsegment"), F.col("c_nationkey")).alias("id"))


@query(
    "proj_json",
    """SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, CAST(json_extract_string(props, '$.k') AS INTEGER) % 2 = 0 AS even FROM events""",
)
def proj_json(spark, sf_dir):
    k = F.from_json("props", "k int")["k"]
    return read(spark, sf_dir, "events").select("event_id", k.alias("k"), (k % 2 == 0).alias("even"))


@query(
    "proj_redacted",
    "SELECT c_custkey, CASE WHEN c_nationkey = 3 THEN c_name END AS c_name, CAST(NULL AS DOUBLE) AS c_acctbal FROM customer",
)
def proj_redacted(spark, sf_dir):
    """A policy's view: balances are hidden, names shown in scope only."""
    rows = read(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_nationkey") == 3, F.col("c_name")).alias("c_name"), "c_acctbal")
    return rows.select(*privacy_mask(rows.columns, {"c_acctbal"}, dict(rows.dtypes)))
