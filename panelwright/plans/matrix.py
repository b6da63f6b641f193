"""The feature matrix of the customer panel, and the checklist of thirteen dimensions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from panelwright.functions.scalars import ratio, three_state
from panelwright.operators import features, scores, temporal, windows
from panelwright.operators import serving as S
from panelwright.plans.panel import PANEL_SQL, panel
from panelwright.plans.registry import query
from panelwright.sources.tables import read

#: Speed below which a value stands still, share of a move that counts, edges of the ages in quarters.
SMALL, MOVE, AGES = 5000.0, 0.05, [0, 2, 4, 8, 16, 24]

_RULE = " + ".join(
    f"{w} * least(greatest(coalesce({c}, 0) / {top} * 100, 0), 100)" for c, (w, top) in (("100 * (since_first - 1)", scores.RULE_PARTS["overrun"]), ("3.0 * age", scores.RULE_PARTS["delay"]), ("100 - coalesce(100 * part, 0)", scores.RULE_PARTS["undone"]), ("CAST(n AS DOUBLE)", scores.RULE_PARTS["spend"]))
)


@query(
    "panel_matrix",
    f"""WITH {PANEL_SQL}, p AS (SELECT panel.k, q, x, n, c_mktsegment AS seg FROM panel JOIN customer ON c_custkey = panel.k),
    l AS (SELECT *, q - min(q) OVER (PARTITION BY k) AS age, x / nullif(max(x) OVER w, 0) AS part, CASE WHEN first_value(x) OVER w > 0 THEN x / first_value(x) OVER w END AS since_first, lag(x) OVER w AS px,
      last_value(x) OVER (w2 RANGE BETWEEN 4 PRECEDING AND 2 PRECEDING) AS x2, last_value(q) OVER (w2 RANGE BETWEEN 4 PRECEDING AND 2 PRECEDING) AS q2,
      last_value(x) OVER (w2 RANGE BETWEEN 6 PRECEDING AND 4 PRECEDING) AS x4, last_value(q) OVER (w2 RANGE BETWEEN 6 PRECEDING AND 4 PRECEDING) AS q4,
      last_value(x) OVER (w2 RANGE BETWEEN 2 PRECEDING AND 1 PRECEDING) AS x1, last_value(q) OVER (w2 RANGE BETWEEN 2 PRECEDING AND 1 PRECEDING) AS q1
      FROM p WINDOW w AS (PARTITION BY k ORDER BY q ROWS UNBOUNDED PRECEDING), w2 AS (PARTITION BY k ORDER BY q)),
    v AS (SELECT *, (x - x2) / (q - q2) AS v2, (x - x4) / (q - q4) AS v4, coalesce(abs((x - x1) / (q - q1)) < {SMALL}, false) AS stuck, count(*) FILTER (WHERE abs(x / nullif(px, 0) - 1) > {MOVE}) OVER (PARTITION BY k ORDER BY q) AS moves FROM l),
    r AS (SELECT *, sum(CASE WHEN stuck THEN 0 ELSE 1 END) OVER (PARTITION BY k ORDER BY q) AS run, v2 - median(v2) OVER (PARTITION BY seg, q) AS v_peers,
      CASE WHEN age >= 24 THEN 5 WHEN age >= 16 THEN 4 WHEN age >= 8 THEN 3 WHEN age >= 4 THEN 2 WHEN age >= 2 THEN 1 ELSE 0 END AS bin FROM v),
    c AS (SELECT bin, max(m) OVER (ORDER BY bin) AS expected FROM (SELECT bin, median(part) AS m FROM r WHERE part IS NOT NULL GROUP BY bin))
    SELECT k, q, CAST(age AS INTEGER) AS age, round(part, 9) AS part, round(since_first, 9) AS since_first, round(v2, 6) AS velocity_2, round(v4, 6) AS velocity_4, round(2 * (v2 - v4), 6) AS acceleration,
      CAST(sum(CASE WHEN stuck THEN q - q1 ELSE 0 END) OVER (PARTITION BY k, run ORDER BY q) AS BIGINT) AS stagnation, round(v_peers, 6) AS velocity_peers, round(expected, 9) AS expected, round(part - expected, 9) AS deviation,
      CAST(moves AS BIGINT) AS moves, round({_RULE}, 6) AS rule_score FROM r JOIN c USING (bin)""",
)
def panel_matrix(spark, sf_dir):
    """Every feature of a customer's quarter: age, share of the peak so far, speeds, acceleration, stagnation, distance from the segment and from the usual
    course, moves so far and the rule score."""
    w = windows.ordered(["k"], "q")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    segment = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("seg"))
    rows = panel(spark, sf_dir).select("k", "q", "x", "n").join(segment, "k")
    rows = rows.withColumns({
        "age": F.col("q") - F.first("q").over(w),
        "part": ratio(F.col("x"), F.max("x").over(upto)),
        "since_first": features.since_first(F.col("x"), ["k"], "q"),
        "velocity_2": temporal.velocity(F.col("x"), ["k"], "q", 2, 2),
        "velocity_4": temporal.velocity(F.col("x"), ["k"], "q", 4, 2),
        "_move": F.abs(ratio(F.col("x"), F.lag("x").over(w)) - 1) > MOVE,
    })
    rows = rows.withColumn("moves", F.count_if(F.col("_move")).over(upto)).withColumn("acceleration", 2 * (F.col("velocity_2") - F.col("velocity_4")))
    rows = features.stagnation(rows, ["k"], "q", "x", F.lit(SMALL))
    rows = features.against_median(rows, ["seg", "q"], "velocity_2", "velocity_peers")
    rows = features.off_course(rows, F.col("age"), F.col("part"), AGES)
    rule = scores.rule_score(100 * (F.col("since_first") - 1), 3.0 * F.col("age"), 100 * F.col("part"), F.col("n").cast("double"))
    r = lambda c, places=6: F.round(c, places).alias(c)
    return rows.select("k", "q", "age", r("part", 9), r("since_first", 9), r("velocity_2"), r("velocity_4"), r("acceleration"), F.col("stagnation").cast("long").alias("stagnation"), r("velocity_peers"), r("expected", 9), r("deviation", 9), "moves", F.round(rule, 6).alias("rule_score"))


#: The checklist: dimension, what flags it, what clears it and the figure it rests on, in SQL that both engines read. A null condition does
#: not hold, so what is not known is neither.
CHECKS = [
    ("late shipments", "late_share >= late_cut", "late_share IS NOT NULL", "late_share"),
    ("returns", "return_share >= 0.4", "return_share < 0.2", "return_share"),
    ("idle", "idle_days > 365", "idle_days <= 180", "idle_days"),
    ("open orders", "open_share > 0.8 AND n_orders >= 5", "open_share <= 0.8 AND n_orders >= 5", "open_share"),
    ("balance", "c_acctbal < 0", "c_acctbal >= 0", "c_acctbal"),
    ("price escalation", "last_price >= 2 * first_price AND n_orders > 1", "last_price < 2 * first_price AND n_orders > 1", "last_price / nullif(first_price, 0)"),
    ("urgent share", "urgent_share > 0.4", "urgent_share <= 0.4", "urgent_share"),
    ("segment headwind", "segment_trend < 0", "segment_trend >= 0", "segment_trend"),
    ("nation exposure", "nation_orders > 0 AND n_orders > 0.1 * nation_orders", "n_orders <= 0.1 * nation_orders", "n_orders / nullif(nation_orders, 0)"),
    ("one supplier", "top_supplier_share > 0.5", "top_supplier_share <= 0.5 AND n_items >= 4", "top_supplier_share"),
    ("discounts", "mean_discount > 0.06", "mean_discount <= 0.06 AND n_items >= 4", "mean_discount"),
    ("composite", "late_share IS NOT NULL AND return_share IS NOT NULL AND (late_share + return_share) / 2 >= 0.6", "(late_share + return_share) / 2 < 0.6 AND late_share < late_cut AND return_share < 0.4", "(late_share + return_share) / 2"),
    ("staleness", "n_orders < 3 OR idle_days > 730", "n_orders >= 3 AND idle_days <= 730", "n_orders"),
]
_ITEMS = "SELECT o_custkey AS k, count(*) AS n_items, avg(CAST(l_shipdate > o_orderdate + INTERVAL 60 DAY AS INTEGER)) AS late_share, avg(CAST(l_returnflag = 'R' AS INTEGER)) AS return_share, avg(l_discount) AS mean_discount FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_custkey"
_FACTS = f"""WITH newest AS (SELECT max(o_orderdate) AS latest FROM orders),
  o AS (SELECT o_custkey AS k, count(*) AS n_orders, avg(CAST(o_orderstatus = 'O' AS INTEGER)) AS open_share, avg(CAST(o_orderpriority = '1-URGENT' AS INTEGER)) AS urgent_share, max(o_orderdate) AS last_at FROM orders GROUP BY o_custkey),
  f AS (SELECT o_custkey AS k, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS up, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS down FROM orders),
  g AS (SELECT k, max(CASE WHEN up = 1 THEN o_totalprice END) AS first_price, max(CASE WHEN down = 1 THEN o_totalprice END) AS last_price FROM f WHERE up = 1 OR down = 1 GROUP BY k),
  i AS ({_ITEMS}), s AS (SELECT k, max(m) / sum(m) AS top_supplier_share FROM (SELECT o_custkey AS k, l_suppkey, count(*) * 1.0 AS m FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_custkey, l_suppkey) t GROUP BY k),
  h AS (SELECT c_mktsegment AS segment, sum(CASE WHEN year(o_orderdate) = 1997 THEN o_totalprice ELSE 0 END) / nullif(sum(CASE WHEN year(o_orderdate) = 1996 THEN o_totalprice ELSE 0 END), 0) - 1 AS segment_trend FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY c_mktsegment),
  n AS (SELECT c_nationkey AS nation, count(*) AS nation_orders FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY c_nationkey),
  z AS (SELECT %s AS late_cut FROM i),
  facts AS (SELECT c.c_custkey, c.c_acctbal, o.n_orders, o.open_share, o.urgent_share, datediff(%s) AS idle_days, g.first_price, g.last_price, i.n_items, i.late_share, i.return_share, i.mean_discount, s.top_supplier_share, h.segment_trend, n.nation_orders, z.late_cut
    FROM customer c LEFT JOIN o ON o.k = c.c_custkey LEFT JOIN g ON g.k = c.c_custkey LEFT JOIN i ON i.k = c.c_custkey LEFT JOIN s ON s.k = c.c_custkey LEFT JOIN h ON h.segment = c.c_mktsegment LEFT JOIN n ON n.nation = c.c_nationkey CROSS JOIN newest CROSS JOIN z)"""


def _checklist_sql() -> str:
    state = lambda flag, clear: f"CASE WHEN coalesce({flag}, false) THEN 'flagged' WHEN coalesce({clear}, false) THEN 'clear' ELSE 'unknown' END"
    rows = ", ".join(f"{{'d': '{d}', 's': {state(flag, clear)}, 'e': round(CAST({figure} AS DOUBLE), 6)}}" for d, flag, clear, figure in CHECKS)
    facts = _FACTS % ("quantile_cont(late_share, 0.9)", "'day', o.last_at, newest.latest")
    return f"{facts} SELECT c_custkey, r.d AS dimension, r.s AS state, r.e AS figure FROM (SELECT c_custkey, unnest([{rows}]) AS r FROM facts)"


@query("serve_checklist_full", _checklist_sql())
def serve_checklist_full(spark, sf_dir):
    """Thirteen rows for every customer: flagged, clear or unknown, and the figure; what is not known is never clear."""
    tables = {name: read(spark, sf_dir, name) for name in ("orders", "lineitem", "customer")}
    sql = _FACTS % ("percentile(late_share, 0.9)", "newest.latest, o.last_at")
    # Summed as decimals: a sum of doubles depends on the order of rows, and decides where a mean lies on an edge.
    sql = sql.replace("avg(l_discount)", "CAST(sum(CAST(l_discount AS DECIMAL(33, 15))) AS DOUBLE) / count(l_discount)")
    for name in tables:
        sql = sql.replace(f"FROM {name}", f"FROM {{{name}}}").replace(f"JOIN {name}", f"JOIN {{{name}}}")
    facts = spark.sql(f"{sql} SELECT * FROM facts", **tables)
    items = [(d, three_state(F.expr(flag), F.expr(clear)), F.round(F.expr(figure).cast("double"), 6)) for d, flag, clear, figure in CHECKS]
    return S.checklist(facts, "c_custkey", items).select("c_custkey", "dimension", "state", F.col("evidence").cast("double").alias("figure"))
