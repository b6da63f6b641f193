"""The quarterly panel, its labels, lookbacks and features: one row a customer and quarter, from orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelwright.functions.dates import quarter_index
from panelwright.functions.scalars import add_token, bin_right_open, clip, coalesce_with_basis, either_known, ratio, shrink
from panelwright.operators import temporal, windows
from panelwright.operators.aggregates import last_valid
from panelwright.plans.registry import query
from panelwright.sources.tables import read

PANEL_SQL = """panel AS (
  SELECT o_custkey AS k, CAST(year(o_orderdate) * 4 + quarter(o_orderdate) - 1 AS INTEGER) AS q,
    arg_max(o_totalprice, row(o_orderdate, o_orderkey)) AS x, arg_max(o_orderdate, row(o_orderdate, o_orderkey)) AS at, count(*) AS n,
    bool_or(o_orderstatus = 'F') AS done,
    arg_max(o_totalprice, row(o_orderdate, o_orderkey)) FILTER (WHERE o_orderstatus = 'O') AS open_x
  FROM orders GROUP BY 1, 2
)"""


def panel(spark, sf_dir) -> DataFrame:
    """Orders collapsed to quarters: the last order's value x, its date, orders n, whether any is finished, and
    the last value among open orders."""
    order = F.struct("o_orderdate", "o_orderkey")
    orders = read(spark, sf_dir, "orders").withColumn("q", quarter_index(F.col("o_orderdate"))).withColumn("_open", F.when(F.col("o_orderstatus") == "O", F.col("o_totalprice")))
    return orders.groupBy(F.col("o_custkey").alias("k"), "q").agg(
        F.max_by("o_totalprice", order).alias("x"),
        F.max_by("o_orderdate", order).alias("at"),
        F.count("*").alias("n"),
        F.bool_or(F.col("o_orderstatus") == "F").alias("done"),
        last_valid("_open", order).alias("open_x"),
    )


@query("panel_quarter", f"WITH {PANEL_SQL} SELECT k, q, x, n, done, open_x FROM panel")
def panel_quarter(spark, sf_dir):
    return panel(spark, sf_dir).drop("at")


@query(
    "panel_gaps",
    f"""WITH {PANEL_SQL} SELECT k, q, CAST(q - lag(q) OVER w AS INTEGER) AS gap, coalesce(open_x, x) AS value,
      CASE WHEN open_x IS NOT NULL THEN 'open' WHEN x IS NOT NULL THEN 'last' END AS basis FROM panel WINDOW w AS (PARTITION BY k ORDER BY q)""",
)
def panel_gaps(spark, sf_dir):
    value, basis = coalesce_with_basis([("open", F.col("open_x")), ("last", F.col("x"))])
    gap = F.col("q") - F.lag("q").over(windows.ordered(["k"], "q"))
    return panel(spark, sf_dir).select("k", "q", gap.alias("gap"), value.alias("value"), basis.alias("basis"))


@query("panel_coverage", f"WITH {PANEL_SQL} SELECT q, count(*) AS n_keys, round(avg(CASE WHEN open_x IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS open_share, CAST(sum(n) AS BIGINT) AS n_rows FROM panel GROUP BY q")
def panel_coverage(spark, sf_dir):
    share = F.round(F.avg(F.col("open_x").isNotNull().cast("double")), 6)
    return panel(spark, sf_dir).groupBy("q").agg(F.count("*").alias("n_keys"), share.alias("open_share"), F.sum("n").alias("n_rows"))


@query(
    "panel_master",
    f"""WITH {PANEL_SQL}, s AS (SELECT *, lag(x) OVER (PARTITION BY k ORDER BY q) AS p FROM panel)
    SELECT k, min(q) AS first_q, max(q) AS last_q, count(*) AS n_quarters, arg_min(x, q) AS first_x, arg_max(x, q) AS last_x,
      count(*) FILTER (WHERE x > p) AS rises, count(*) FILTER (WHERE abs(x / p - 1) > 0.5) AS changes, bool_or(done) AS ever_done FROM s GROUP BY k""",
)
def panel_master(spark, sf_dir):
    before = panel(spark, sf_dir).withColumn("p", F.lag("x").over(windows.ordered(["k"], "q")))
    return before.groupBy("k").agg(
        F.min("q").alias("first_q"),
        F.max("q").alias("last_q"),
        F.count("*").alias("n_quarters"),
        F.min_by("x", "q").alias("first_x"),
        F.max_by("x", "q").alias("last_x"),
        F.count_if(F.col("x") > F.col("p")).alias("rises"),
        F.count_if(F.abs(F.col("x") / F.col("p") - 1) > 0.5).alias("changes"),
        F.bool_or("done").alias("ever_done"),
    )


def labels(rows: DataFrame, h: int) -> DataFrame:
    """Outcome h quarters on: a rise of 5%, a finish that was none, and either, known only if both are."""
    pairs = temporal.horizon_join(rows.select("k", "q", "x", "done"), "k", "q", h, ["x", "done"])
    rise = F.when(F.col("x") > 0, F.col("x_next") >= 1.05 * F.col("x"))
    finish = F.when(~F.col("done"), F.col("done_next"))
    return pairs.select("k", "q", (F.col("q") + h).alias("target_q"), rise.alias("y_rise"), finish.alias("y_finish"), either_known(rise, finish).alias("y_any"))


def _label_sql(h: int) -> str:
    return f"""WITH {PANEL_SQL}, l AS (
      SELECT a.k, a.q, CAST(b.q AS INTEGER) AS target_q, CASE WHEN a.x > 0 THEN b.x >= 1.05 * a.x END AS y_rise, CASE WHEN NOT a.done THEN b.done END AS y_finish
      FROM panel a JOIN panel b ON a.k = b.k AND b.q = a.q + {h}
    ) SELECT *, CASE WHEN y_rise IS NOT NULL AND y_finish IS NOT NULL THEN y_rise OR y_finish END AS y_any FROM l"""


for _h in range(1, 7):
    query(f"label_h{_h}", _label_sql(_h))(lambda spark, sf_dir, h=_h: labels(panel(spark, sf_dir), h))


@query(
    "label_max_in_horizon",
    f"WITH {PANEL_SQL} SELECT k, q, max(x) OVER (PARTITION BY k ORDER BY q RANGE BETWEEN 1 FOLLOWING AND 4 FOLLOWING) AS ahead FROM panel",
)
def label_max_in_horizon(spark, sf_dir):
    return panel(spark, sf_dir).select("k", "q", windows.within_ahead(F.col("x"), ["k"], "q", 4, F.max).alias("ahead"))


@query(
    "label_noise",
    f"""WITH {PANEL_SQL}, l AS (SELECT a.k, a.q, a.x, b.x AS x1, c.x AS x2 FROM panel a JOIN panel b ON a.k = b.k AND b.q = a.q + 1 JOIN panel c ON a.k = c.k AND c.q = a.q + 2 WHERE a.x > 0)
    SELECT count(*) AS pairs, count(*) FILTER (WHERE x1 >= 1.05 * x AND NOT x2 >= 1.05 * x) AS reversed FROM l""",
)
def label_noise(spark, sf_dir):
    rows = panel(spark, sf_dir).where("x > 0").select("k", "q", "x")
    one = temporal.horizon_join(panel(spark, sf_dir).select("k", "q", "x"), "k", "q", 1, ["x"]).where("x > 0")
    two = temporal.horizon_join(panel(spark, sf_dir).select("k", "q", "x"), "k", "q", 2, ["x"]).select("k", "q", F.col("x_next").alias("x2"))
    both = one.join(two, ["k", "q"])
    rise = lambda c: F.col(c) >= 1.05 * F.col("x")
    return both.agg(F.count("*").alias("pairs"), F.count_if(rise("x_next") & ~rise("x2")).alias("reversed"))


@query(
    "asof_tolerance",
    f"""WITH {PANEL_SQL} SELECT a.k, a.q, a.x, arg_max(b.q, b.q) AS ref_q, arg_max(b.x, b.q) AS ref_x, (a.x - arg_max(b.x, b.q)) / (a.q - max(b.q)) AS velocity
    FROM panel a LEFT JOIN panel b ON a.k = b.k AND b.q BETWEEN a.q - 4 AND a.q - 2 AND b.x IS NOT NULL GROUP BY a.k, a.q, a.x""",
)
def asof_tolerance(spark, sf_dir):
    ref = temporal.last_known(F.col("x"), ["k"], "q", 2, 2)
    rows = panel(spark, sf_dir).select("k", "q", "x", ref.alias("ref"))
    return rows.select("k", "q", "x", F.col("ref.at").alias("ref_q"), F.col("ref.value").alias("ref_x"), ((F.col("x") - F.col("ref.value")) / (F.col("q") - F.col("ref.at"))).alias("velocity"))


_EVENTS = "e AS (SELECT user_id AS k, ts, event_id, value FROM events WHERE event_type = 'purchase'), p AS (SELECT k, max(ts) AS ts, arg_max(value, row(ts, event_id)) AS value FROM e GROUP BY k, ts)"


def _asof(spark, sf_dir, inclusive):
    orders = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("k"), (F.col("o_orderdate") + F.expr("interval 26 years")).alias("at"))
    events = read(spark, sf_dir, "events").where("event_type = 'purchase'")
    last = events.groupBy(F.col("user_id").alias("k"), "ts").agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"))
    found = temporal.asof_join(orders, last, ["k"], "at", "ts", ["ts", "value"], inclusive)
    return found.select("o_orderkey", "k", F.col("value"), F.col("ts").isNotNull().alias("found"))


def _asof_sql(op: str) -> str:
    return f"""WITH {_EVENTS}, o AS (SELECT o_orderkey, o_custkey AS k, o_orderdate + INTERVAL 26 YEAR AS at FROM orders)
    SELECT o.o_orderkey, o.k, arg_max(p.value, p.ts) AS value, max(p.ts) IS NOT NULL AS found FROM o LEFT JOIN p ON o.k = p.k AND p.ts {op} o.at GROUP BY 1, 2"""


query("asof_inclusive", _asof_sql("<="))(lambda spark, sf_dir: _asof(spark, sf_dir, True))
query("asof_strict", _asof_sql("<"))(lambda spark, sf_dir: _asof(spark, sf_dir, False))


@query(
    "asof_max_age",
    """WITH e AS (SELECT user_id, ts, event_id, value, max(ts) OVER () AS now FROM events WHERE event_type = 'view')
    SELECT user_id, arg_max(value, row(ts, event_id)) AS value FROM e WHERE ts > now - INTERVAL 30 DAY GROUP BY user_id""",
)
def asof_max_age(spark, sf_dir):
    views = read(spark, sf_dir, "events").where("event_type = 'view'")
    now = views.agg(F.max("ts").alias("now"))
    recent = views.crossJoin(F.broadcast(now)).where(F.col("ts") > F.col("now") - F.expr("interval 30 days"))
    return recent.groupBy("user_id").agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"))


@query(
    "asof_realised",
    f"""WITH {PANEL_SQL}, l AS (SELECT a.k, b.q AS target_q, CAST(b.x >= 1.05 * a.x AS INTEGER) AS y FROM panel a JOIN panel b ON a.k = b.k AND b.q = a.q + 1 WHERE a.x > 0),
    g AS (SELECT c_mktsegment AS seg, k, target_q, y FROM l JOIN customer ON c_custkey = k), qs AS (SELECT DISTINCT q FROM panel), segs AS (SELECT DISTINCT seg FROM g),
    r AS (SELECT seg, q, coalesce(sum(y), 0) AS s, count(y) AS n FROM segs CROSS JOIN qs LEFT JOIN g USING (seg) WHERE target_q <= q OR target_q IS NULL GROUP BY seg, q),
    a AS (SELECT q, sum(s) / sum(n) AS prior FROM r GROUP BY q)
    SELECT seg, q, CAST(n AS BIGINT) AS n, CAST(s AS BIGINT) AS s, round((s + 10 * prior) / (n + 10), 9) AS rate FROM r JOIN a USING (q)""",
)
def asof_realised(spark, sf_dir):
    """Rates of each segment from outcomes known by each quarter, shrunk toward the rate of all: running sums over
    quarters, filled forward to quarters without outcomes."""
    rows = panel(spark, sf_dir)
    known = labels(rows, 1).where(F.col("y_rise").isNotNull())
    seg = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("seg"))
    by = known.join(seg, "k").groupBy("seg", F.col("target_q").alias("q")).agg(F.sum(F.col("y_rise").cast("int")).alias("s"), F.count("*").alias("n"))
    grid = by.select("seg").distinct().join(F.broadcast(rows.select("q").distinct()))
    w = windows.ordered(["seg"], "q")
    upto = grid.join(by, ["seg", "q"], "left").select("seg", "q", windows.running(F.col("n"), w).alias("n"), windows.running(F.col("s"), w).alias("s")).where(F.col("n").isNotNull())
    prior = Window.partitionBy("q")
    rate = shrink(F.col("s"), F.col("n"), F.sum("s").over(prior) / F.sum("n").over(prior))
    return upto.select("seg", "q", "n", "s", F.round(rate, 9).alias("rate"))


@query(
    "panel_features",
    f"""WITH {PANEL_SQL}, f AS (
      SELECT k, q, x, lag(x) OVER w AS px, q - first_value(q) OVER w AS age, row_number() OVER w AS seen, first_value(x) OVER w AS x0,
        sum(n) OVER w AS orders_to_date FROM panel WINDOW w AS (PARTITION BY k ORDER BY q))
    SELECT k, q, CAST(age AS INTEGER) AS age, CAST(seen AS INTEGER) AS seen, CAST(orders_to_date AS BIGINT) AS orders_to_date, round(CASE WHEN x0 > 0 THEN x / x0 END, 9) AS vs_first,
      round(CASE WHEN px > 0 THEN least(greatest(x / px - 1, -1), 3) END, 9) AS change,
      CASE WHEN x >= 100000 THEN 3 WHEN x >= 50000 THEN 2 WHEN x >= 10000 THEN 1 WHEN x >= 0 THEN 0 END AS band FROM f""",
)
def panel_features(spark, sf_dir):
    w = windows.ordered(["k"], "q")
    first = F.first("x").over(w)
    change = clip(ratio(F.col("x"), F.lag("x").over(w)) - 1, -1.0, 3.0)
    return panel(spark, sf_dir).select(
        "k",
        "q",
        (F.col("q") - F.first("q").over(w)).alias("age"),
        F.row_number().over(w).alias("seen"),
        windows.running(F.col("n"), w).alias("orders_to_date"),
        F.round(ratio(F.col("x"), first), 9).alias("vs_first"),
        F.round(change, 9).alias("change"),
        bin_right_open(F.col("x"), [0, 10000, 50000, 100000]).alias("band"),
    )


@query(
    "panel_survival_rows",
    f"""WITH {PANEL_SQL}, r AS (SELECT a.k, a.q, s.step, b.done FROM panel a CROSS JOIN range(1, 5) s(step) LEFT JOIN panel b ON b.k = a.k AND b.q = a.q + s.step WHERE NOT a.done),
    c AS (SELECT *, bool_and(done IS NOT NULL) OVER w AS seen, coalesce(bool_or(done) OVER (PARTITION BY k, q ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS over FROM r WINDOW w AS (PARTITION BY k, q ORDER BY step))
    SELECT k, q, CAST(step AS INTEGER) AS step, CAST(done AS INTEGER) AS y FROM c WHERE seen AND NOT over""",
)
def panel_survival_rows(spark, sf_dir):
    return survival_rows(spark, sf_dir, 4)


def survival_rows(spark, sf_dir, ahead: int) -> DataFrame:
    """Risk set: a row for each step ahead until the event or the first unobserved quarter."""
    rows = panel(spark, sf_dir)
    steps = rows.where(~F.col("done")).select("k", "q", F.explode(F.sequence(F.lit(1), F.lit(ahead))).alias("step"))
    later = rows.select("k", F.col("q").alias("at"), F.col("done"))
    seen = steps.withColumn("at", F.col("q") + F.col("step")).join(later, ["k", "at"], "left")
    w = windows.ordered(["k", "q"], "step")
    known = F.bool_and(F.col("done").isNotNull()).over(w)
    over = F.coalesce(F.bool_or("done").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    return seen.withColumn("_known", known).withColumn("_over", over).where("_known AND NOT _over").select("k", "q", "step", F.col("done").cast("int").alias("y"))


@query(
    "panel_scurve",
    f"""WITH {PANEL_SQL}, f AS (SELECT k, q - min(q) OVER (PARTITION BY k) AS age, x / nullif(max(x) OVER (PARTITION BY k), 0) AS part FROM panel),
    b AS (SELECT CASE WHEN age >= 16 THEN 4 WHEN age >= 8 THEN 3 WHEN age >= 4 THEN 2 WHEN age >= 2 THEN 1 ELSE 0 END AS bin, part FROM f),
    m AS (SELECT bin, count(*) AS n, median(part) AS part FROM b GROUP BY bin)
    SELECT bin, n, round(max(part) OVER (ORDER BY bin), 9) AS curve FROM m""",
)
def panel_scurve(spark, sf_dir):
    """Median share of the peak by age, made monotone by a running maximum."""
    key = Window.partitionBy("k")
    rows = panel(spark, sf_dir).select((F.col("q") - F.min("q").over(key)).alias("age"), ratio(F.col("x"), F.max("x").over(key)).alias("part"))
    by = rows.groupBy(bin_right_open(F.col("age"), [0, 2, 4, 8, 16]).alias("bin")).agg(F.count("*").alias("n"), F.percentile("part", 0.5).alias("part"))
    return by.select("bin", "n", F.round(F.max("part").over(Window.orderBy("bin")), 9).alias("curve"))


@query(
    "dq_score",
    """WITH t AS (SELECT o_custkey AS k, unnest([CASE WHEN o_totalprice > 300000 THEN 'large' END, CASE WHEN o_orderstatus = 'P' THEN 'partial' END, CASE WHEN o_orderpriority LIKE '1%' THEN 'urgent' END]) AS token FROM orders)
    SELECT k, 1 - least(count(DISTINCT token), 5) / 5.0 AS score FROM t GROUP BY k""",
)
def dq_score(spark, sf_dir):
    """1 minus a fifth for each distinct token a key has collected."""
    note = add_token(add_token(add_token(F.lit(None).cast("string"), F.col("o_totalprice") > 300000, "large"), F.col("o_orderstatus") == "P", "partial"), F.col("o_orderpriority").startswith("1"), "urgent")
    rows = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.explode_outer(F.split(F.when(note != "", F.regexp_replace(note, "^;", "")), ";")).alias("token"))
    return rows.groupBy("k").agg((1 - F.least(F.count_distinct("token"), F.lit(5)) / 5.0).alias("score"))


@query(
    "asof_effective_rule",
    """WITH r(segment, since, days) AS (VALUES ('BUILDING', TIMESTAMP '1992-01-01', 30), ('BUILDING', TIMESTAMP '1995-01-01', 45), ('MACHINERY', TIMESTAMP '1994-06-01', 60)),
    o AS (SELECT o_orderkey, c_mktsegment AS segment, o_orderdate AS "at" FROM orders JOIN customer ON c_custkey = o_custkey)
    SELECT o_orderkey, arg_max(days, since) AS days FROM o LEFT JOIN r ON r.segment = o.segment AND since <= o."at" GROUP BY 1""",
)
def asof_effective_rule(spark, sf_dir):
    """The norm in force for an order's segment at its date."""
    rules = spark.createDataFrame([("BUILDING", "1992-01-01", 30), ("BUILDING", "1995-01-01", 45), ("MACHINERY", "1994-06-01", 60)], "segment string, since string, days int").withColumn("since", F.col("since").cast("timestamp_ntz"))
    orders = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", F.col("c_mktsegment").alias("segment"), F.col("o_orderdate").alias("at"))
    return temporal.effective_rule(orders, rules, ["segment"], "at", "since", ["days"]).select("o_orderkey", "days")
