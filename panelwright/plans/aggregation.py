"""Aggregates: conditional, exact quantiles, modes, grouping sets, shrinkage, tests and rank metrics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from panelwright.functions.scalars import shrink, wilson
from panelwright.operators import aggregates as A
from panelwright.plans.registry import query
from panelwright.sources.tables import read


@query(
    "agg_basic",
    """SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 4) AS qty, round(avg(l_discount), 9) AS disc, min(l_shipdate) AS first_ship, max(l_shipdate) AS last_ship,
      count(DISTINCT l_suppkey) AS suppliers, bool_or(l_quantity > 49) AS any_large, bool_and(l_tax >= 0) AS all_taxed FROM lineitem GROUP BY 1, 2""",
)
def agg_basic(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.count("*").alias("n"),
        F.round(F.sum("l_quantity"), 4).alias("qty"),
        F.round(F.avg("l_discount"), 9).alias("disc"),
        F.min("l_shipdate").alias("first_ship"),
        F.max("l_shipdate").alias("last_ship"),
        F.count_distinct("l_suppkey").alias("suppliers"),
        F.bool_or(F.col("l_quantity") > 49).alias("any_large"),
        F.bool_and(F.col("l_tax") >= 0).alias("all_taxed"),
    )


@query(
    "agg_filter",
    """SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus = 'O') AS open, count(*) FILTER (WHERE o_orderstatus = 'F') AS closed, round(sum(o_totalprice) FILTER (WHERE o_orderpriority LIKE '1%'), 4) AS urgent,
      round(avg(CASE WHEN o_totalprice IS NOT NULL THEN 1.0 ELSE 0 END), 6) AS known FROM orders GROUP BY 1""",
)
def agg_filter(spark, sf_dir):
    return read(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.count_if(F.col("o_orderstatus") == "O").alias("open"),
        F.count_if(F.col("o_orderstatus") == "F").alias("closed"),
        F.round(F.sum(F.when(F.col("o_orderpriority").startswith("1"), F.col("o_totalprice"))), 4).alias("urgent"),
        F.round(F.avg(F.col("o_totalprice").isNotNull().cast("double")), 6).alias("known"),
    )


@query("agg_median_iqr", "SELECT l_suppkey, round(quantile_cont(l_extendedprice, 0.25), 6) AS q1, round(median(l_extendedprice), 6) AS q2, round(quantile_cont(l_extendedprice, 0.75), 6) AS q3 FROM lineitem GROUP BY 1")
def agg_median_iqr(spark, sf_dir):
    by = read(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(A.quartiles("l_extendedprice").alias("q"))
    return by.select("l_suppkey", *[F.round(F.col("q")[i], 6).alias(f"q{i + 1}") for i in range(3)])


@query(
    "agg_mode",
    "WITH c AS (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2) SELECT o_custkey, o_orderpriority, n FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, o_orderpriority) AS p FROM c) WHERE p = 1",
)
def agg_mode(spark, sf_dir):
    return A.mode(read(spark, sf_dir, "orders"), ["o_custkey"], "o_orderpriority")


@query(
    "agg_last_valid",
    """SELECT o_custkey, arg_max(CASE WHEN o_totalprice > 150000 THEN o_totalprice END, row(o_orderdate, o_orderkey)) FILTER (WHERE o_totalprice > 150000) AS last_high,
      arg_min(CASE WHEN o_totalprice > 150000 THEN o_totalprice END, row(o_orderdate, o_orderkey)) FILTER (WHERE o_totalprice > 150000) AS first_high FROM orders GROUP BY 1""",
)
def agg_last_valid(spark, sf_dir):
    order = F.struct("o_orderdate", "o_orderkey")
    high = read(spark, sf_dir, "orders").withColumn("high", F.when(F.col("o_totalprice") > 150000, F.col("o_totalprice")))
    return high.groupBy("o_custkey").agg(A.last_valid("high", order).alias("last_high"), A.first_valid("high", order).alias("first_high"))


@query(
    "agg_grouping_sets",
    "SELECT coalesce(o_orderstatus, '*') AS status, coalesce(o_orderpriority, '*') AS priority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderstatus), ())",
)
def agg_grouping_sets(spark, sf_dir):
    orders = read(spark, sf_dir, "orders")
    by = orders.groupingSets([["o_orderstatus", "o_orderpriority"], ["o_orderstatus"], []], "o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    return by.select(F.coalesce("o_orderstatus", F.lit("*")).alias("status"), F.coalesce("o_orderpriority", F.lit("*")).alias("priority"), "n", "total")


@query(
    "agg_pivot",
    "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS F, count(*) FILTER (WHERE o_orderstatus = 'O') AS O, count(*) FILTER (WHERE o_orderstatus = 'P') AS P FROM orders GROUP BY 1",
)
def agg_pivot(spark, sf_dir):
    return read(spark, sf_dir, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).count().fillna(0)


@query(
    "agg_joined_sets",
    "SELECT o_custkey, string_agg(DISTINCT o_orderpriority, ';' ORDER BY o_orderpriority) AS priorities FROM orders GROUP BY 1",
)
def agg_joined_sets(spark, sf_dir):
    return read(spark, sf_dir, "orders").groupBy("o_custkey").agg(A.joined("o_orderpriority").alias("priorities"))


@query(
    "agg_list_structs",
    """SELECT o_custkey, string_agg(o_orderkey || ':' || o_orderstatus, ',' ORDER BY o_orderdate, o_orderkey) AS history FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1""",
)
def agg_list_structs(spark, sf_dir):
    rows = F.sort_array(F.collect_list(F.struct("o_orderdate", "o_orderkey", "o_orderstatus")))
    by = read(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").groupBy("o_custkey").agg(rows.alias("r"))
    return by.select("o_custkey", F.array_join(F.transform("r", lambda x: F.concat_ws(":", x["o_orderkey"], x["o_orderstatus"])), ",").alias("history"))


@query(
    "agg_shrink",
    """WITH g AS (SELECT c_nationkey, avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0 END) AS r, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS s, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1)
    SELECT c_nationkey, n, round((s + 10 * (SELECT sum(s) / sum(n) FROM g)) / (n + 10), 9) AS rate FROM g""",
)
def agg_shrink(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    by = orders.groupBy("c_nationkey").agg(F.count_if(F.col("o_orderstatus") == "F").alias("s"), F.count("*").alias("n"))
    prior = by.agg((F.sum("s") / F.sum("n")).alias("prior"))
    return by.crossJoin(F.broadcast(prior)).select("c_nationkey", "n", F.round(shrink(F.col("s"), F.col("n"), F.col("prior")), 9).alias("rate"))


@query(
    "agg_wilson",
    """WITH g AS (SELECT l_returnflag, count(*) FILTER (WHERE l_discount > 0.05) AS k, count(*)::DOUBLE AS n FROM lineitem GROUP BY 1)
    SELECT l_returnflag, round((k/n + 3.8416/(2*n)) / (1 + 3.8416/n) - 1.96*sqrt(k/n*(1-k/n)/n + 3.8416/(4*n*n)) / (1 + 3.8416/n), 9) AS lo,
      round((k/n + 3.8416/(2*n)) / (1 + 3.8416/n) + 1.96*sqrt(k/n*(1-k/n)/n + 3.8416/(4*n*n)) / (1 + 3.8416/n), 9) AS hi FROM g""",
)
def agg_wilson(spark, sf_dir):
    by = read(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.count_if(F.col("l_discount") > 0.05).alias("k"), F.count("*").alias("n"))
    lo, hi = wilson(F.col("k"), F.col("n").cast("double"))
    return by.select("l_returnflag", F.round(lo, 9).alias("lo"), F.round(hi, 9).alias("hi"))


_MH = "t AS (SELECT o_orderpriority AS s, o_totalprice > 200000 AS f, o_orderstatus = 'F' AS y FROM orders)"


def _outcomes(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_orderpriority").alias("s"), (F.col("o_totalprice") > 200000).alias("f"), (F.col("o_orderstatus") == "F").alias("y"), (F.floor(F.col("o_totalprice") / 5000) / 100).alias("p"))


@query(
    "agg_mantel_haenszel",
    f"""WITH {_MH}, g AS (SELECT s, count(*) FILTER (WHERE f AND y) AS a, count(*) FILTER (WHERE f AND NOT y) AS b, count(*) FILTER (WHERE NOT f AND y) AS c, count(*) FILTER (WHERE NOT f AND NOT y) AS d, count(*) AS n FROM t GROUP BY s)
    SELECT sum(a * (c + d) / n) / sum(c * (a + b) / n) AS mh_ratio FROM g""",
)
def agg_mantel_haenszel(spark, sf_dir):
    return A.mantel_haenszel(_outcomes(spark, sf_dir), ["s"], "f", "y")


@query(
    "agg_rates_lift",
    f"""WITH {_MH} SELECT s, round(avg(CASE WHEN f THEN y::INT END), 9) AS with_flag, round(avg(CASE WHEN NOT f THEN y::INT END), 9) AS without, round(avg(CASE WHEN f THEN y::INT END) / avg(CASE WHEN NOT f THEN y::INT END), 9) AS lift FROM t GROUP BY s""",
)
def agg_rates_lift(spark, sf_dir):
    y = F.col("y").cast("int")
    with_flag, without = F.avg(F.when(F.col("f"), y)), F.avg(F.when(~F.col("f"), y))
    return _outcomes(spark, sf_dir).groupBy("s").agg(F.round(with_flag, 9).alias("with_flag"), F.round(without, 9).alias("without"), F.round(F.try_divide(with_flag, without), 9).alias("lift"))


@query(
    "agg_holm",
    """WITH p AS (SELECT c_nationkey AS k, (count(*) % 17) / 400.0 AS p FROM customer GROUP BY 1), r AS (SELECT *, p * (count(*) OVER () - row_number() OVER (ORDER BY p, k) + 1) AS a FROM p)
    SELECT k, round(p, 9) AS p, round(least(1.0, max(a) OVER (ORDER BY p, k ROWS UNBOUNDED PRECEDING)), 9) AS p_holm FROM r""",
)
def agg_holm(spark, sf_dir):
    p = read(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("k")).agg((F.count("*") % 17 / 400.0).alias("p"))
    return A.holm(p, "p", "k").select("k", F.round("p", 9).alias("p"), F.round("p_holm", 9).alias("p_holm"))


_SCORES = "t AS (SELECT o_orderpriority AS s, floor(o_totalprice / 5000) / 100 AS p, (o_orderstatus = 'F')::INT AS y FROM orders)"


@query(
    "agg_calibration",
    f"WITH {_SCORES} SELECT CAST(least(floor(p * 10), 9) AS INTEGER) AS bin, count(*) AS n, round(avg(p), 9) AS mean_p, round(avg(y), 9) AS rate FROM t GROUP BY 1",
)
def agg_calibration(spark, sf_dir):
    return A.calibration_bins(_outcomes(spark, sf_dir), "p", "y").select("bin", "n", F.round("mean_p", 9).alias("mean_p"), F.round("rate", 9).alias("rate"))


@query(
    "agg_ece",
    f"WITH {_SCORES}, b AS (SELECT least(floor(p * 10), 9) AS bin, count(*) AS n, avg(p) AS m, avg(y) AS r FROM t GROUP BY 1) SELECT round(sum(n * abs(m - r)) / sum(n), 9) AS ece FROM b",
)
def agg_ece(spark, sf_dir):
    return A.expected_calibration_error(A.calibration_bins(_outcomes(spark, sf_dir), "p", "y")).select(F.round("ece", 9).alias("ece"))


@query(
    "agg_average_precision",
    f"""WITH {_SCORES}, g AS (SELECT s, p, count(*) AS n, sum(y) AS pos FROM t GROUP BY s, p), c AS (SELECT *, sum(n) OVER w AS cn, sum(pos) OVER w AS cp FROM g WINDOW w AS (PARTITION BY s ORDER BY p DESC))
    SELECT s, round(sum(pos * cp / cn) / sum(pos), 9) AS ap FROM c GROUP BY s""",
)
def agg_average_precision(spark, sf_dir):
    return A.average_precision(_outcomes(spark, sf_dir), ["s"], "p", "y").select("s", F.round("ap", 9).alias("ap"))


@query(
    "agg_roc_auc",
    f"WITH {_SCORES}, r AS (SELECT s, y, rank() OVER (PARTITION BY s ORDER BY p) + (count(*) OVER (PARTITION BY s, p) - 1) / 2.0 AS r FROM t) SELECT s, round((sum(r * y) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))), 9) AS auc FROM r GROUP BY s",
)
def agg_roc_auc(spark, sf_dir):
    return A.roc_auc(_outcomes(spark, sf_dir), ["s"], "p", "y").select("s", F.round("auc", 9).alias("auc"))


@query(
    "agg_topk_hits",
    f"""WITH {_SCORES}, g AS (SELECT s, p, count(*) AS n, sum(y) AS pos FROM t GROUP BY s, p), c AS (SELECT *, sum(n) OVER (PARTITION BY s ORDER BY p DESC) - n AS before FROM g)
    SELECT s, round(sum(pos * least(1.0, greatest(0.0, (50 - before) / n))), 9) AS hits FROM c GROUP BY s""",
)
def agg_topk_hits(spark, sf_dir):
    return A.top_k_hits(_outcomes(spark, sf_dir), ["s"], "p", "y", 50).select("s", F.round("hits", 9).alias("hits"))


@query(
    "agg_pinball_brier",
    f"WITH {_SCORES} SELECT s, round(avg(greatest(0.9 * (y - p), -0.1 * (y - p))), 9) AS pinball, round(avg((p - y) * (p - y)), 9) AS brier FROM t GROUP BY s",
)
def agg_pinball_brier(spark, sf_dir):
    y = F.col("y").cast("int")
    return _outcomes(spark, sf_dir).groupBy("s").agg(F.round(F.avg(A.pinball(y, F.col("p"), 0.9)), 9).alias("pinball"), F.round(F.avg((F.col("p") - y) * (F.col("p") - y)), 9).alias("brier"))


@query(
    "agg_slices",
    """WITH t AS (SELECT o_orderstatus = 'F' AS y, o_orderpriority AS a, CASE WHEN o_totalprice > 100000 THEN 'big' ELSE 'small' END AS b FROM orders),
    u AS (SELECT 'priority' AS slice, a AS value, y FROM t UNION ALL SELECT 'size', b, y FROM t)
    SELECT slice, value, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY slice), 9) AS share, round(avg(y::INT), 9) AS rate FROM u GROUP BY slice, value""",
)
def agg_slices(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").select((F.col("o_orderstatus") == "F").cast("int").alias("y"), F.col("o_orderpriority").alias("priority"), F.when(F.col("o_totalprice") > 100000, "big").otherwise("small").alias("size"))
    long = rows.unpivot(["y"], ["priority", "size"], "slice", "value")
    by = long.groupBy("slice", "value").agg(F.count("*").alias("n"), F.round(F.avg("y"), 9).alias("rate"))
    return by.select("slice", "value", "n", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("slice")), 9).alias("share"), "rate")


@query(
    "agg_having_duplicates",
    "SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY 1, 2 HAVING count(*) > 10",
)
def agg_having_duplicates(spark, sf_dir):
    return read(spark, sf_dir, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n")).where("n > 10")


@query(
    "agg_reconcile",
    """WITH p AS (SELECT l_orderkey AS o, sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)) AS computed FROM lineitem GROUP BY 1)
    SELECT coalesce(o, o_orderkey) AS o, round(computed, 6) AS computed, round(o_totalprice, 4) AS printed, coalesce(abs(computed - o_totalprice) > 0.005 * abs(o_totalprice), true) AS mismatch FROM p FULL JOIN orders ON o = o_orderkey""",
)
def agg_reconcile(spark, sf_dir):
    net = F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))
    parts = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o"), net.alias("value"))
    totals = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("o"), F.col("o_totalprice").alias("value"))
    return A.reconcile(parts, totals, ["o"], "value").select("o", F.round("computed", 6).alias("computed"), F.round("printed", 4).alias("printed"), "mismatch")


@query("agg_bootstrap")
def agg_bootstrap(spark, sf_dir):
    """90% interval of the mean order value by resampling customers."""
    return A.interval(A.bootstrap_means(read(spark, sf_dir, "orders"), "o_custkey", "o_totalprice", 200, 7))


@query(
    "agg_portfolio",
    """SELECT coalesce(c_mktsegment, '*') AS segment, count(*) AS customers, round(sum(c_acctbal), 2) AS balance, count(*) FILTER (WHERE c_acctbal < 0) AS negative FROM customer GROUP BY GROUPING SETS ((c_mktsegment), ())""",
)
def agg_portfolio(spark, sf_dir):
    by = read(spark, sf_dir, "customer").groupingSets([["c_mktsegment"], []], "c_mktsegment").agg(F.count("*").alias("customers"), F.round(F.sum("c_acctbal"), 2).alias("balance"), F.count_if(F.col("c_acctbal") < 0).alias("negative"))
    return by.select(F.coalesce("c_mktsegment", F.lit("*")).alias("segment"), "customers", "balance", "negative")


@query(
    "agg_winsor_standard",
    """WITH b AS (SELECT quantile_cont(o_totalprice, 0.01) AS lo, quantile_cont(o_totalprice, 0.99) AS hi FROM orders), w AS (SELECT o_orderkey, least(greatest(o_totalprice, lo), hi) AS v FROM orders CROSS JOIN b)
    SELECT o_orderkey, round((v - (SELECT avg(v) FROM w)) / (SELECT stddev_samp(v) FROM w), 6) AS z FROM w""",
)
def agg_winsor_standard(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    bounds = orders.agg(F.percentile("o_totalprice", F.array(F.lit(0.01), F.lit(0.99))).alias("b"))
    clipped = orders.crossJoin(F.broadcast(bounds)).select("o_orderkey", F.least(F.greatest("o_totalprice", F.col("b")[0]), F.col("b")[1]).alias("v"))
    moments = clipped.agg(F.avg("v").alias("m"), F.stddev_samp("v").alias("s"))
    return clipped.crossJoin(F.broadcast(moments)).select("o_orderkey", F.round((F.col("v") - F.col("m")) / F.col("s"), 6).alias("z"))
