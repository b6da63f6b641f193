"""Intervals by resampled customers: rank metrics of two scores and measured priors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.operators import aggregates, resampling
from panelwright.operators.resampling import poisson_sql, uniform_sql
from panelwright.plans.panel import PANEL_SQL, labels, panel
from panelwright.plans.registry import query
from panelwright.sources.tables import read

N_BOOT = 200


def _draws_sql(rows: str) -> str:
    """Weights t of each cluster k of rows in each resample b."""
    return f"SELECT k, b, {poisson_sql('u')} AS t FROM (SELECT k, b, {uniform_sql('k')} AS u FROM (SELECT DISTINCT k FROM {rows}), range({N_BOOT}) r(b))"


@query(
    "agg_paired_precision",
    f"""WITH {PANEL_SQL}, l AS (SELECT a.k, a.q, a.x, CAST(a.n AS DOUBLE) AS n, CAST(b.x >= 1.05 * a.x AS INTEGER) AS y FROM panel a JOIN panel b ON a.k = b.k AND b.q = a.q + 1 WHERE a.x > 0),
    w AS ({_draws_sql('l')}), m AS (SELECT k, q, y, 'first' AS m, -x AS score FROM l UNION ALL SELECT k, q, y, 'second', n FROM l),
    s AS (SELECT q, b, m, score, sum(t) AS n, sum(t * y) AS pos FROM m JOIN w USING (k) GROUP BY ALL),
    c AS (SELECT *, sum(n) OVER o AS cn, sum(pos) OVER o AS cp FROM s WINDOW o AS (PARTITION BY q, b, m ORDER BY score DESC)),
    p AS (SELECT q, b, m, sum(CASE WHEN cn > 0 THEN pos * cp / cn ELSE 0 END) / nullif(sum(pos), 0) AS ap FROM c GROUP BY ALL),
    g AS (SELECT b, avg(ap) FILTER (WHERE m = 'first') AS f, avg(ap) FILTER (WHERE m = 'second') AS s FROM p GROUP BY b)
    SELECT round(avg(f), 9) AS ap_first, round(avg(s), 9) AS ap_second, round(quantile_cont(s - f, 0.05), 9) AS lo, round(quantile_cont(s - f, 0.5), 9) AS middle, round(quantile_cont(s - f, 0.95), 9) AS hi, count(*) AS resamples FROM g""",
)
def agg_paired_precision(spark, sf_dir):
    """Gain in within-quarter average precision of one score of a rise, the orders, over another, a low value: interval on the same draws."""
    rows = panel(spark, sf_dir)
    known = labels(rows, 1).where("y_rise IS NOT NULL").select("k", "q", F.col("y_rise").cast("int").alias("y"))
    both = rows.select("k", "q", (-F.col("x")).alias("low"), F.col("n").cast("double").alias("n")).join(known, ["k", "q"])
    boot = resampling.paired_precision(both, "k", "q", "y", "low", "n", N_BOOT)
    cut = lambda p: F.round(F.percentile("gain", p), 9)
    return boot.agg(F.round(F.avg("ap_first"), 9).alias("ap_first"), F.round(F.avg("ap_second"), 9).alias("ap_second"), cut(0.05).alias("lo"), cut(0.5).alias("middle"), cut(0.95).alias("hi"), F.count("*").alias("resamples"))


#: Priors measured on orders: name, rows of the group, rows of the base, and what must match.
PRIORS = [
    ("partly shipped", "o_orderstatus = 'P'", "o_orderstatus = 'O'", ["o_orderpriority", "year"]),
    ("urgent", "o_orderpriority = '1-URGENT'", "o_orderpriority = '5-LOW'", ["o_orderstatus", "year"]),
    ("first half year", "month <= 6", "month > 6", ["o_orderstatus", "o_orderpriority"]),
]


def _prior_sql() -> str:
    def one(name: str, group: str, base: str, strata: list[str]) -> str:
        keys = ", ".join(strata)
        sums = ", ".join(f"{'count' if c[0] == 'n' else 'sum'}(o_totalprice) FILTER (WHERE {group if c[1] == '1' else base}) AS {c}" for c in ("n1", "s1", "n0", "s0"))
        total = lambda more, times: ", ".join(f"sum({times}coalesce({c}, 0)) AS {c}" for c in ("n1", "s1", "n0", "s0"))
        used = "n1 > 0 AND n0 > 0"
        figures = f"(sum(s1) FILTER (WHERE {used}) - sum(n1 * s0 / n0) FILTER (WHERE {used})) / nullif(sum(n1) FILTER (WHERE {used}), 0)"
        return f"""SELECT '{name}' AS prior, p.*, v.* FROM (
          SELECT round({figures}, 4) AS extra, round(sum(s1) / sum(n1), 4) AS mean_in, round(sum(n1 * s0 / n0) FILTER (WHERE {used}) / sum(n1) FILTER (WHERE {used}), 4) AS mean_out, round(sum(n1) FILTER (WHERE {used}) / sum(n1), 6) AS matched
          FROM (SELECT {total('', '')} FROM (SELECT k, {keys}, {sums} FROM o WHERE ({group}) OR ({base}) GROUP BY ALL) GROUP BY {keys})) p,
        (SELECT round(quantile_cont(d, 0.025), 4) AS lo, round(quantile_cont(d, 0.975), 4) AS hi, greatest(least(1.0, 2 * least(avg(CAST(d <= 0 AS INTEGER)), avg(CAST(d >= 0 AS INTEGER)))), 1.0 / {N_BOOT}) AS p
          FROM (SELECT b, {figures} AS d FROM (SELECT b, {keys}, {total('', 't * 1.0 * ')} FROM (SELECT k, {keys}, {sums} FROM o WHERE ({group}) OR ({base}) GROUP BY ALL) JOIN w USING (k) GROUP BY b, {keys}) GROUP BY b) WHERE d IS NOT NULL) v"""

    each = " UNION ALL ".join(one(*p) for p in PRIORS)
    return f"""WITH o AS (SELECT o_custkey AS k, o_totalprice, o_orderstatus, o_orderpriority, year(o_orderdate) AS year, month(o_orderdate) AS month FROM orders),
    w AS ({_draws_sql('o')}), e AS ({each}), h AS (SELECT *, p * (count(*) OVER () - row_number() OVER (ORDER BY p, prior) + 1) AS a FROM e)
    SELECT prior, extra, lo, hi, round(p, 9) AS p, mean_in, mean_out, matched, round(least(1.0, max(a) OVER (ORDER BY p, prior)), 9) AS p_holm FROM h"""


@query("agg_prior_intervals", _prior_sql())
def agg_prior_intervals(spark, sf_dir):
    """Every prior with its interval by resampled customers and its p value corrected for their number."""
    orders = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), "o_totalprice", "o_orderstatus", "o_orderpriority", F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month"))
    found, drawn = [], resampling.draws(orders, "k", N_BOOT)
    for name, group, base, strata in PRIORS:
        rows = orders.withColumn("g", F.expr(group)).withColumn("b0", F.expr(base))
        found.append(resampling.matched_difference(rows, "k", "o_totalprice", strata, "g", "b0", N_BOOT, drawn_=drawn).select(F.lit(name).alias("prior"), "*"))
    every = aggregates.holm(reduce(DataFrame.unionByName, found), "p", "prior")
    return every.select("prior", *[F.round(c, 4).alias(c) for c in ("extra", "lo", "hi", "mean_in", "mean_out")], F.round("p", 9).alias("p"), F.round("matched", 6).alias("matched"), F.round("p_holm", 9).alias("p_holm"))
