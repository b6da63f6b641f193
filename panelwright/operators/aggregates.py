"""Aggregates beyond the built-in ones, each as one groupBy or window plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.operators import ordering


def last_valid(value: str, order: Column) -> Column:
    """Non-null value of the row that is last in order."""
    return F.max_by(F.col(value), F.when(F.col(value).isNotNull(), order))


def first_valid(value: str, order: Column) -> Column:
    return F.min_by(F.col(value), F.when(F.col(value).isNotNull(), order))


def mode(df: DataFrame, keys: list[str], value: str, largest: bool = False) -> DataFrame:
    """Most frequent non-null value of each group; ties to the smallest, or largest, value."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*keys).orderBy(F.desc("n"), F.desc(value) if largest else F.asc(value))
    return counts.withColumn("_p", F.row_number().over(w)).where("_p = 1").drop("_p")


def quartiles(value: str) -> Column:
    return F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))


def joined(value: str) -> Column:
    """Sorted distinct parts of delimited sets, delimited by ;."""
    parts = F.flatten(F.collect_set(F.split(F.col(value), ";")))
    return F.array_join(F.array_sort(F.array_distinct(F.filter(parts, lambda p: p != ""))), ";")


def calibration_bins(df: DataFrame, p: str, y: str, bins: int = 10) -> DataFrame:
    """Rows, mean probability and rate of each probability bin."""
    return df.groupBy(F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("mean_p"), F.avg(F.col(y).cast("double")).alias("rate"))


def expected_calibration_error(binned: DataFrame) -> DataFrame:
    return binned.agg((F.sum(F.col("n") * F.abs(F.col("mean_p") - F.col("rate"))) / F.sum("n")).alias("ece"))


def ranked_outcomes(df: DataFrame, groups: list[str], score: str, y: str) -> DataFrame:
    """Rows and positives of each distinct score, with those at or above it: what the rank metrics need.

    Scores are grouped first, so a window holds distinct scores of one group, not rows.
    """
    by = df.groupBy(*groups, score).agg(F.count("*").alias("n"), F.sum(F.col(y).cast("long")).alias("pos"))
    w = Window.partitionBy(*groups).orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, 0)
    return by.withColumn("cum_n", F.sum("n").over(w)).withColumn("cum_pos", F.sum("pos").over(w))


def average_precision(df: DataFrame, groups: list[str], score: str, y: str) -> DataFrame:
    """Average precision of each group, tied scores as one step; null without positives."""
    steps = ranked_outcomes(df, groups, score, y)
    return steps.groupBy(*groups).agg((F.try_divide(F.sum(F.col("pos") * F.col("cum_pos") / F.col("cum_n")), F.sum("pos").cast("double"))).alias("ap"))


def roc_auc(df: DataFrame, groups: list[str], score: str, y: str) -> DataFrame:
    """Chance that a positive outranks a negative, ties half; null with one class only."""
    steps = ranked_outcomes(df, groups, score, y)
    below = F.col("neg_all") - (F.col("cum_n") - F.col("cum_pos"))
    totals = steps.groupBy(*groups).agg(F.sum("pos").alias("pos_all"), F.sum(F.col("n") - F.col("pos")).alias("neg_all"))
    joined_ = steps.join(totals, groups) if groups else steps.crossJoin(F.broadcast(totals))
    won = F.sum(F.col("pos") * (below + 0.5 * (F.col("n") - F.col("pos"))))
    return joined_.groupBy(*groups).agg(F.try_divide(won, (F.max("pos_all") * F.max("neg_all")).cast("double")).alias("auc"))


def top_k_hits(df: DataFrame, groups: list[str], score: str, y: str, k: int) -> DataFrame:
    """Positives expected among the k highest scores, ties at the edge shared out evenly."""
    steps = ranked_outcomes(df, groups, score, y)
    before = F.col("cum_n") - F.col("n")
    share = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.lit(k) - before) / F.col("n")))
    return steps.groupBy(*groups).agg(F.sum(F.col("pos") * share).alias("hits"))


def pinball(y: Column, q: Column, level: float) -> Column:
    return F.greatest(F.lit(level) * (y - q), F.lit(level - 1) * (y - q))


def mantel_haenszel(df: DataFrame, strata: list[str], flag: str, y: str) -> DataFrame:
    """Risk ratio of the flag over strata."""
    cell = lambda f, v: F.count_if((F.col(flag) == f) & (F.col(y) == v))
    by = df.groupBy(*strata).agg(cell(True, True).alias("a"), cell(True, False).alias("b"), cell(False, True).alias("c"), cell(False, False).alias("d"), F.count("*").alias("n"))
    up = F.sum(F.col("a") * (F.col("c") + F.col("d")) / F.col("n"))
    down = F.sum(F.col("c") * (F.col("a") + F.col("b")) / F.col("n"))
    return by.agg(F.try_divide(up, down).alias("mh_ratio"))


def holm(df: DataFrame, p: str, key: str) -> DataFrame:
    """df with Holm step-down p values, in ranges of p; a null p has no adjusted value of its own but counts as a test."""
    n = df.count()
    placed = ordering.numbered(ordering.in_ranges(df, p, key), [p, key], "_place")
    adjusted = placed.withColumn("_a", F.col(p) * (n - F.col("_place") + 1))
    most = ordering.running(adjusted, [p, key], most={"_most": F.col("_a")})
    return most.withColumn("p_holm", F.least(F.lit(1.0), F.col("_most"))).drop("_a", "_most", "_place", ordering.RANGE)


def weighted_precision(df: DataFrame, score: str, label: Column, weight: Column) -> DataFrame:
    """Weighted average precision, ap: the precision at each score's rows and those above, over the positives' weight. Rows of equal score
    count together, those without a score not at all; null without a positive."""
    known = df.where(F.col(score).isNotNull())
    by = known.groupBy(F.col(score).alias("s")).agg(F.sum(weight * label.cast("int")).alias("p"), F.sum(weight).alias("n"))
    down = F.desc("s")
    upto = ordering.running(ordering.in_ranges(by, down), [down], {"cp": F.col("p"), "cn": F.col("n")})
    return upto.agg(F.try_divide(F.sum(F.try_divide(F.col("p") * F.col("cp"), F.col("cn"))), F.sum("p")).alias("ap"))


def reconcile(parts: DataFrame, totals: DataFrame, keys: list[str], value: str, tolerance: float = 0.005) -> DataFrame:
    """Sum of parts beside the printed total, and whether they differ by more than the tolerance."""
    summed = parts.groupBy(*keys).agg(F.sum(value).alias("computed"))
    out = summed.join(totals.select(*keys, F.col(value).alias("printed")), keys, "full")
    off = F.abs(F.col("computed") - F.col("printed")) > F.lit(tolerance) * F.abs(F.col("printed"))
    return out.withColumn("mismatch", F.coalesce(off, F.lit(True)))


def bootstrap_means(df: DataFrame, cluster: str, value: str, n_boot: int, seed: int) -> DataFrame:
    """Mean of value in each of n_boot cluster resamples with Poisson(1) weights.

    Clusters are summed first; a cluster's weight in a resample depends on its key, the resample and the seed alone, so
    reruns agree however rows are dealt.
    """
    sums = df.groupBy(cluster).agg(F.sum(value).alias("s"), F.count(value).alias("n"))
    draws = sums.select(cluster, "s", "n", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))).alias("b"))
    u = F.pmod(F.xxhash64(cluster, "b", F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    weight, reach, chance = F.lit(0), 0.36787944117144233, 0.36787944117144233
    for k in range(1, 8):
        weight = weight + (u >= reach).cast("int")
        chance /= k
        reach += chance
    weighted = draws.withColumn("w", weight)
    return weighted.groupBy("b").agg(F.try_divide(F.sum(F.col("w") * F.col("s")), F.sum(F.col("w") * F.col("n")).cast("double")).alias("mean"))


def interval(boot: DataFrame, value: str = "mean", level: float = 0.9) -> DataFrame:
    a = (1 - level) / 2
    return boot.agg(F.percentile(value, a).alias("lo"), F.percentile(value, 1 - a).alias("hi"))
