"""Scores, bands, words and priors as columns and small plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bands of a chance and of a slip in months, and words of a rank's third.
CHANCES = ((0.75, "very likely"), (0.5, "likely"), (0.25, "possible"))
STRENGTHS = ("strong", "moderate", "slight")
#: Parts of the rule score as weight and the value that counts as 100.
RULE_PARTS = {"overrun": (0.30, 81.4), "delay": (0.30, 75.0), "undone": (0.25, 100.0), "spend": (0.15, 1.5)}


def chance_word(p: Column) -> Column:
    out = F.when(p.isNull() | F.isnan(p), F.lit(None).cast("string"))
    for least, word in CHANCES:
        out = out.when(p >= least, word)
    return out.otherwise("unlikely")


def slip_word(months: Column) -> Column:
    return F.when(months < 6, "under 6 months").when(months < 12, "6 to 12 months").when(months <= 24, "1 to 2 years").when(months > 24, "over 2 years")


def rule_score(overrun: Column, delay: Column, done: Column, spend: Column) -> Column:
    """Weighted sum of parts clipped to 0 to 100; a missing part counts as 0, missing progress as none."""
    part = lambda value, top: F.least(F.greatest(F.coalesce(value, F.lit(0.0)) / F.lit(top) * 100, F.lit(0.0)), F.lit(100.0))
    values = {"overrun": overrun, "delay": delay, "undone": 100 - F.coalesce(done, F.lit(0.0)), "spend": spend}
    return sum((F.lit(w) * part(values[name], top) for name, (w, top) in RULE_PARTS.items()), F.lit(0.0))


def complexity(conditions: list[Column]) -> Column:
    """One point for each condition that holds; an unknown one gives none."""
    return sum((F.coalesce(c, F.lit(False)).cast("int") for c in conditions), F.lit(0))


def composite(first: Column, second: Column) -> tuple[Column, Column]:
    """Mean of two parts, or the first alone where the second is unknown, and which it was."""
    return F.coalesce((first + second) / 2, first), F.when(second.isNotNull(), "both").otherwise("first_only")


def half_away(x: Column, digits: int = 0) -> Column:
    """Rounded with halves away from zero."""
    scale = 10**digits
    return F.signum(x) * F.floor(F.abs(x) * scale + 0.5) / scale


def thirds(df: DataFrame, groups: list[str], size: Column) -> DataFrame:
    """df with ``strength``: the third of a row by size within its group; rows of equal size share the first one's, and
    rows of no size have none and do not count."""
    counted = df.withColumn("_size", F.when(size > 0, size))
    w = Window.partitionBy(*groups)
    place = F.rank().over(w.orderBy(F.col("_size").desc_nulls_last())) - 1
    third = F.floor(3 * place / F.count("_size").over(w)).cast("int")
    return counted.withColumn("strength", F.when(F.col("_size").isNotNull(), F.element_at(F.array(*map(F.lit, STRENGTHS)), third + 1))).drop("_size")


def never_null(train: DataFrame, columns: list[str]) -> list[str]:
    """Those of the columns that have no null in train."""
    counts = train.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns]).first()
    return [c for c in columns if not counts[c]]


def unscorable(rows: DataFrame, train: DataFrame, columns: list[str]) -> Column:
    """Whether a row has a null where training had none."""
    out = F.lit(False)
    for c in never_null(train, columns):
        out = out | F.col(c).isNull()
    return out


def stratified_difference(rows: DataFrame, value: str, strata: list[str], group: str) -> DataFrame:
    """Mean difference of rows in a group (true) and out of it, over strata that have both, weighted by the group's
    rows; with the means as weighted, the strata used and the share of the group's rows in them."""
    y = F.col(value)
    by = rows.where(y.isNotNull()).groupBy(*strata).agg(*[f(F.when(F.col(group) == flag, y)).alias(n) for n, f, flag in (("n1", F.count, True), ("n0", F.count, False), ("s1", F.sum, True), ("s0", F.sum, False))])
    used = (F.col("n1") > 0) & (F.col("n0") > 0)
    weight = F.sum(F.when(used, F.col("n1")))
    in_group = F.sum(F.when(used, F.col("s1"))) / weight
    outside = F.sum(F.when(used, F.col("n1") * F.col("s0") / F.col("n0"))) / weight
    return by.agg(F.count_if(used).alias("strata"), in_group.alias("mean_in"), outside.alias("mean_out"), (in_group - outside).alias("extra"), (weight / F.sum("n1")).alias("matched"))


def blocks(df: DataFrame, q: str) -> DataFrame:
    """First and last of each run of consecutive integers q."""
    w = Window.orderBy(q)
    # One row a period: as many as there are quarters on record.
    runs = df.select(q).distinct().withColumn("_run", F.col(q) - F.row_number().over(w))
    return runs.groupBy("_run").agg(F.min(q).alias("first"), F.max(q).alias("last")).drop("_run")
