"""Row rules, quarantine, duplicates and coverage checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def failed_rules(rules: list[tuple[str, Column]]) -> Column:
    """Names of the rules whose condition holds, in order; a null condition does not."""
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in rules]))


def split_by_rules(df: DataFrame, rules: list[tuple[str, Column]]) -> tuple[DataFrame, DataFrame]:
    """Rows that pass all rules, and one row for each failed rule of the others (rule_id)."""
    marked = df.withColumn("_failed", failed_rules(rules))
    kept = marked.where(F.size("_failed") == 0).drop("_failed")
    return kept, marked.withColumn("rule_id", F.explode("_failed")).drop("_failed")


def dedupe(df: DataFrame, keys: list[str], rank: Column, complete: list[str], tie: str) -> DataFrame:
    """Of each key the row of lowest rank, then most non-null columns, then lowest tie, its nulls filled from the
    others in that order."""
    filled = sum((F.col(c).isNotNull().cast("int") for c in complete), F.lit(0))
    order = F.struct(rank.alias("r"), (-filled).alias("f"), F.col(tie).alias("t"))
    best = {c: F.min_by(c, F.when(F.col(c).isNotNull(), order)).alias(c) for c in complete}
    return df.groupBy(*keys).agg(F.min_by(tie, order).alias(tie), *best.values(), F.count("*").alias("n_rows"))


def calendar(df: DataFrame, period: str, key: str) -> DataFrame:
    """Every period between the first and last of each key, and whether df has it. Periods are integers."""
    spans = df.groupBy(key).agg(F.min(period).alias("a"), F.max(period).alias("b"))
    all_ = spans.select(key, F.explode(F.sequence("a", "b")).alias(period))
    seen = df.select(key, period).distinct().withColumn("_seen", F.lit(True))
    return all_.join(seen, [key, period], "left").withColumn("present", F.coalesce("_seen", F.lit(False))).drop("_seen")


def repeats(df: DataFrame, keys: list[str], by: str, columns: list[str]) -> DataFrame:
    """df with stale: all columns equal those of the key's row before."""
    w = Window.partitionBy(*keys).orderBy(by)
    same = F.lit(True)
    for c in columns:
        same = same & F.col(c).eqNullSafe(F.lag(c).over(w))
    return df.withColumn("stale", same & (F.row_number().over(w) > 1))


def list_overlap(df: DataFrame, report: str, item: str) -> DataFrame:
    """Share of each report's items that the report before (report - 1) has too."""
    before = df.select((F.col(report) + 1).alias(report), item).distinct().withColumn("_was", F.lit(1))
    rows = df.select(report, item).distinct().join(before, [report, item], "left")
    return rows.groupBy(report).agg(F.count("*").alias("items"), (F.count("_was") / F.count("*")).alias("overlap"))


def orphans(df: DataFrame, parent: DataFrame, key: str, parent_key: str) -> DataFrame:
    return df.join(parent.select(F.col(parent_key).alias(key)).distinct(), key, "left_anti")


def conflicting(df: DataFrame, key: str, attributes: list[str]) -> DataFrame:
    """Keys with more than one value of an attribute, and how many of each."""
    by = df.groupBy(key).agg(*[F.count_distinct(a).alias(a) for a in attributes])
    any_ = F.lit(False)
    for a in attributes:
        any_ = any_ | (F.col(a) > 1)
    return by.where(any_)
