"""Joins and set operations with their treatment of nulls, ties and repeats spelled out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def assert_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """df, after checking that no two rows share the keys."""
    if df.groupBy(*keys).count().where("count > 1").take(1):
        raise ValueError(f"rows share {', '.join(keys)}")
    return df


def lookup(df: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """df with the table's columns, at most one row of the table for each key; no row of df is lost or doubled."""
    return df.join(assert_unique(table, keys), keys, "left")


def fallback_lookup(df: DataFrame, tables: list[tuple[str, DataFrame, list[str], Column]], value: str) -> DataFrame:
    """df with value and its basis from the first table that has a row for its keys that passes the table's test."""
    out = df
    for i, (_, table, keys, passes) in enumerate(tables):
        kept = table.where(passes).select(*keys, F.col(value).alias(f"_v{i}"))
        out = out.join(kept, keys, "left") if keys else out.crossJoin(F.broadcast(kept.limit(1)))
    values = [F.col(f"_v{i}") for i in range(len(tables))]
    basis = F.coalesce(*[F.when(v.isNotNull(), F.lit(t[0])) for v, t in zip(values, tables, strict=True)])
    return out.withColumn(value, F.coalesce(*values)).withColumn(f"{value}_basis", basis).drop(*[f"_v{i}" for i in range(len(tables))])


def precedence(df: DataFrame, keys: list[str], step: str) -> DataFrame:
    """Rows of each key's best (lowest) step."""
    return df.withColumn("_best", F.min(step).over(Window.partitionBy(*keys))).where(F.col(step) == F.col("_best")).drop("_best")


def replace_keys(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """new, and the rows of old whose keys it lacks."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def priority_union(frames: list[DataFrame], keys: list[str], order: list[str]) -> DataFrame:
    """Rows of all frames, of each key only the first: the earliest frame's, then by order."""
    tagged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [f.withColumn("_rank", F.lit(i)) for i, f in enumerate(frames)])
    w = Window.partitionBy(*keys).orderBy("_rank", *order)
    return tagged.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_rank")


def agree_or_null(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Full join of two blocks; conflicting values are flagged, a lone one is taken."""
    both = a.select(*keys, F.col(value).alias("_a")).join(b.select(*keys, F.col(value).alias("_b")), keys, "full")
    return both.withColumn(value, F.coalesce("_a", "_b")).withColumn("conflict", F.coalesce(F.col("_a") != F.col("_b"), F.lit(False))).drop("_a", "_b")


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two frames hold the same rows as often."""
    return not a.exceptAll(b).take(1) and not b.exceptAll(a).take(1)


def digest(df: DataFrame) -> DataFrame:
    """Rows and an order-free content hash: a version of a table."""
    row = F.xxhash64(*[F.col(c) for c in sorted(df.columns)])
    return df.agg(F.count("*").alias("n"), F.coalesce(F.sum(row.cast("decimal(38,0)")), F.lit(0)).cast("string").alias("digest"))


def ranked_tiers(df: DataFrame, score: str, key: str, groups: list[str], cuts: list[tuple[float, str]], rest: str, unscored: str) -> DataFrame:
    """df with a tier by rank share within groups; rows without a score get their own tier."""
    scored = F.col(score).isNotNull()
    w = Window.partitionBy(*groups, scored).orderBy(F.desc(score), key)
    share = F.row_number().over(w) / F.count("*").over(Window.partitionBy(*groups, scored))
    out = df.withColumn("_share", share)
    tier = None
    for most, name in cuts:
        tier = F.when(F.col("_share") <= most, F.lit(name)) if tier is None else tier.when(F.col("_share") <= most, F.lit(name))
    return out.withColumn("tier", F.when(scored, tier.otherwise(F.lit(rest))).otherwise(F.lit(unscored))).drop("_share")


def diff(old: DataFrame, new: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Keys added, removed or changed in a column between two snapshots, with old and new values."""
    a = old.select(*keys, *[F.col(c).alias(f"old_{c}") for c in columns], F.lit(1).alias("_a"))
    b = new.select(*keys, *[F.col(c).alias(f"new_{c}") for c in columns], F.lit(1).alias("_b"))
    both = a.join(b, keys, "full")
    changed = reduce(lambda x, y: x | y, [~F.col(f"old_{c}").eqNullSafe(F.col(f"new_{c}")) for c in columns])
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(changed, "changed")
    return both.withColumn("change", change).where(F.col("change").isNotNull()).drop("_a", "_b")


def newest_pull(base: DataFrame, pulls: DataFrame, group: str, pull: str, keys: list[str], order: list[str]) -> DataFrame:
    """base with every group that a pull has replaced, whole, by its newest pull; then of each key only the first row, pulls before base.

    Rows of base keep a null group. Groups are compared by equality; a pull's row without a group is a group of its own and replaces nothing. Columns
    that base lacks are null there; the pull column is dropped.
    """
    newest = pulls.groupBy(group).agg(F.max(pull).alias("_newest")).withColumnRenamed(group, "_g")
    fresh = pulls.join(newest, pulls[group].eqNullSafe(F.col("_g")) & (pulls[pull] == F.col("_newest"))).drop("_g", "_newest", pull)
    kept = base.join(newest.select(F.col("_g").alias(group)).where(F.col(group).isNotNull()), group, "left_anti").drop(pull)
    return priority_union([fresh, kept], keys, order)
