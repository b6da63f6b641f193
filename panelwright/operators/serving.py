"""Read queries with typed arguments: filters, scope, paging, checklists and clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.functions.scalars import hash_id


def where(df: DataFrame, equal: dict | None = None, like: dict | None = None, between: dict | None = None, contains: dict | None = None, among: dict | None = None) -> DataFrame:
    """df filtered by the arguments that are given; an absent (None) value does not filter.

    among maps a column to a one-column frame of allowed values.
    """
    out = df
    for c, v in (equal or {}).items():
        out = out if v is None else out.where(F.col(c) == v)
    for c, v in (like or {}).items():
        out = out if v is None else out.where(F.contains(F.lower(c), F.lit(v.lower())))
    for c, (a, b) in (between or {}).items():
        out = out if a is None else out.where(F.col(c) >= a)
        out = out if b is None else out.where(F.col(c) <= b)
    for c, v in (contains or {}).items():
        out = out if v is None else out.where(F.array_contains(c, v))
    for c, v in (among or {}).items():
        out = out if v is None else out.join(v.select(F.col(v.columns[0]).alias(c)).distinct(), c, "left_semi")
    return out


def page(df: DataFrame, sorts: dict[str, Column], sort: str, key: str, number: int, size: int, descending: bool = True) -> DataFrame:
    """One page in a whitelisted order, nulls last, ties by key."""
    if sort not in sorts:
        raise ValueError(f"sort must be one of {', '.join(sorts)}")
    by = sorts[sort].desc_nulls_last() if descending else sorts[sort].asc_nulls_last()
    return df.orderBy(by, F.col(key)).offset((number - 1) * size).limit(size)


def in_order(df: DataFrame, key: str, keys: list) -> DataFrame:
    """Rows of the given keys with their place in the list."""
    wanted = df.sparkSession.createDataFrame([(k, i) for i, k in enumerate(keys)], f"{key} {df.schema[key].dataType.simpleString()}, place int")
    return df.join(F.broadcast(wanted), key)


def in_scope(df: DataFrame, scope: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys a scope table grants."""
    return df.join(scope.select(*keys).distinct(), keys, "left_semi")


def checklist(df: DataFrame, key: str, items: list[tuple[str, Column, Column]]) -> DataFrame:
    """One row for each key and dimension: flagged, clear or unknown, and the evidence."""
    rows = F.array(*[F.struct(F.lit(name).alias("dimension"), state.alias("state"), evidence.cast("string").alias("evidence")) for name, state, evidence in items])
    return df.select(key, F.explode(rows).alias("r")).select(key, "r.*")


def clusters(members: DataFrame, key: str, groups: list[str], severity: str, least: int, prefix: str = "BN-") -> DataFrame:
    """Groups with at least so many distinct keys: stable id, members, mean severity, and the first keys."""
    by = members.groupBy(*groups).agg(F.count_distinct(key).alias("n_members"), F.round(F.avg(severity), 6).alias("severity"), F.min(key).alias("first_member"))
    return by.where(F.col("n_members") >= least).withColumn("cluster_id", hash_id(prefix, *[F.col(g) for g in groups]))


def top_members(members: DataFrame, groups: list[str], by: Column, key: str, n: int) -> DataFrame:
    w = Window.partitionBy(*groups).orderBy(by.desc_nulls_last(), F.col(key))
    return members.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def fair_batch(df: DataFrame, key: str, watched: Column, last_done: str, risk: Column, size: int) -> DataFrame:
    """Next keys to work on: watched ones take half, then those done longest ago (never first), then the riskiest."""
    order = [F.col(last_done).asc_nulls_first(), risk.desc_nulls_last(), F.col(key)]
    ranked = df.withColumn("_w", watched).withColumn("_p", F.row_number().over(Window.partitionBy("_w").orderBy(*order)))
    first = F.when(F.col("_w") & (F.col("_p") <= size // 2), 0).otherwise(1)
    return ranked.orderBy(first, *order).limit(size).drop("_w", "_p")
