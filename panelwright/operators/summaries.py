"""Summaries of linked outside records, for every scope and for all of them in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ALL = "all"


def scoped(df: DataFrame, scope: str) -> DataFrame:
    """df with each row in its scope and in ALL; a row without a scope is in ALL alone."""
    return df.withColumn(scope, F.explode(F.array_compact(F.array(F.col(scope).cast("string"), F.lit(ALL)))))


def linked(facts: DataFrame, scope: str, amount: str) -> DataFrame:
    """One row a scope of facts, a row a key: n_linked, n_open, n_overdue, n_silent and the amount that is open.

    facts has counts n_open and n_overdue and a flag silent (open, though the report says nothing); nulls count as none. Scopes combine before the shuffle.
    """
    is_open = F.coalesce(F.col("n_open") > 0, F.lit(False))
    return scoped(facts, scope).groupBy(scope).agg(
        F.count("*").alias("n_linked"), F.count_if(is_open).alias("n_open"), F.count_if(F.col("n_overdue") > 0).alias("n_overdue"),
        F.count_if(F.col("silent")).alias("n_silent"), F.coalesce(F.round(F.sum(F.when(is_open, F.col(amount))), 1), F.lit(0.0)).alias("open_amount"),
    )


def shares(facts: DataFrame, scope: str, value: str) -> DataFrame:
    """How many facts of each scope have each known value: scope, value, n, in long form."""
    return scoped(facts.where(F.col(value).isNotNull()), scope).groupBy(scope, value).agg(F.count("*").alias("n"))


def overdue(facts: DataFrame, scope: str, key: str, amount: str, top: int) -> DataFrame:
    """The top overdue keys of each scope by amount, nulls last, ties to the smaller key: scope, key, amount, place.

    Tasks keep their own top before the shuffle, so a scope with most of the rows sends few.
    """
    w = Window.partitionBy(scope).orderBy(F.col(amount).desc_nulls_last(), key)
    rows = scoped(facts.where(F.col("n_overdue") > 0), scope).select(scope, key, amount)
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= top)


def wilson(hits: Column, n: Column, z: float = 1.96, digits: int = 3) -> Column:
    """Struct lo, hi of the Wilson interval of hits in n; null without a trial."""
    p = F.try_divide(hits.cast("double"), n.cast("double"))
    scale = 1 + F.try_divide(F.lit(z * z), n)
    middle = (p + F.try_divide(F.lit(z * z / 2), n)) / scale
    half = z * F.sqrt(F.try_divide(p * (1 - p), n) + F.try_divide(F.lit(z * z / 4), n * n)) / scale
    return F.when(n > 0, F.struct(F.round(middle - half, digits).alias("lo"), F.round(middle + half, digits).alias("hi")))


def coverage(links: DataFrame, scope: str, method: str, correct: Column) -> DataFrame:
    """Links of each scope and method: how many, how many of the judged ones are correct, with the interval; correct is null where nobody judged."""
    by = scoped(links, scope).groupBy(scope, method).agg(F.count("*").alias("n"), F.count(correct).alias("judged"), F.count_if(correct).alias("correct"))
    return by.withColumn("ci", wilson(F.col("correct"), F.col("judged"))).select(scope, method, "n", "judged", "correct", "ci.lo", "ci.hi")
