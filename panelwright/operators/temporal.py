"""Joins and lookbacks along a time axis, as window plans: one shuffle on the key, no pair of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_known(value: Column, keys: list[str], axis: str, back: int, tolerance: int) -> Column:
    """Latest non-null (at, value) with axis in [now - back - tolerance, now - back]; null if there is none.

    axis is an integer period, unique within the keys.
    """
    w = Window.partitionBy(*keys).orderBy(axis).rangeBetween(-(back + tolerance), -back)
    return F.last(F.when(value.isNotNull(), F.struct(F.col(axis).alias("at"), value.alias("value"))), True).over(w)


def velocity(value: Column, keys: list[str], axis: str, back: int, tolerance: int) -> Column:
    """Change a period against last_known."""
    ref = last_known(value, keys, axis, back, tolerance)
    return (value - ref["value"]) / (F.col(axis) - ref["at"])


def horizon_join(panel: DataFrame, key: str, axis: str, h: int, columns: list[str]) -> DataFrame:
    """Rows of panel with the same key's row exactly h periods later, its columns suffixed _next; others are dropped."""
    later = panel.select(key, (F.col(axis) - h).alias(axis), *[F.col(c).alias(f"{c}_next") for c in columns])
    return panel.join(later, [key, axis])


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], left_at: str, right_at: str, columns: list[str], inclusive: bool = True) -> DataFrame:
    """left with the columns of the latest right row of the same keys at or before (strictly before, if not
    inclusive) left_at. Both sides are one window over their union."""
    payload = F.struct(*[F.col(c) for c in columns])
    l = left.select(*keys, F.col(left_at).alias("_at"), F.lit(1 if inclusive else 0).alias("_side"), F.struct(*left.columns).alias("_left"), F.lit(None).cast(right.select(payload.alias("p")).schema["p"].dataType).alias("_right"))
    r = right.select(*keys, F.col(right_at).alias("_at"), F.lit(0 if inclusive else 1).alias("_side"), F.lit(None).cast(l.schema["_left"].dataType).alias("_left"), payload.alias("_right"))
    w = Window.partitionBy(*keys).orderBy("_at", "_side", *[F.col(f"_right.{c}") for c in columns]).rowsBetween(Window.unboundedPreceding, 0)
    found = l.unionByName(r).withColumn("_found", F.last("_right", True).over(w)).where(F.col("_left").isNotNull())
    return found.select("_left.*", *[F.col(f"_found.{c}").alias(c) for c in columns])


def range_join(left: DataFrame, right: DataFrame, keys: list[str], condition: Column) -> DataFrame:
    """Equi-join on keys with a range condition: the keys deal the rows, the condition is checked within them."""
    return left.join(right, keys).where(condition)


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], lo: str, hi: str, least: float, share: float = 0.5) -> DataFrame:
    """Pairs of the same keys whose intervals share at least least, or that share of the shorter one.

    right's bounds are suffixed _r.
    """
    r = right.withColumnsRenamed({lo: f"{lo}_r", hi: f"{hi}_r"})
    shared = F.least(hi, f"{hi}_r") - F.greatest(lo, f"{lo}_r")
    shorter = F.least(F.col(hi) - F.col(lo), F.col(f"{hi}_r") - F.col(f"{lo}_r"))
    need = F.least(F.lit(least), shorter * share)
    return left.join(r, keys).withColumn("shared", shared).where((F.col("shared") >= need) & (F.col("shared") > 0))


def effective_rule(rows: DataFrame, rules: DataFrame, keys: list[str], at: str, since: str, columns: list[str]) -> DataFrame:
    """rows with the columns of the rule in force at their date."""
    return asof_join(rows, rules, keys, at, since, columns)


def until(df: DataFrame, at: str, asof: Column, accruing: dict[str, str] | None = None) -> DataFrame:
    """df as known at asof: later rows dropped, totals still accruing (column: its last date) null."""
    out = df.where(F.col(at) <= asof)
    for total, last in (accruing or {}).items():
        out = out.withColumn(total, F.when(F.col(last) <= asof, F.col(total)))
    return out
