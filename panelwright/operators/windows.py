"""Running, filling and run-length columns over an ordered key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def ordered(keys: list[str], *by) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*by)


def forward_fill(value: Column, w: WindowSpec) -> Column:
    return F.last(value, True).over(w.rowsBetween(Window.unboundedPreceding, 0))


def previous_known(value: Column, w: WindowSpec) -> Column:
    """Latest non-null value of an earlier row."""
    return F.last(value, True).over(w.rowsBetween(Window.unboundedPreceding, -1))


def running(total: Column, w: WindowSpec) -> Column:
    return F.sum(total).over(w.rowsBetween(Window.unboundedPreceding, 0))


def since_event(event: Column, now: Column, w: WindowSpec) -> Column:
    """Distance from the last event, or from the first row before any."""
    w0 = w.rowsBetween(Window.unboundedPreceding, 0)
    return now - F.coalesce(F.last(F.when(event, now), True).over(w0), F.first(now).over(w0))


def islands(df: DataFrame, keys: list[str], by: str, breaks: Column, name: str = "island") -> DataFrame:
    """df with the number of breaks so far, which numbers the runs of each key."""
    return df.withColumn("_break", breaks.cast("int")).withColumn(name, running(F.col("_break"), ordered(keys, by))).drop("_break")


def run_length(df: DataFrame, keys: list[str], by: str, amount: Column, goes_on: Column, name: str) -> DataFrame:
    """Running sum of amount while goes_on holds, 0 where it does not."""
    on = F.coalesce(goes_on, F.lit(False))
    runs = islands(df, keys, by, ~on, "_run")
    return runs.withColumn(name, F.coalesce(F.sum(F.when(on, amount)).over(ordered([*keys, "_run"], by).rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))).drop("_run")


def consecutive_runs(df: DataFrame, keys: list[str], axis: str) -> DataFrame:
    """First and last period and length of every run of consecutive periods."""
    place = F.row_number().over(ordered(keys, axis))
    runs = df.select(*keys, axis).distinct().withColumn("_run", F.col(axis) - place)
    return runs.groupBy(*keys, "_run").agg(F.min(axis).alias("first"), F.max(axis).alias("last"), F.count("*").alias("length")).drop("_run")


def trailing_days(value: Column, keys: list[str], ts: str, days: int, how) -> Column:
    """how (an aggregate such as F.avg) over the rows of the last days, this one included."""
    seconds = F.unix_timestamp(F.col(ts).cast("timestamp"))
    w = Window.partitionBy(*keys).orderBy(seconds).rangeBetween(-(days * 86400), 0)
    return how(value).over(w)


def within_ahead(value: Column, keys: list[str], axis: str, h: int, how) -> Column:
    """how over the rows 1 to h periods ahead."""
    return how(value).over(Window.partitionBy(*keys).orderBy(axis).rangeBetween(1, h))


def latest(df: DataFrame, keys: list[str], *by) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("_n", F.row_number().over(ordered(keys, *by))).where("_n = 1").drop("_n")


def top_per_group(df: DataFrame, keys: list[str], n: int, *by) -> DataFrame:
    return df.withColumn("place", F.row_number().over(ordered(keys, *by))).where(F.col("place") <= n)


def survival(hazard: Column, keys: list[str], step: str) -> Column:
    """1 minus the product of (1 - hazard) up to each step."""
    return 1 - F.exp(F.sum(F.log1p(-hazard)).over(ordered(keys, step).rowsBetween(Window.unboundedPreceding, 0)))


def rate_limit(df: DataFrame, keys: list[str], ts: str, seconds: int, most: int) -> DataFrame:
    """df with hits, the rows of the key in the last seconds, and limited where there are more than most."""
    w = Window.partitionBy(*keys).orderBy(F.unix_timestamp(F.col(ts).cast("timestamp"))).rangeBetween(-seconds, 0)
    return df.withColumn("hits", F.count("*").over(w)).withColumn("limited", F.col("hits") > most)
