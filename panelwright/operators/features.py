"""Point-in-time features of a panel: speeds, stagnation, distance from peers and from the usual course. A row knows only rows of its key up to its own
period; what it is compared with is named in each function."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.functions.scalars import bin_right_open, ratio
from panelwright.operators import temporal, windows


def stagnation(df: DataFrame, keys: list[str], period: str, value: str, small: Column, name: str = "stagnation") -> DataFrame:
    """df with the periods for which the value has moved by less than small (an absolute speed), 0 where it moves or nothing is known."""
    ref = temporal.last_known(F.col(value), keys, period, 1, 1)
    told = df.withColumn("_ref", ref).withColumn("_stuck", F.abs((F.col(value) - F.col("_ref.value")) / (F.col(period) - F.col("_ref.at"))) < small).withColumn("_gap", F.col(period) - F.col("_ref.at"))
    return windows.run_length(told, keys, period, F.col("_gap"), F.col("_stuck"), name).drop("_ref", "_stuck", "_gap")


def against_median(df: DataFrame, groups: list[str], value: str, name: str) -> DataFrame:
    """df with value minus its median among the rows of the groups, null values aside. Medians come from a grouping and are joined back."""
    middle = df.where(F.col(value).isNotNull()).groupBy(*groups).agg(F.percentile(value, 0.5).alias("_m"))
    return df.join(middle, groups, "left").withColumn(name, F.col(value) - F.col("_m")).drop("_m")


def usual_course(df: DataFrame, age: Column, part: Column, edges: list) -> DataFrame:
    """bin and expected: the median part of the rows of each bin of age, made rising by a running maximum; one row for each bin."""
    by = df.select(bin_right_open(age, edges).alias("bin"), part.alias("part")).where("bin IS NOT NULL AND part IS NOT NULL").groupBy("bin").agg(F.percentile("part", 0.5).alias("part"))
    return by.select("bin", F.max("part").over(Window.orderBy("bin")).alias("expected"))


def off_course(df: DataFrame, age: Column, part: Column, edges: list) -> DataFrame:
    """df with expected, the usual course at its age, and deviation, its part minus that. A row for each bin, at most as many as edges, is broadcast."""
    course = usual_course(df, age, part, edges)
    return df.withColumn("bin", bin_right_open(age, edges)).join(F.broadcast(course), "bin", "left").withColumn("deviation", part - F.col("expected")).drop("bin")


def since_first(value: Column, keys: list[str], period: str) -> Column:
    return ratio(value, F.first(value).over(windows.ordered(keys, period)))


def steps_so_far(value: Column, keys: list[str], period: str, share: float) -> Column:
    """How often the value has moved by more than share from one row to the next."""
    w = windows.ordered(keys, period)
    return F.count(F.when(F.abs(ratio(value, F.lag(value).over(w)) - 1) > share, 1))
