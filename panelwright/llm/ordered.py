"""Global order without a global task: places and successors over range partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelwright.llm.common import cut


def in_ranges(df: DataFrame, *keys) -> DataFrame:
    """df with ``_range``: rows of a lower range come before those of a higher one. Computed once, as sampling for the
    bounds need not fall alike twice."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut(df.repartitionByRange(n, *keys).withColumn("_range", F.spark_partition_id()))


def numbered(df: DataFrame, *keys) -> DataFrame:
    """df with ``place``, its rows' places from 0 in the order of the keys.

    Only one row for each range, so at most one for each shuffle partition, meets in one task and is broadcast.
    """
    ranged = in_ranges(df, *keys)
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*keys)) - 1
    return ranged.withColumn("_in", place).join(F.broadcast(starts), "_range").withColumn("place", F.col("_start") + F.col("_in")).drop("_range", "_start", "_in")


def successors(df: DataFrame, *keys) -> DataFrame:
    """df with ``next``: a struct of the following row in the order of the keys; the last row is followed by the first.

    df must be slim: its whole row is what the struct holds.
    """
    row = F.struct(*df.columns)
    ranged = in_ranges(df, *keys)
    ranked = ranged.withColumn("_n", F.row_number().over(Window.partitionBy("_range").orderBy(*keys)))
    first = ranked.where("_n = 1").select("_range", row.alias("first"))
    following = Window.orderBy("_range")
    edges = first.select("_range", F.lead("first").over(following).alias("_edge"), F.first("first").over(following).alias("_wrap"))
    inside = F.lead(row).over(Window.partitionBy("_range").orderBy(*keys))
    return ranged.withColumn("_inside", inside).join(F.broadcast(edges), "_range").withColumn("next", F.coalesce("_inside", "_edge", "_wrap")).drop("_range", "_inside", "_edge", "_wrap")
