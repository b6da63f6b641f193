"""Places and running sums in a global order without a global task.

Rows are cut into ranges of the order, each range is a partition, and only one row for each range meets in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.sources.scratch import stored

RANGE = "_range"


def in_ranges(df: DataFrame, *keys: str | Column) -> DataFrame:
    """df with RANGE: rows of a lower range come before those of a higher one. Written once, as the sampled bounds need not fall alike twice."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stored(df.repartitionByRange(n, *keys).withColumn(RANGE, F.spark_partition_id()))


def running(ranged: DataFrame, keys: list[str | Column], sums: dict[str, Column] | None = None, most: dict[str, Column] | None = None) -> DataFrame:
    """A frame of in_ranges(df, *keys) with running sums and running maxima up to each row, the row included.

    keys must name one order of the rows: among equal keys any may come first. Nulls add nothing; a sum before the first value is 0, a maximum null.
    """
    sums, most = sums or {}, most or {}
    ends = ranged.groupBy(RANGE).agg(*[F.sum(c).alias(f"_s_{n}") for n, c in sums.items()], *[F.max(c).alias(f"_m_{n}") for n, c in most.items()])
    before = Window.orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    starts = ends.select(RANGE, *[F.sum(f"_s_{n}").over(before).alias(f"_s_{n}") for n in sums], *[F.max(f"_m_{n}").over(before).alias(f"_m_{n}") for n in most])
    upto = Window.partitionBy(RANGE).orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)
    inside = ranged.withColumns({f"_i_{n}": F.sum(c).over(upto) for n, c in sums.items()} | {f"_i_{n}": F.max(c).over(upto) for n, c in most.items()})
    both = inside.join(F.broadcast(starts), RANGE)  # one row a range, at most one for each shuffle partition
    done = {n: F.coalesce(f"_s_{n}", F.lit(0)) + F.coalesce(f"_i_{n}", F.lit(0)) for n in sums} | {n: F.greatest(f"_m_{n}", f"_i_{n}") for n in most}
    return both.withColumns(done).drop(*[f"_{a}_{n}" for n in done for a in "smi"])


def numbered(ranged: DataFrame, keys: list[str | Column], place: str = "place") -> DataFrame:
    """A frame of in_ranges(df, *keys) with the places of its rows from 1 in the order of the keys."""
    return running(ranged, keys, {place: F.lit(1)})
