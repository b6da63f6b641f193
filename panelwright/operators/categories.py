"""Categories that are open at a time: mentioned lately, not reported done, not too old."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def open_block(rows: DataFrame, observed: DataFrame, mentions: DataFrame, key: str, period: str, categories: list[str], last: int, most_age: int) -> DataFrame:
    """rows (key, period) with n_observed, the periods observed so far, and for each category: open_, whether its latest mention up to the row is in
    one of the key's last observed periods, is not resolved and is younger than most_age periods; ever_, whether there is one; since_, the
    periods since the first. open_total counts the open ones.

    observed has (key, period); mentions (key, period, category, resolved). Mentions are pivoted to a row for each key and period, and everything known by
    a row is a running maximum in one window: one shuffle by key, no pairs.
    """
    held = lambda c: F.col("category") == c
    wide = mentions.groupBy(key, period).agg(*[F.max(F.when(held(c), F.struct(F.lit(1).alias("hit"), F.coalesce("resolved", F.lit(False)).alias("done")))).alias(f"_{c}") for c in categories])
    every = rows.select(key, period).distinct().withColumn("_row", F.lit(True)).join(observed.select(key, period).distinct().withColumn("_seen", F.lit(True)), [key, period], "full").join(wide, [key, period], "full")
    upto = Window.partitionBy(key).orderBy(period).rowsBetween(Window.unboundedPreceding, 0)
    counted = every.withColumn("n_observed", F.count("_seen").over(upto))
    latest = counted
    for c in categories:
        mention = F.when(F.col(f"_{c}").isNotNull(), F.struct(F.col(period).alias("t"), F.col("n_observed").alias("n"), F.col(f"_{c}.done").alias("done")))
        latest = latest.withColumn(f"_l{c}", F.max(mention).over(upto)).withColumn(f"_f{c}", F.min(F.when(F.col(f"_{c}").isNotNull(), F.col(period))).over(upto))
    out, total = [], F.lit(0)
    for c in categories:
        m = F.col(f"_l{c}")
        is_open = F.coalesce((m["n"] >= F.col("n_observed") - (last - 1)) & ~m["done"] & (F.col(period) - m["t"] < most_age), F.lit(False))
        out += [is_open.alias(f"open_{c}"), m.isNotNull().alias(f"ever_{c}"), (F.col(period) - F.col(f"_f{c}")).alias(f"since_{c}")]
        total = total + is_open.cast("int")
    return latest.where("_row").select(key, period, "n_observed", *out, total.alias("open_total"))
