"""What every table holds about a key: long rows and one head for each key and part, for all keys at once.

A key's rows stay rows. Nothing is gathered in a list, so a key with a large share of all rows is spread over tasks as any other.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROWS = "part string, key long, at timestamp, row string"


@dataclass(frozen=True)
class Part:
    """A table's share of a bundle: its rows (None if the table is missing), their key, their time (None if undated), and the columns to hand on."""

    name: str
    rows: DataFrame | None
    key: str
    at: Column | None
    columns: tuple[Column, ...] = ()


def canonical(df: DataFrame, key: str, aliases: DataFrame) -> DataFrame:
    """df with its key replaced by the one that aliases (alias, key; an alias once) gives it; other keys and nulls stay."""
    table = aliases.select(F.col("alias").alias("_a"), F.col("key").alias("_c"))
    return df.join(table, F.col(key) == F.col("_a"), "left").withColumn(key, F.coalesce("_c", key)).drop("_a", "_c")


def bundle(parts: list[Part], aliases: DataFrame | None = None, asof: Column | None = None, keys: DataFrame | None = None) -> DataFrame:
    """part, key, at and row (JSON, nulls kept) of all parts; a missing table adds none, nor does a row without a key.

    Keys are made canonical by aliases. Dated rows after asof are left out, undated ones stay. keys (one column) restricts the
    bundle to some; without it all keys are told.
    """
    there = [p for p in parts if p.rows is not None]
    if not there:
        raise ValueError("no part of the bundle has a table")

    def rows(p: Part) -> DataFrame:
        at = F.lit(None) if p.at is None else p.at
        body = F.to_json(F.struct(*p.columns), {"ignoreNullFields": "false"})
        return p.rows.where(F.col(p.key).isNotNull()).select(F.lit(p.name).alias("part"), F.col(p.key).cast("long").alias("key"), at.cast("timestamp").alias("at"), body.alias("row"))

    out = reduce(DataFrame.unionByName, map(rows, there))
    if asof is not None:
        out = out.where(F.coalesce(F.col("at") <= asof, F.lit(True)))
    if aliases is not None:
        out = canonical(out, "key", aliases).select("part", "key", "at", "row")
    if keys is not None:
        out = out.join(keys.select(F.col(keys.columns[0]).alias("key")).distinct(), "key", "left_semi").select("part", "key", "at", "row")
    return out


def heads(rows: DataFrame, masters: DataFrame, parts: list[Part]) -> DataFrame:
    """One row for each key of masters (one column, repeats count once) and part: its rows of bundle() as n, the first and last time, and latest,
    the row of the last time (of equal ones the largest; undated rows are before all). Parts without a row, and missing tables, count 0.
    """
    names = F.array(*[F.struct(F.lit(p.name).alias("part"), F.lit(p.rows is not None).alias("present")) for p in parts])
    grid = masters.select(F.col(masters.columns[0]).cast("long").alias("key")).where("key IS NOT NULL").distinct().select("key", F.inline(names))
    by = rows.groupBy("key", "part").agg(F.count("*").alias("n"), F.min("at").alias("first_at"), F.max("at").alias("last_at"), F.max(F.struct("at", "row"))["row"].alias("latest"))
    return grid.join(by, ["key", "part"], "left").withColumn("n", F.coalesce("n", F.lit(0))).select("key", "part", "present", "n", "first_at", "last_at", "latest")
