"""Sinks: versioned tables with a pointer, upserts, insert-once, logs and quarantine."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def _pointer(spark: SparkSession, table: str) -> str | None:
    fs, place = _fs(spark, f"{table}/current.json")
    if not fs.exists(place):
        return None
    return json.loads(spark.read.text(f"{table}/current.json", wholetext=True).first()[0])["version"]


def read_current(spark: SparkSession, table: str) -> DataFrame | None:
    """The version the table's pointer names, or None before the first write."""
    version = _pointer(spark, table)
    return None if version is None else spark.read.parquet(f"{table}/{version}")


def write_version(df: DataFrame, table: str, partition_by: list[str] | None = None) -> str:
    """Write df as a new version and then move the pointer to it; a failed write leaves the old version current."""
    spark = df.sparkSession
    version = f"v-{uuid.uuid4().hex}"
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(f"{table}/{version}")
    fs, place = _fs(spark, f"{table}/current.json")
    _, staged = _fs(spark, f"{table}/staged-{version}.json")
    out = fs.create(staged, True)
    out.write(bytearray(json.dumps({"version": version}).encode()))
    out.close()
    fs.delete(place, False)
    if not fs.rename(staged, place):
        raise OSError(f"could not move the pointer of {table}")
    return version


def merged(old: DataFrame | None, new: DataFrame, keys: list[str], keep_old: tuple[str, ...] = ()) -> DataFrame:
    """old with new's rows in place of its own of the same keys; columns in keep_old stay as first written, and new's
    nulls do not replace values."""
    if old is None:
        return new
    a, b = old.alias("a"), new.alias("b")
    on = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    columns = []
    for c in old.columns:
        pair = (f"a.{c}", f"b.{c}") if c in keep_old else (f"b.{c}", f"a.{c}")
        columns.append(F.coalesce(*pair).alias(c) if c in new.columns else F.col(f"a.{c}"))
    return a.join(b, on, "full").select(*columns)


def upsert(new: DataFrame, table: str, keys: list[str], keep_old: tuple[str, ...] = ()) -> str:
    return write_version(merged(read_current(new.sparkSession, table), new, keys, keep_old), table)


def insert_once(new: DataFrame, path: str, keys: list[str]) -> int:
    """Append those rows of new whose keys the table lacks, first of repeats in new; returns how many."""
    spark = new.sparkSession
    fs, place = _fs(spark, path)
    w = Window.partitionBy(*keys).orderBy(*[c for c in new.columns if c not in keys] or keys)
    fresh = new.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    if fs.exists(place):
        fresh = fresh.join(spark.read.parquet(path).select(*keys), keys, "left_anti")
    fresh = fresh.persist()
    try:
        n = fresh.count()
        fresh.write.mode("append").parquet(path)
    finally:
        fresh.unpersist()
    return n


def append_log(old: DataFrame | None, new: DataFrame, keys: list[str]) -> DataFrame:
    """Log with new rows added; the first copy of a key stays, and among new ones the first by their other columns."""
    w = Window.partitionBy(*keys).orderBy(*[c for c in new.columns if c not in keys] or keys)
    fresh = new.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    if old is None:
        return fresh
    return old.unionByName(fresh.join(old.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def quarantine(held: DataFrame, path: str) -> DataFrame:
    """Write held rows by rule_id and return rows and distinct failing rules as a summary."""
    held.write.mode("overwrite").partitionBy("rule_id").parquet(path)
    return held.groupBy("rule_id").agg(F.count("*").alias("n_rows"))


def printed_csv(df: DataFrame, path: str) -> None:
    """CSV with a header, booleans in lower case, null as blank."""
    df.select(*[F.col(c).cast("string").alias(c) for c in df.columns]).write.mode("overwrite").option("nullValue", "").csv(path, header=True)


def audit(spark: SparkSession, path: str, event: str, **payload) -> None:
    """Append one event to a log of JSON lines."""
    row = spark.range(1).select(F.lit(event).alias("event"), F.lit(json.dumps(payload, sort_keys=True)).alias("payload"))
    row.coalesce(1).write.mode("append").json(path)
