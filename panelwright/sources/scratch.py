"""Intermediate tables in the folder that all executors share. Unlike a checkpoint, a table that is read again brings neither the statistics nor
the constraints of the plan that made it, so a loop's plans stay small."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from panelwright.sources.session import shared_folder


def _folder(spark: SparkSession, path: str):
    """The file system of a folder and its path there."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def place(spark: SparkSession) -> str:
    """A path of its own among the shared ones, where nothing is yet; gone when the session ends."""
    files, folder = _folder(spark, f"{shared_folder(spark)}/{uuid.uuid4().hex}")
    files.mkdirs(folder)
    files.deleteOnExit(folder)
    return f"{folder.toString()}/table"


def saved(df: DataFrame) -> str:
    """The folder, among the shared ones, where df is written as parquet; gone when the session ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    files, folder = _folder(spark, path)
    files.deleteOnExit(folder)
    return path


def removed(spark: SparkSession, path: str) -> None:
    """Removes a folder that saved() has made and nothing reads any more."""
    files, place = _folder(spark, path)
    files.delete(place, True)


def stored(df: DataFrame) -> DataFrame:
    """df, written once as parquet in the shared folder; gone when the session ends."""
    return df.sparkSession.read.parquet(saved(df))
