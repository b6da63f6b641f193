"""Scans with fixed schemas: text CSV, titled CSV, JSON lines, RSS, HTML tables and optional tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def text_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """All columns as text, blanks kept; columns the file lacks are blank, unknown ones are an error."""
    raw = spark.read.csv(path, header=True, inferSchema=False, emptyValue="", nullValue="\x00")
    extra = [c for c in raw.columns if c not in columns]
    if extra:
        raise ValueError(f"unknown columns in {path}: {', '.join(extra)}")
    return raw.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) if c in raw.columns else F.lit("").alias(c) for c in columns])


def titled_csv(spark: SparkSession, path: str, schema: T.StructType, skip: int = 2) -> DataFrame:
    """CSV below a title and a blank line: the first skip lines and the header go, columns are named by place."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("n", "line"))
    body = lines.where((F.col("n") > skip) & (F.col("line") != ""))
    as_text = T.StructType([T.StructField(f.name, T.StringType()) for f in schema])
    row = F.from_csv("line", as_text.simpleString()[7:-1].replace(":", " ").replace(",", ", "))
    return body.select(row.alias("r")).select(*[F.col(f"r.{f.name}").try_cast(f.dataType).alias(f.name) for f in schema])


def typed(df: DataFrame, dates: dict[str, str], numbers: list[str]) -> DataFrame:
    """df with dates (column: format) and numbers parsed; what fails is null and named in parse_fails."""
    fails = []
    out = df
    for c, fmt in dates.items():
        value = F.try_to_timestamp(F.col(c), F.lit(fmt)).cast("date")
        fails.append(F.when((F.col(c) != "") & value.isNull(), F.lit(f"parse_fail:{c}")))
        out = out.withColumn(f"_{c}", value)
    for c in numbers:
        value = F.col(c).try_cast("double")
        fails.append(F.when((F.col(c) != "") & value.isNull(), F.lit(f"parse_fail:{c}")))
        out = out.withColumn(f"_{c}", value)
    parsed = [*dates, *numbers]
    out = out.withColumn("parse_fails", F.array_compact(F.array(*fails)))
    return out.drop(*parsed).withColumnsRenamed({f"_{c}": c for c in parsed})


def packed_numbers(cell: Column) -> tuple[Column, Column]:
    """The two numbers of a cell like '12 (3.5)'."""
    part = lambda i: F.regexp_extract(cell, r"([\d.]+)\s*\(([\d.]+)\)", i).try_cast("double")
    return part(1), part(2)


def json_lines(spark: SparkSession, path: str, schema: str, key: str, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """The latest good line of each key, and the lines that could not be read."""
    raw = spark.read.schema(f"{schema}, _bad string").option("columnNameOfCorruptRecord", "_bad").option("mode", "PERMISSIVE").json(path)
    raw = raw.withColumn("_file", F.input_file_name())
    bad = raw.where(F.col("_bad").isNotNull() | F.col(key).isNull())
    w = Window.partitionBy(key).orderBy(*[F.col(c).desc_nulls_last() for c in [*order, "_file"]])
    good = raw.where(F.col("_bad").isNull() & F.col(key).isNotNull())
    latest = good.withColumn("_n", F.row_number().over(w)).where("_n = 1")
    return latest.drop("_n", "_bad", "_file"), bad.select("_bad", "_file")


def rss(spark: SparkSession, path: str) -> DataFrame:
    """Items of RSS files: title without its source tail, link, source, plain description, publication time."""
    raw = spark.read.format("xml").option("rowTag", "item").schema("title string, link string, source string, description string, pubDate string").load(path)
    plain = F.trim(F.regexp_replace(F.regexp_replace("description", "<[^>]*>", " "), r"\s+", " "))
    date = F.try_to_timestamp(F.regexp_replace("pubDate", r"^\w+,\s*|\s+GMT$", ""), F.lit("d MMM yyyy HH:mm:ss"))
    return raw.select(F.regexp_replace("title", r"\s+-\s+[^-]*$", "").alias("title"), "link", "source", plain.alias("text"), date.alias("published"))


def html_tables(df: DataFrame, key: str, html: str) -> DataFrame:
    """Cells of the tables of HTML pages: key, row and cell numbers, text. Table rows and cells are cut by their tags."""
    rows = F.regexp_extract_all(F.col(html), F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr>"), F.lit(1))
    cells = F.regexp_extract_all(F.col("_row"), F.lit(r"(?is)<t[dh]\b[^>]*>(.*?)</t[dh]>"), F.lit(1))
    by_row = df.select(key, F.posexplode(rows).alias("row", "_row"))
    by_cell = by_row.select(key, "row", F.posexplode(cells).alias("cell", "_cell"))
    text = F.trim(F.regexp_replace(F.regexp_replace("_cell", "<[^>]*>", " "), r"\s+", " "))
    return by_cell.select(key, "row", "cell", text.alias("text"))


def fill_down(cells: DataFrame, keys: list[str], row: str, columns: list[str]) -> DataFrame:
    """Group columns printed once, filled down in printed order; a blank is no value."""
    w = Window.partitionBy(*keys).orderBy(row).rowsBetween(Window.unboundedPreceding, 0)
    return cells.withColumns({c: F.last(F.when(F.col(c) != "", F.col(c)), True).over(w) for c in columns})


def optional(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The parquet table at path, or an empty one of the schema if there is none."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return spark.read.schema(schema).parquet(path)
    return spark.createDataFrame([], schema)
