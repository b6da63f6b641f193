"""Structured Streaming flows: windows, sessions, duplicates, change alerts and late outcomes.

Each flow turns a stream into results through foreachBatch, which writes a batch's rows once under its number, so a
repeated batch replaces itself; ``latest`` reads the newest row of each key.
"""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelwright.operators.relational import diff
from panelwright.sources.session import shared_folder
from panelwright.sources.sinks import read_current, write_version


def flow_folder(spark: SparkSession) -> str:
    """A new folder in the folder that all executors share."""
    return f"{shared_folder(spark)}/flow-{uuid.uuid4().hex}"


def arrivals(spark: SparkSession, folder: str, schema, glob: str = "*.parquet", files: int = 1000) -> DataFrame:
    """Files as they arrive, oldest first."""
    return spark.readStream.schema(schema).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files).parquet(folder)


def table_arrivals(spark: SparkSession, path: str, schema, files: int = 1000) -> DataFrame:
    """The files of a table, which is a folder of part files or a single file."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place).isDirectory():
        return arrivals(spark, path, schema, files=files)
    folder, name = path.rsplit("/", 1)
    return arrivals(spark, folder, schema, name, files)


def replayed(df: DataFrame, ts: str, parts: int, arrive) -> None:
    """Deals df in parts by time and calls arrive with each, the earliest first: a table as it would have come in. Rows without a time come first."""
    bounds = df.agg(F.percentile_approx(F.col(ts).cast("timestamp").cast("double"), [i / parts for i in range(1, parts)], 1000)).first()[0] or []
    at = F.col(ts).cast("timestamp").cast("double")
    for low, high in zip([None, *bounds], [*bounds, None]):
        inside = F.lit(True) if low is None else at > low
        arrive(df.where(inside if high is None else inside & F.coalesce(at <= high, F.lit(low is None))))


def run_replayed(spark: SparkSession, df: DataFrame, ts: str, flow, mode: str, parts: int = 3, new_by: list[str] | None = None) -> str:
    """Rows by batch of a flow over df that arrives in parts. The flow is started anew for each part and goes on from its checkpoint."""
    folder, inbox = flow_folder(spark), flow_folder(spark)

    def arrive(part: DataFrame) -> None:
        part.coalesce(4).write.mode("append").parquet(inbox)
        run_available(flow(arrivals(spark, inbox, df.schema)), folder, mode, new_by=new_by)

    replayed(df, ts, parts, arrive)
    return f"{folder}/rows"


def run_available(stream: DataFrame, folder: str, mode: str, each=None, new_by: list[str] | None = None, watch=None) -> str:
    """Process what is there and stop; rows go to folder/rows by batch. each changes a batch before it is written.

    With new_by only rows are written whose keys no earlier batch has written, however long ago that was. watch gets the progress of the last batch.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch = each(batch) if each else batch
        if new_by and _exists(batch.sparkSession, f"{folder}/rows"):
            known = batch.sparkSession.read.schema(T.StructType([*batch.schema.fields, T.StructField("batch", T.LongType())])).option("basePath", f"{folder}/rows").parquet(f"{folder}/rows")
            batch = batch.join(known.where(F.col("batch") < number).select(*new_by), new_by, "left_anti").select(*batch.columns)
        batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")

    flow = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    flow.awaitTermination()
    if watch:
        watch(flow.lastProgress)
    return f"{folder}/rows"


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def latest(spark: SparkSession, rows: str, keys: list[str]) -> DataFrame:
    """Newest batch's row of each key."""
    every = spark.read.parquet(rows)
    w = Window.partitionBy(*keys).orderBy(F.desc("batch"))
    return every.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "batch")


def last_batch(spark: SparkSession, rows: str) -> DataFrame:
    """Rows of the newest batch, for flows that write their whole result each time."""
    every = spark.read.parquet(rows)
    return every.join(F.broadcast(every.agg(F.max("batch").alias("batch"))), "batch").drop("batch")


def tumbling(stream: DataFrame, ts: str, width: str, keys: list[str], late: str, aggregates: list[Column]) -> DataFrame:
    """Aggregates of each key and window; rows later than late are dropped once a later batch has passed them."""
    timed = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return timed.groupBy(F.window(ts, width).alias("w"), *keys).agg(*aggregates).withColumn("start", F.col("w.start")).drop("w")


def sliding(stream: DataFrame, ts: str, width: str, slide: str, keys: list[str], late: str, aggregates: list[Column]) -> DataFrame:
    timed = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return timed.groupBy(F.window(ts, width, slide).alias("w"), *keys).agg(*aggregates).withColumn("start", F.col("w.start")).drop("w")


def sessions(stream: DataFrame, ts: str, gap: str, keys: list[str], late: str, aggregates: list[Column]) -> DataFrame:
    """Aggregates of each key's bursts, closed by a gap."""
    timed = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return timed.groupBy(F.session_window(ts, gap).alias("w"), *keys).agg(*aggregates).withColumn("start", F.col("w.start")).drop("w")


def once(stream: DataFrame, ts: str, late: str, keys: list[str]) -> DataFrame:
    """The first row of each key within the watermark."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def new_by_either(batch: DataFrame, known: DataFrame, hashes: tuple[str, str], order: list[str]) -> DataFrame:
    """Rows of batch new by both hashes, against known ones and within the batch."""
    out = batch
    for h in hashes:
        out = out.join(known.select(h).where(F.col(h).isNotNull()).distinct(), h, "left_anti")
        place = F.row_number().over(Window.partitionBy(h).orderBy(*order))
        out = out.withColumn("_n", place).where(F.col(h).isNull() | (F.col("_n") == 1)).drop("_n")
    return out.select(*batch.columns)


def change_alerts(old: DataFrame, new: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """An alert a changed, added or removed key, with a stable id so that a repeated comparison adds none."""
    alerts = diff(old, new, keys, columns)
    parts = [*[F.col(k).cast("string") for k in keys], F.col("change"), *[F.coalesce(F.col(f"new_{c}").cast("string"), F.lit("-")) for c in columns]]
    return alerts.withColumn("alert_id", F.sha2(F.concat_ws("|", *parts), 256))


def fill_open(log: DataFrame, outcomes: DataFrame, keys: list[str], value: str) -> DataFrame:
    """log with the outcome filled where it is open; filled rows never change."""
    late = outcomes.select(*keys, F.col(value).alias("_late"))
    return log.join(late, keys, "left").withColumn(value, F.coalesce(value, "_late")).drop("_late")


#: Tiers from the highest to the lowest, and those whose crossing is told.
TIERS, WATCHED = ("critical", "high", "medium", "low"), ("critical", "high")
ALERTS = "key string, at timestamp, kind string, severity int, was string, tier string, seq long"


def tier_alert(was: str | None, is_new: bool, tier: str) -> tuple[str, int] | None:
    """Kind and severity of a change of tier: a new key, a move up into a watched tier or down from one; other moves tell nothing."""
    if is_new:
        return "new", 2 if tier in WATCHED else 1
    if TIERS.index(tier) < TIERS.index(was) and tier in WATCHED:
        return "tier_up", 3 if tier == TIERS[0] else 2
    if TIERS.index(tier) > TIERS.index(was) and was in WATCHED:
        return "tier_down", 1
    return None


def tier_alerts(stream: DataFrame, key: str, at: str, seq: str, tier: str, late: str, forget_days: int) -> DataFrame:
    """Alerts of each key's changes of tier in the order of at and seq, by state of the key: its last tier and time.

    A row later than late, not after the key's last one or of no known tier is dropped. A key without a row for forget_days is forgotten, which frees its state; it is new
    when it comes again.
    """
    named = stream.select(F.col(key).cast("string").alias("key"), F.col(at).cast("timestamp").alias("at"), F.col(seq).cast("long").alias("seq"), F.col(tier).alias("tier")).where(F.col("tier").isin(*TIERS) & F.col("at").isNotNull())
    forget = forget_days * 86_400_000

    def follow(keys, batches, state):
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values(["at", "seq"])
        was, last, last_seq = state.get if state.exists else (None, None, None)
        out = []
        for r in rows.itertuples():
            ms = int(r.at.value // 1_000_000)
            if last is not None and (r.at.value // 1000, r.seq) <= (last, last_seq):
                continue
            is_new = was is None or ms - last // 1000 > forget
            told = tier_alert(was, is_new, r.tier)
            if told:
                out.append((keys[0], r.at, *told, None if is_new else was, r.tier, r.seq))
            was, last, last_seq = r.tier, r.at.value // 1000, r.seq
        state.update((was, last, last_seq))
        state.setTimeoutTimestamp(max(last // 1000 + forget, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["key", "at", "kind", "severity", "was", "tier", "seq"])

    watched = named.withWatermark("at", late).groupBy("key")
    return watched.applyInPandasWithState(follow, ALERTS, "tier string, last long, seq long", "append", "EventTimeTimeout")


def realised_stream(predictions: DataFrame, outcomes: DataFrame, keys: list[str], made: str, came: str, within: str, late: str) -> DataFrame:
    """Each prediction with an outcome of its keys that came within a span of its making, or with null once the watermark shows that none will.

    Both sides are kept only as long as the other side may still match.
    """
    left = predictions.withWatermark(made, late).alias("p")
    right = outcomes.withWatermark(came, late).alias("o")
    on = (F.col(f"o.{came}") >= F.col(f"p.{made}")) & (F.col(f"o.{came}") <= F.col(f"p.{made}") + F.expr(f"INTERVAL {within}"))
    for k in keys:
        on = on & (F.col(f"p.{k}") == F.col(f"o.{k}"))
    return left.join(right, on, "left_outer").select("p.*", *[F.col(f"o.{c}") for c in outcomes.columns if c not in keys])


def tail(spark: SparkSession, table: str, id_: str, folder: str, beat_seconds: float, now: float, keep: Column | None = None) -> tuple[DataFrame, bool]:
    """The rows of an append table after the last ones told, in the order of id_, and whether a heartbeat is due.

    What was told last is a versioned pointer under folder that moves after the rows are written, so a poll that breaks off tells the same rows again
    under the same number. The first poll starts at the newest row. keep hides rows; hidden ones count as told.
    """
    place = f"{folder}/pointer"
    state = read_current(spark, place)
    newest = spark.read.parquet(table).agg(F.max(id_)).first()[0] or 0
    if state is None:
        write_version(spark.createDataFrame([(newest, now)], "last long, beat double"), place)
        return spark.read.parquet(table).limit(0), True
    last, beat = state.first()
    rows = spark.read.parquet(table).where((F.col(id_) > last) & (F.col(id_) <= newest))
    told = rows.where(keep) if keep is not None else rows
    told.write.mode("overwrite").parquet(f"{folder}/told/after={last}")
    due = now - beat >= beat_seconds
    write_version(spark.createDataFrame([(max(newest, last), now if due else beat)], "last long, beat double"), place)
    return spark.read.schema(rows.schema).parquet(f"{folder}/told/after={last}").orderBy(id_), due


def new_files(files: DataFrame, done: DataFrame) -> DataFrame:
    """Files (path, sha256, code_version) not processed yet with this content and version, one path for each, oldest
    first."""
    fresh = files.join(done.select("sha256", "code_version"), ["sha256", "code_version"], "left_anti")
    w = Window.partitionBy("sha256", "code_version").orderBy("modified", "path")
    return fresh.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n").orderBy("modified", "path")


def file_hashes(spark: SparkSession, folder: str, code_version: str) -> DataFrame:
    """path, modified and sha256 of the files in a folder."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return found.select("path", F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("sha256"), F.lit(code_version).alias("code_version"))
