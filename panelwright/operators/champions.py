"""Champions of targets as a log of decisions: promotion, reversal and sealed runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelwright.operators.relational import digest
from panelwright.sources.sinks import read_current, write_version

#: What can be decided. seq orders the decisions of a target.
DECISIONS = "target string, seq long, entry string, config string, champion_before string, decision string, reason string"


def decisions(spark: SparkSession, folder: str) -> DataFrame:
    found = read_current(spark, f"{folder}/decisions")
    return spark.createDataFrame([], DECISIONS) if found is None else found


def champions(log: DataFrame) -> DataFrame:
    """target, entry and config of the champion: the entry of the newest decision that put one in."""
    put = log.where(F.col("decision").isin("promoted", "reverted"))
    w = Window.partitionBy("target").orderBy(F.desc("seq"))
    return put.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("target", "entry", "config")


def _append(spark: SparkSession, folder: str, target: str, entry: str, config: str, before: str | None, decision: str, reason: str) -> None:
    log = decisions(spark, folder)
    seq = (log.where(F.col("target") == target).agg(F.max("seq")).first()[0] or 0) + 1
    row = spark.createDataFrame([(target, seq, entry, config, before, decision, reason)], DECISIONS)
    write_version(log.unionByName(row), f"{folder}/decisions")


def decide(spark: SparkSession, folder: str, target: str, entry: str, config: str, gains: dict[str, float], margins: dict[str, float], ece_new: float, ece_old: float, same_folds: bool = True, slack: float = 0.01) -> bool:
    """Whether entry becomes champion, logged with the reason.

    The first entry does. On other folds only the champion's own configuration does. Else no block may lose, one must gain its margin, and calibration may
    not be worse by more than slack.
    """
    held = champions(decisions(spark, folder)).where(F.col("target") == target).first()
    if held is None:
        ok, why = True, "no champion yet"
    elif not same_folds:
        ok = held["config"] == config
        why = "the champion's configuration on other folds" if ok else "other folds and another configuration: not comparable"
    else:
        worse = [b for b, g in gains.items() if g < 0]
        clears = [b for b, g in gains.items() if g >= margins.get(b, 0.0)]
        calibrated = ece_new <= ece_old + slack
        ok = not worse and bool(clears) and calibrated
        why = f"lower on {', '.join(worse) or 'no block'}; clears its margin on {', '.join(clears) or 'no block'}; calibration {'kept' if calibrated else 'worse'}"
    _append(spark, folder, target, entry, config, held and held["entry"], "promoted" if ok else "rejected", why)
    return ok


def revert(spark: SparkSession, folder: str, target: str, reason: str) -> str:
    """The champion that had another configuration last is champion again; returns its entry. An error where there is none."""
    log = decisions(spark, folder).where(F.col("target") == target)
    held = champions(log).first()
    if held is None:
        raise ValueError(f"{target} has no champion")
    before = log.where(F.col("decision").isin("promoted", "reverted") & (F.col("config") != held["config"])).orderBy(F.desc("seq")).first()
    if before is None:
        raise ValueError(f"{held['entry']} replaced no other configuration")
    _append(spark, folder, target, before["entry"], before["config"], held["entry"], "reverted", reason)
    return before["entry"]


def seal(rows: DataFrame, folder: str, run: str) -> None:
    """Keeps the content digest of a run's rows, once: a run that is sealed already is not sealed anew."""
    spark = rows.sparkSession
    held = read_current(spark, f"{folder}/seals")
    if held is not None and held.where(F.col("run") == run).take(1):
        raise ValueError(f"{run} is sealed")
    row = digest(rows).select(F.lit(run).alias("run"), F.to_json(F.struct("*")).alias("content"))
    write_version(row if held is None else held.unionByName(row), f"{folder}/seals")


def is_intact(rows: DataFrame, folder: str, run: str) -> bool:
    """Whether a run's rows are those that were sealed, in whatever order."""
    held = read_current(rows.sparkSession, f"{folder}/seals")
    sealed = held.where(F.col("run") == run).first() if held is not None else None
    return sealed is not None and sealed["content"] == digest(rows).select(F.to_json(F.struct("*")).alias("content")).first()[0]
