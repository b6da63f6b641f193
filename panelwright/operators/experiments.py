"""Experiment runs as tables: fits of variants by fold and seed, written once and resumed, compared with paired intervals."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.operators import aggregates, resampling
from panelwright.sources.together import together

#: A variant: from training rows, test rows and a seed to the test rows with p.
Variant = Callable[[DataFrame, DataFrame, int], DataFrame]


def _is_there(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


class Run:
    """Scores of variants under a folder, one part for each variant, fold and seed; a part counts when its write has ended."""

    def __init__(self, spark: SparkSession, folder: str, keep: list[str], y: str):
        self.spark, self.folder, self.keep, self.y = spark, folder, keep, y

    def _part(self, variant: str, fold: int, seed: int) -> str:
        return f"{self.folder}/variant={variant}/fold={fold}/seed={seed}"

    def fill(self, variants: dict[str, Variant], folds: list[int], seeds: list[int], split: Callable[[int], tuple[DataFrame, DataFrame]], at_once: int = 1) -> int:
        """Fits what is missing, at_once together, and returns how many fits that took; none is begun after one that failed. A part whose write
        broke off is written again."""
        asked = [(name, fold, seed) for fold in folds for name in variants for seed in seeds]
        missing = [one for one in asked if not _is_there(self.spark, f"{self._part(*one)}/_SUCCESS")]

        def fit(one: tuple[str, int, int]) -> None:
            name, fold, seed = one
            found = variants[name](*split(fold), seed).select(*self.keep, F.col(self.y).cast("int").alias("y"), F.col("p").cast("double").alias("p"))
            found.write.mode("overwrite").parquet(self._part(*one))

        for i in range(0, len(missing), at_once):
            together(self.spark, fit, missing[i : i + at_once], at_once)
        return len(missing)

    def scores(self) -> DataFrame:
        """All scored rows with variant, fold and seed."""
        return self.spark.read.option("basePath", self.folder).parquet(f"{self.folder}/variant=*/fold=*/seed=*")

    def metrics(self, groups: tuple[str, ...] = ()) -> DataFrame:
        """Rows, positives, average precision and Brier score of each variant, fold and seed, also by the slices groups."""
        by = ["variant", "fold", "seed", *groups]
        rows = self.scores()
        ap = aggregates.average_precision(rows.withColumn("y", F.col("y") == 1), by, "p", "y")
        error = (F.col("p") - F.col("y")) ** 2
        rest = rows.groupBy(*by).agg(F.count("*").alias("n"), F.sum("y").alias("positives"), F.avg(error).alias("brier"))
        on = F.lit(True)
        for c in by:
            on = on & F.col(f"r.{c}").eqNullSafe(F.col(f"a.{c}"))
        return rest.alias("r").join(ap.alias("a"), on).select(*[F.col(f"r.{c}") for c in by], "n", "positives", "ap", "brier")

    def compared(self, champion: str, cluster: str, blocks: dict[str, list[int]], n_boot: int = 200) -> DataFrame:
        """A row for each other variant and block of folds: mean average precision, the gain over the champion, its 90% interval by resampled clusters,
        the noise margin (twice the spread of the champion over seeds) and whether the gain exceeds the margin with its interval above 0."""
        metric = self.metrics().select("variant", "fold", "seed", "ap")
        out = None
        names = [r["variant"] for r in metric.select("variant").distinct().orderBy("variant").collect() if r["variant"] != champion]
        keys = [c for c in self.keep if c != "p"]
        mean = self.scores().groupBy("variant", "fold", *keys, "y").agg(F.avg("p").alias("p"))
        for block, folds in blocks.items():
            inside = metric.where(F.col("fold").isin(folds))
            by_seed = inside.groupBy("variant", "seed").agg(F.avg("ap").alias("ap"))
            told = by_seed.groupBy("variant").agg(F.avg("ap").alias("ap"), F.coalesce(F.stddev_samp("ap"), F.lit(0.0)).alias("sd"))
            own = {r["variant"]: (r["ap"], r["sd"]) for r in told.collect()}
            for name in names:
                pairs = mean.where((F.col("variant") == champion) & F.col("fold").isin(folds)).select("fold", *keys, "y", F.col("p").alias("first"))
                pairs = pairs.join(mean.where(F.col("variant") == name).select("fold", *keys, F.col("p").alias("second")), ["fold", *keys])
                boot = resampling.paired_precision(pairs, cluster, "fold", "y", "first", "second", n_boot)
                gain, margin = (own[name][0] or 0.0) - (own[champion][0] or 0.0), 2 * own[champion][1]
                row = boot.agg(F.percentile("gain", 0.05).alias("lo"), F.percentile("gain", 0.95).alias("hi")).select(F.lit(block).alias("block"), F.lit(name).alias("variant"), F.lit(own[name][0]).cast("double").alias("ap"), F.lit(gain).alias("gain"), "lo", "hi", F.lit(margin).alias("margin"))
                row = row.withColumn("robust", (F.col("gain") >= F.col("margin")) & (F.col("lo") > 0))
                out = row if out is None else out.unionByName(row)
        return out
