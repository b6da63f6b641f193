"""Models over panel rows with MLlib: rolling-origin folds, calibration, hazards, quantiles, promotion rules."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import Imputer, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.functions.scalars import logit, platt


def fold(df: DataFrame, cutoff: int, period: str, target: str) -> tuple[DataFrame, DataFrame]:
    """Training rows whose outcome is known by the cutoff, and the rows to score at it."""
    return df.where(F.col(target) <= cutoff), df.where(F.col(period) == cutoff)


def windows(coverage: dict[int, float], rows: dict[int, int], horizon: int, reliable: float = 0.8, least: int = 100, n_val: int = 6, n_test: int = 1) -> tuple[list[int], list[int]]:
    """Validation and test cutoffs from the share of known values and the labelled rows of each period.

    A cutoff is usable with least rows, and if it and its target are reliable. The newest are for the test; validation has
    the newest of the rest within one run of reliable periods.
    """
    known = {q for q, share in coverage.items() if share >= reliable}
    usable = sorted(q for q, n in rows.items() if n >= least and q in known and q + horizon in known)
    test, rest = usable[-n_test:], usable[:-n_test]
    start = rest[-1] if rest else 0
    while start - 1 in known:
        start -= 1
    return [q for q in rest if q >= start][-n_val:], test


def _features(numeric: list[str], categorical: list[str]) -> list:
    return [
        *[StringIndexer(inputCol=c, outputCol=f"{c}_ix", handleInvalid="keep") for c in categorical],
        Imputer(inputCols=numeric, outputCols=[f"{c}_im" for c in numeric]),
        VectorAssembler(inputCols=[*[f"{c}_im" for c in numeric], *[f"{c}_ix" for c in categorical]], outputCol="features"),
    ]


def naive(train: DataFrame, test: DataFrame, y: str, group: str) -> DataFrame:
    """test with p, the training rate of its group, else of all."""
    rates = train.groupBy(group).agg(F.avg(F.col(y).cast("double")).alias("p"))
    overall = train.agg(F.avg(F.col(y).cast("double")).alias("p_all"))
    return test.join(rates, group, "left").crossJoin(F.broadcast(overall)).withColumn("p", F.coalesce("p", "p_all")).drop("p_all")


def _scored(model, test: DataFrame, keep: list[str]) -> DataFrame:
    return model.transform(test).select(*keep, vector_to_array("probability")[1].alias("p"))


def logistic(train: DataFrame, test: DataFrame, y: str, numeric: list[str], categorical: list[str]) -> DataFrame:
    rows = train.withColumn("label", F.col(y).cast("double"))
    model = Pipeline(stages=[*_features(numeric, categorical), LogisticRegression(maxIter=20, regParam=0.01)]).fit(rows)
    return _scored(model, test, test.columns)


def boosted(train: DataFrame, test: DataFrame, y: str, numeric: list[str], categorical: list[str], weight: str | None = None, trees: int = 10, seed: int = 7) -> DataFrame:
    """Gradient-boosted trees; weight names a column of row weights."""
    rows = train.withColumn("label", F.col(y).cast("double"))
    gbt = GBTClassifier(maxIter=trees, maxDepth=3, seed=seed, **({"weightCol": weight} if weight else {}))
    return _scored(Pipeline(stages=[*_features(numeric, categorical), gbt]).fit(rows), test, test.columns)


def platt_fit(pool: DataFrame, p: str, y: str) -> tuple[float, float]:
    """Slope and intercept of the logistic regression of outcomes on the logit of p."""
    rows = pool.select(logit(F.col(p)).alias("z"), F.col(y).cast("double").alias("label"))
    model = LogisticRegression(maxIter=50).fit(VectorAssembler(inputCols=["z"], outputCol="features").transform(rows))
    return float(model.coefficients[0]), float(model.intercept)


def platt_calibrated(df: DataFrame, pool: DataFrame, p: str, y: str) -> DataFrame:
    a, b = platt_fit(pool, p, y)
    return df.withColumn("p_cal", platt(F.col(p), a, b))


def isotonic_calibrated(df: DataFrame, pool: DataFrame, p: str, y: str) -> DataFrame:
    vector = VectorAssembler(inputCols=[p], outputCol="_f")
    rows = vector.transform(pool.withColumn("label", F.col(y).cast("double")))
    model = IsotonicRegression(featuresCol="_f", labelCol="label", predictionCol="p_cal").fit(rows)
    return model.transform(vector.transform(df)).drop("_f")


def conformal_margin(pool: DataFrame, y: str, lo: str, hi: str, level: float = 0.9) -> DataFrame:
    """One row, margin: how far intervals must widen to cover level of the pool."""
    score = F.greatest(F.col(lo) - F.col(y), F.col(y) - F.col(hi))
    return pool.agg(F.percentile(score, level).alias("margin"))


def group_quantiles(train: DataFrame, test: DataFrame, y: str, groups: list[str], levels: tuple[float, ...] = (0.05, 0.5, 0.95)) -> DataFrame:
    """test with the training quantiles of its group, else of all: MLlib has no quantile regression."""
    at = F.array(*map(F.lit, levels))
    own = train.groupBy(*groups).agg(F.percentile(y, at).alias("_q"))
    all_ = train.agg(F.percentile(y, at).alias("_qa"))
    q = F.coalesce("_q", "_qa")
    joined = test.join(own, groups, "left").crossJoin(F.broadcast(all_))
    return joined.withColumns({f"q{int(100 * level):02d}": q[i] for i, level in enumerate(levels)}).drop("_q", "_qa")


def promote(gains: list[tuple[float, float, float]], margin: float, ece_new: float, ece_old: float) -> bool:
    """Whether a challenger replaces the champion: every block's gain (mean, low, high) is above margin with its low end
    above 0, and calibration is not worse by more than a point."""
    return all(mean > margin and low > 0 for mean, low, _ in gains) and ece_new <= ece_old + 0.01
