"""Boosted trees with early stopping, bags and a seeded search by successive halving; a two-part model of amounts."""

from __future__ import annotations

import json
import random
from dataclasses import asdict, dataclass

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.operators.models import _features
from panelwright.operators.resampling import poisson, uniform
from panelwright.sources.scratch import stored
from panelwright.sources.together import together


@dataclass(frozen=True)
class Params:
    """What a trial may vary; the defaults are trial 0."""

    depth: int = 3
    step: float = 0.1
    share: float = 1.0
    least: int = 1


#: Values a trial draws from.
SPACE = {"depth": (2, 3, 4), "step": (0.05, 0.1, 0.2), "share": (0.6, 0.8, 1.0), "least": (1, 20, 50)}
#: Rounds without a gain of this share of the loss end the boosting; trees a refit has at least.
TOLERANCE, LEAST_TREES = 0.01, 2


def trials(n: int, seed: int) -> list[Params]:
    """The default and n - 1 others drawn from SPACE, each once; fewer where the space has fewer."""
    draw, out = random.Random(seed), [Params()]
    space = 1
    for values in SPACE.values():
        space *= len(values)
    while len(out) < min(n, space):
        one = Params(**{name: draw.choice(values) for name, values in SPACE.items()})
        if one not in out:
            out.append(one)
    return out


class Folded:
    """A fold's rows as vectors, made once for all fits on it."""

    def __init__(self, train: DataFrame, test: DataFrame, y: str, numeric: list[str], categorical: list[str]):
        label = F.col(y).cast("double")
        pipe = Pipeline(stages=_features(numeric, categorical)).fit(train)
        self.train = stored(pipe.transform(train).withColumn("label", label).drop(*[f"{c}_im" for c in numeric], *[f"{c}_ix" for c in categorical]))
        self.test = stored(pipe.transform(test).drop(*[f"{c}_im" for c in numeric], *[f"{c}_ix" for c in categorical]))
        self.names = [*numeric, *categorical]


def _booster(params: Params, trees: int, seed: int, **more) -> GBTClassifier:
    return GBTClassifier(maxIter=trees, maxDepth=params.depth, stepSize=params.step, subsamplingRate=params.share, minInstancesPerNode=params.least, seed=seed, **more)


def stopped_trees(train: DataFrame, params: Params, most: int, period: str, target: str, seed: int) -> int:
    """Trees at which the loss of the newest training period stops falling, fitted on rows whose outcome was known before it."""
    newest = train.agg(F.max(period)).first()[0]
    rows = train.where((F.col(target) < newest) | (F.col(period) == newest)).withColumn("_held", F.col(period) == newest)
    sides = {r["_held"] for r in rows.select("_held").distinct().collect()}
    if sides != {True, False}:
        return most
    model = _booster(params, most, seed, validationIndicatorCol="_held", validationTol=TOLERANCE).fit(rows)
    return max(LEAST_TREES, model.getNumTrees)


def fit(fold: Folded, params: Params, trees: int, seed: int, weight: Column | None = None):
    """A model of all training rows; weight is a column of row weights, rows of weight 0 are left out."""
    if weight is None:
        return _booster(params, trees, seed).fit(fold.train)
    return _booster(params, trees, seed, weightCol="_weight").fit(fold.train.withColumn("_weight", weight.cast("double")).where("_weight > 0"))


def scored(fold: Folded, model, name: str = "p") -> DataFrame:
    return model.transform(fold.test).withColumn(name, vector_to_array("probability")[1]).drop("rawPrediction", "probability", "prediction")


def bagged(fold: Folded, params: Params, trees: int, n: int, cluster: str, seed: int = 0) -> DataFrame:
    """fold's test rows with p, the mean of n models, each of a resample of the clusters with Poisson weights."""
    out = fold.test
    for i in range(n):
        weight = poisson(uniform(F.col(cluster).cast("string"), F.lit(str(seed * n + i))))
        model = fit(fold, params, trees, seed * n + i, weight)
        out = model.transform(out).withColumn(f"_p{i}", vector_to_array("probability")[1]).drop("rawPrediction", "probability", "prediction")
    return out.withColumn("p", sum((F.col(f"_p{i}") for i in range(n)), F.lit(0.0)) / n).drop(*[f"_p{i}" for i in range(n)])


def search(folds: list[Folded], score, rungs: list[tuple[int, int]], n: int, seed: int, period: str, target: str) -> list[dict]:
    """A row for each trial and rung: its parameters, trees and score, whether it goes on, and whether it is the best.

    rungs are (folds, most trees), growing; after each rung the better half of the trials goes on. score gives a number for a
    fold's scored rows; a trial's score is the mean over the rung's newest folds, and equal scores go to the earlier trial. The default always goes
    on, so the best is not worse than it. A rung's fits are submitted together; boosting that stopped in
    an earlier rung before the most trees there stops at the same tree again, so neither that nor a model of as many trees is fitted again.
    """
    alive, rows, known_scores, stopped = list(enumerate(trials(n, seed))), [], {}, {}
    for rung, (width, most) in enumerate(rungs):
        newest, found = range(len(folds))[-width:], []

        def tried(one, most=most):
            params, place = one
            fold = folds[place]
            count, limit = stopped.get((params, place), (0, 0))
            if count >= limit:
                count = stopped_trees(fold.train, params, most, period, target, seed)
                stopped[params, place] = count, most
            if (params, place, count) not in known_scores:
                known_scores[params, place, count] = score(scored(fold, fit(fold, params, count, seed)))
            return count, known_scores[params, place, count]

        asked = [(params, place) for _, params in alive for place in newest]
        got = dict(zip(asked, together(folds[-1].train.sparkSession, tried, asked)))
        for number, params in alive:
            values, trees = [got[params, place][1] for place in newest], [got[params, place][0] for place in newest]
            known = [v for v in values if v is not None]
            found.append({"trial": number, "rung": rung, **asdict(params), "params": json.dumps(asdict(params), sort_keys=True), "trees": sum(trees) / max(1, len(trees)), "score": sum(known) / len(known) if known else None})
        ranked = sorted(found, key=lambda r: (-(r["score"] if r["score"] is not None else -1.0), r["trial"]))
        on = {r["trial"] for r in ranked[: max(1, len(ranked) // 2)]} | {0}
        last = rung == len(rungs) - 1
        rows += [{**r, "goes_on": not last and r["trial"] in on, "best": last and r["trial"] == ranked[0]["trial"]} for r in found]
        alive = [a for a in alive if a[0] in on]
    return rows


class Amounts(Folded):
    """Two parts: the chance that an amount reaches a step, and its size among those that do, as log1p."""

    def two_parts(self, y: str, step: float, trees: int = 10, depth: int = 3, seed: int = 7) -> DataFrame:
        """Test rows with p_step, size and amount, their product. Without a row that reaches the step the amount is 0; where all do p_step is 1."""
        reached = F.col(y) >= step
        share = self.train.agg(F.avg(reached.cast("double"))).first()[0] or 0.0
        if share in (0.0, 1.0):
            test = self.test.withColumn("p_step", F.lit(share))
        else:
            chance = GBTClassifier(maxIter=trees, maxDepth=depth, seed=seed).fit(self.train.withColumn("label", reached.cast("double")))
            test = chance.transform(self.test).withColumn("p_step", vector_to_array("probability")[1]).drop("rawPrediction", "probability", "prediction")
        if share == 0.0:
            return test.withColumn("size", F.lit(0.0)).withColumn("amount", F.lit(0.0))
        size = GBTRegressor(maxIter=trees, maxDepth=depth, seed=seed).fit(self.train.where(reached).withColumn("label", F.log1p(F.greatest(F.col(y), F.lit(0.0)))))
        sized = size.transform(test).withColumn("size", F.expm1("prediction")).drop("prediction")
        return sized.withColumn("amount", F.col("p_step") * F.col("size"))


def error_summary(df: DataFrame, groups: list[str], y: str, methods: list[str], step: float) -> DataFrame:
    """n, the share that reaches step, and for each method mae, rmse, bias and the mae on either side of the step."""
    long = df.select(*groups, F.col(y).alias("_y"), F.explode(F.array(*[F.struct(F.lit(m).alias("method"), F.col(m).cast("double").alias("value")) for m in methods])).alias("_m")).select(*groups, "_y", "_m.*")
    error, reached = F.col("_y") - F.col("value"), F.col("_y") >= step
    return long.groupBy(*groups, "method").agg(
        F.count("*").alias("n"),
        F.avg(reached.cast("double")).alias("share_stepped"),
        F.avg(F.abs(error)).alias("mae"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        F.avg(error).alias("bias"),
        F.avg(F.when(reached, F.abs(error))).alias("mae_stepped"),
        F.avg(F.when(~reached, F.abs(error))).alias("mae_unstepped"),
    )
