"""Quantile regression against the exact optimum, Shapley shares against all subsets of features."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler, VectorIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from panelwright.operators import attribution as S
from panelwright.operators import models as M
from panelwright.operators import quantiles as Q


def pinball(y, q, level):
    return np.maximum(level * (y - q), (level - 1) * (y - q)).sum()


def test_regressors_reach_the_exact_optimum(spark):
    """A line that minimises the pinball loss runs through two points: all pairs are tried."""
    rng = random.Random(4)
    rows = [(x, 3.0 * x + rng.gauss(0, 1 + abs(x))) for x in (rng.uniform(-3, 3) for _ in range(60))]
    df = spark.createDataFrame(rows, "x double, y double")
    model = Q.fit(df, "y", ["x"], [], rounds=60, tolerance=1e-9)
    got = [(r["x"], r["y"], r["q05"], r["q50"], r["q95"]) for r in model.predict(df).collect()]
    x, y, *fitted = (np.array(c) for c in zip(*got))
    assert (fitted[0] <= fitted[1]).all() and (fitted[1] <= fitted[2]).all()
    for level, q in zip((0.05, 0.5, 0.95), fitted):
        best = math.inf
        for (x0, y0), (x1, y1) in itertools.combinations(rows, 2):
            if x0 != x1:
                slope = (y1 - y0) / (x1 - x0)
                best = min(best, pinball(y, y0 + slope * (x - x0), level))
        assert pinball(y, q, level) <= 1.02 * best


def test_regressors_equal_one_array(spark):
    """The sums of many tasks give the rounds of one array."""
    rng = random.Random(9)
    rows = [(i, rng.choice(["a", "b", "c"]), rng.gauss(0, 1) if i % 7 else None, rng.gauss(5, 2)) for i in range(300)]
    df = spark.createDataFrame(rows, "i long, g string, x double, y double").repartition(6)
    model = Q.fit(df, "y", ["x"], ["g"], levels=(0.3,), rounds=6, tolerance=0.0)
    design = Q.Design(df, ["x"], ["g"])
    assert design.names() == ["1", "x", "g=b", "g=c"]
    data = df.select("y", design.column().alias("x")).collect()
    x, y = np.array([r["x"] for r in data]), np.array([r["y"] for r in data])
    beta, floor = None, y.std()
    for n in range(7):
        a, b, _ = Q.bound_sums(x, y, 0.3, beta, floor)
        beta, floor = Q.solved(a, b), max(y.std() * 1e-4, floor * 0.4)
    assert model.betas[0] == pytest.approx(beta, rel=1e-6)


def test_regressors_beat_quantiles_of_groups_on_held_out_rows(spark):
    rng = random.Random(2)
    rows = [(i, "ab"[i % 2], x, 2 * x + (i % 2) + rng.expovariate(1.0)) for i, x in enumerate(rng.gauss(0, 2) for _ in range(600))]
    df = spark.createDataFrame(rows, "i long, g string, x double, y double")
    train, test = df.where("i < 400"), df.where("i >= 400")
    ours, groups = Q.fit(train, "y", ["x"], ["g"]).predict(test), M.group_quantiles(train, test, "y", ["g"])
    for level, q in ((0.05, "q05"), (0.5, "q50"), (0.95, "q95")):
        loss = [pinball(*(np.array(c) for c in zip(*[(r["y"], r[q]) for r in d.collect()])), level) for d in (ours, groups)]
        assert loss[0] < 0.8 * loss[1]


def test_regressors_of_no_rows(spark):
    none = spark.createDataFrame([], "g string, x double, y double")
    assert Q.fit(none, "y", ["x"], ["g"]).predict(none).columns == ["g", "x", "y", "q05", "q50", "q95"]


@pytest.fixture(scope="module")
def boosted(spark):
    rng = random.Random(8)
    rows = [(rng.gauss(0, 1), rng.gauss(0, 1), float(rng.randrange(4)), rng.gauss(0, 1)) for _ in range(400)]
    rows = [(*r, float(r[0] * r[1] + (r[2] in (1.0, 3.0)) + 0.3 * rng.gauss(0, 1) > 0.4)) for r in rows]
    df = VectorAssembler(inputCols=["a", "b", "c", "d"], outputCol="raw").transform(spark.createDataFrame(rows, "a double, b double, c double, d double, label double"))
    df = VectorIndexer(inputCol="raw", outputCol="features", maxCategories=4).fit(df).transform(df)
    return GBTClassifier(maxIter=4, maxDepth=3, seed=1).fit(df), df


def conditional(paths, x, known):
    """Mean score of the leaves where the known features of x lead and the others are spread by training rows."""
    total = 0.0
    for value, _, _, features in S._by_leaf(paths):
        for feature, low, high, kept, passed in features:
            value *= (low < x[feature] <= high and (kept is None or x[feature] in kept)) if feature in known else passed
        total += value
    return total


def test_shares_equal_all_subsets_and_sum_to_the_score(spark, boosted):
    model, df = boosted
    paths = S.tree_paths(model)
    assert any(p[7] is not None for p in paths) and any(math.isfinite(p[5]) for p in paths)
    scored = model.transform(df.limit(20)).select(vector_to_array("features").alias("x"), vector_to_array("rawPrediction")[1].alias("margin"))
    got = S.attributed(scored, "x", list("abcd"), lambda x: S.shares(x, paths), top=2).collect()
    base = S.mean_score(paths)
    assert base == pytest.approx(conditional(paths, [0.0] * 4, set()))
    n = 4
    for r in got:
        x = r["x"]
        assert sum(r["shares"]) == pytest.approx(r["margin"] - base)
        for j in range(n):
            share = 0.0
            for size in range(n):
                for inside in itertools.combinations([i for i in range(n) if i != j], size):
                    weight = math.factorial(size) * math.factorial(n - size - 1) / math.factorial(n)
                    share += weight * (conditional(paths, x, {*inside, j}) - conditional(paths, x, {*inside}))
            assert r["shares"][j] == pytest.approx(share, abs=1e-9)
        best = sorted(range(n), key=lambda j: (-abs(r["shares"][j]), j))[:2]
        assert [t["feature"] for t in r["top"]] == ["abcd"[j] for j in best]
        assert [t["contribution"] for t in r["top"]] == [r["shares"][j] for j in best]


def test_paths_as_a_table(spark, boosted):
    """Covers of a tree's leaves sum to its training rows."""
    rows = S.paths_table(spark, S.tree_paths(boosted[0])).select("tree", "leaf", "cover").distinct().groupBy("tree").agg(F.sum("cover").alias("n")).collect()
    assert {r["n"] for r in rows} == {400.0}


def test_linear_shares(spark):
    x = np.array([[1.0, 2.0], [3.0, 4.0]])
    assert S.linear_shares([2.0, -1.0], [1.0, 1.0])(x).tolist() == [[0.0, -1.0], [4.0, -3.0]]
