"""What each feature adds to a score: exact Shapley shares of boosted trees and of linear models, and the largest of a row.

A boosted model is read out as rows: one for each leaf and each feature on its path, with the interval of values that leads there and
the share of training rows that the feature's splits let through. For a leaf, a set of known features is worth the leaf's value
times 1 or 0 for each known feature of the path and the share let through for each other one; summed over leaves that is the tree's mean
over the unknown features. As this is a product, a feature's Shapley share in a leaf is a sum over the other features of the path,
few in trees of small depth. Shares and the mean score sum to the score.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.sources.session import ship

PATHS = "tree int, leaf int, value double, cover double, feature int, low double, high double, categories array<double>, passed double"


def _leaves(node, path: dict, scale: float) -> Iterator[tuple[float, float, dict]]:
    """Value, rows and path of each leaf below a node of a JVM tree: path has low, high, categories and share by feature."""
    rows = node.impurityStats().count()
    if node.subtreeDepth() == 0:
        yield scale * node.prediction(), rows, path
        return
    split = node.split()
    feature = split.featureIndex()
    low, high, kept, share = path.get(feature, (-math.inf, math.inf, None, 1.0))
    for child, left in ((node.leftChild(), True), (node.rightChild(), False)):
        passed = share * child.impurityStats().count() / rows
        if split.getClass().getSimpleName() == "ContinuousSplit":
            cut = split.threshold()
            part = (low, min(high, cut), kept, passed) if left else (max(low, cut), high, kept, passed)
        else:
            own = list(split.leftCategories() if left else split.rightCategories())
            part = (low, high, own if kept is None else [c for c in kept if c in own], passed)
        yield from _leaves(child, {**path, feature: part}, scale)


def tree_paths(model) -> list[tuple]:
    """Rows as PATHS of a boosted model of MLlib; a leaf without a split has one row without a feature. The score is the raw margin."""
    out = []
    for tree, (each, weight) in enumerate(zip(model.trees, model.treeWeights)):
        for leaf, (value, rows, path) in enumerate(_leaves(each._java_obj.rootNode(), {}, weight)):
            parts = path.items() or [(None, (-math.inf, math.inf, None, 1.0))]
            out += [(tree, leaf, value, float(rows), f, low, high, kept, passed) for f, (low, high, kept, passed) in parts]
    return out


def paths_table(spark: SparkSession, paths: list[tuple]) -> DataFrame:
    return spark.createDataFrame(paths, PATHS)


def _by_leaf(paths: list[tuple]) -> list[tuple[float, float, int, list]]:
    leaves: dict = {}
    for tree, leaf, value, cover, feature, *rest in paths:
        leaves.setdefault((tree, leaf), (value, cover, tree, []))[3].append((feature, *rest))
    return [(v, c, t, [f for f in fs if f[0] is not None]) for v, c, t, fs in leaves.values()]


def mean_score(paths: list[tuple]) -> float:
    """The score with no feature known: leaves weighed by their training rows."""
    leaves = _by_leaf(paths)
    rows: dict = {}
    for _, cover, tree, _ in leaves:
        rows[tree] = rows.get(tree, 0.0) + cover
    return sum(value * cover / rows[tree] for value, cover, tree, _ in leaves)


def shares(x: np.ndarray, paths: list[tuple]) -> np.ndarray:
    """Shapley share of each feature (column) for each row of x."""
    out = np.zeros(x.shape)
    for value, _, _, features in _by_leaf(paths):
        known = []
        for feature, low, high, kept, _ in features:
            column = x[:, feature]
            known.append(((column > low) & (column <= high) & (True if kept is None else np.isin(column, kept))).astype(float))
        passed = [f[4] for f in features]
        n = len(features)
        for j, (feature, *_) in enumerate(features):
            others = [i for i in range(n) if i != j]
            total = 0.0
            for size in range(n):
                weight = math.factorial(size) * math.factorial(n - size - 1) / math.factorial(n)
                for inside in combinations(others, size):
                    product = weight
                    for i in others:
                        product = product * (known[i] if i in inside else passed[i])
                    total = total + product
            out[:, feature] += value * (known[j] - passed[j]) * total
    return out


def linear_shares(coefficients: list[float], means: list[float]):
    """A function of rows to coefficient times distance from the mean."""
    return lambda x: (x - np.array(means)) * np.array(coefficients)


def attributed(df: DataFrame, features: str, names: list[str], of, top: int = 5) -> DataFrame:
    """df with shares (one for each feature) and top, the features with the largest shares: feature, value and contribution, by size
    without sign and then by place. features is an array of doubles; of gives a matrix of shares for a matrix of rows."""
    ship(df.sparkSession)

    @F.arrow_udf("struct<shares:array<double>,top:array<struct<feature:string,value:double,contribution:double>>>")
    def told(column: pa.Array) -> pa.Array:
        x = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
        found = of(x)
        order = np.argsort(-np.abs(found), axis=1, kind="stable")[:, :top]
        rows = [{"shares": s.tolist(), "top": [{"feature": names[j], "value": float(v[j]), "contribution": float(s[j])} for j in best]} for s, v, best in zip(found, x, order)]
        return pa.array(rows, pa.struct([("shares", pa.list_(pa.float64())), ("top", pa.list_(pa.struct([("feature", pa.string()), ("value", pa.float64()), ("contribution", pa.float64())])))]))

    return df.withColumn("_told", told(F.col(features))).withColumn("shares", F.col("_told.shares")).withColumn("top", F.col("_told.top")).drop("_told")
