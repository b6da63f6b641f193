"""Quantile regression over a DataFrame: the pinball loss is minimised by reweighted least squares whose sums Spark adds up.

Numbers are standardised with the mean and deviation of the training rows, a null counts as the mean; a category becomes a column for each
value of the training rows but the first, so an unknown or null one counts as that. A round solves, for each level, the weighted
equations that touch the loss at the residuals of the round before (a bound above the loss, so it never rises), with the weights' floor lowered
from round to round. Every task adds up its rows' products; only those sums, the square of the number of columns, come back.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.sources.scratch import stored
from panelwright.sources.session import ship

#: Most values of a category that become columns; a category with more is an error, not cut.
MOST_VALUES = 500


class Design:
    """Numbers and categories as an array of doubles with a leading 1, learned from training rows."""

    def __init__(self, train: DataFrame, numeric: list[str], categorical: list[str]):
        stats = train.agg(*[f(F.col(c).cast("double")).alias(f"{n}_{c}") for c in numeric for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first() if numeric else {}
        self.numeric = [(c, stats[f"m_{c}"] or 0.0, stats[f"s_{c}"] or 1.0) for c in numeric]
        self.values = {}
        for c in categorical:
            found = [r[0] for r in train.select(c).where(F.col(c).isNotNull()).distinct().orderBy(c).limit(MOST_VALUES + 1).collect()]
            if len(found) > MOST_VALUES:
                raise ValueError(f"{c} has more than {MOST_VALUES} values")
            self.values[c] = found[1:]

    def column(self) -> Column:
        parts = [F.lit(1.0)]
        parts += [F.coalesce((F.col(c).cast("double") - m) / s, F.lit(0.0)) for c, m, s in self.numeric]
        parts += [F.coalesce(F.col(c) == F.lit(v), F.lit(False)).cast("double") for c, values in self.values.items() for v in values]
        return F.array(*parts)

    def names(self) -> list[str]:
        return ["1", *[c for c, *_ in self.numeric], *[f"{c}={v}" for c, values in self.values.items() for v in values]]


def matrix(batch: pa.RecordBatch, name: str = "x") -> np.ndarray:
    return batch.column(name).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def bound_sums(x: np.ndarray, y: np.ndarray, level: float, beta: np.ndarray | None, floor: float) -> tuple[np.ndarray, np.ndarray, float]:
    """What a round needs of some rows: X'WX, X'Wy + (2 level - 1) X'1 and the pinball loss. Without beta all weights are 1."""
    r = y - x @ beta if beta is not None else np.zeros(len(y))
    w = 1.0 / np.maximum(np.abs(r), floor) if beta is not None else np.ones(len(y))
    tilt = (2 * level - 1) * x.sum(0) if beta is not None else 0.0
    weighted = (x * w[:, None]).T
    return weighted @ x, weighted @ y + tilt, float(np.maximum(level * r, (level - 1) * r).sum())


def solved(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.linalg.solve(a + 1e-9 * np.trace(a) / len(a) * np.eye(len(a)), b)


def _round(levels: list[float], betas: list, floor: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: list = [0.0] * len(levels)
        n = 0
        for batch in batches:
            if batch.num_rows:
                x, y = matrix(batch), batch.column("y").to_numpy()
                n += len(y)
                for i, level in enumerate(levels):
                    a, b, loss = bound_sums(x, y, level, betas[i], floor)
                    sums[i] = sums[i] + np.concatenate([a.ravel(), b, [loss]])
        if n:
            place = [p for s in sums for p in range(len(s))]
            which = [i for i, s in enumerate(sums) for _ in range(len(s))]
            yield pa.RecordBatch.from_arrays([pa.array(which, pa.int32()), pa.array(place, pa.int32()), pa.array(np.concatenate(sums))], ["level", "place", "value"])

    return run


class QuantileModel:
    """A coefficient vector for each level."""

    def __init__(self, design: Design, levels: list[float], betas: list[np.ndarray], losses: list[list[float]]):
        self.design, self.levels, self.betas, self.losses = design, levels, betas, losses

    def predict(self, df: DataFrame, prefix: str = "q") -> DataFrame:
        """df with a column for each level, q05 for 0.05, sorted within the row so that they never cross."""
        dot = lambda beta: F.aggregate(F.zip_with("_x", F.array(*[F.lit(float(b)) for b in beta]), lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
        sorted_ = df.withColumn("_x", self.design.column()).withColumn("_q", F.array_sort(F.array(*map(dot, self.betas))))
        order = sorted(range(len(self.levels)), key=self.levels.__getitem__)
        names = {f"{prefix}{round(100 * self.levels[i]):02d}": F.col("_q")[place] for place, i in enumerate(order)}
        return sorted_.withColumns(names).drop("_x", "_q")


def fit(train: DataFrame, y: str, numeric: list[str], categorical: list[str], levels: tuple[float, ...] = (0.05, 0.5, 0.95), rounds: int = 25, tolerance: float = 1e-5) -> QuantileModel:
    """Linear quantile regressors of y; rows without y are left out. Ends when no level's loss falls by the share tolerance any more."""
    design = Design(train, numeric, categorical)
    known = train.where(F.col(y).isNotNull())
    rows = stored(known.select(F.col(y).cast("double").alias("y"), design.column().alias("x")))
    ship(rows.sparkSession)
    d = len(design.names())
    scale = rows.agg(F.stddev_pop("y")).first()[0] or 1.0
    betas: list = [None] * len(levels)
    losses: list[list[float]] = [[] for _ in levels]
    floor = scale
    for n in range(rounds + 1):
        sums = rows.mapInArrow(_round(list(levels), betas, floor), "level int, place int, value double").groupBy("level", "place").agg(F.sum("value").alias("value")).collect()
        if not sums:
            return QuantileModel(design, list(levels), [np.zeros(d) for _ in levels], losses)
        flat = np.zeros((len(levels), d * d + d + 1))
        for r in sums:
            flat[r["level"], r["place"]] = r["value"]
        if n:
            for i in range(len(levels)):
                losses[i].append(flat[i, -1])
            if n > 8 and all(track[-2] - track[-1] <= tolerance * track[-2] for track in losses):
                break
        betas = [solved(f[: d * d].reshape(d, d), f[d * d : d * d + d]) for f in flat]
        floor = max(scale * 1e-4, floor * 0.4)
    return QuantileModel(design, list(levels), betas, losses)
