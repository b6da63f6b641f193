"""Weighted average precision and matched differences against plain loops over the same draws."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from panelwright.operators import resampling as R


def weight(cluster, b, seed):
    u = int(hashlib.md5(f"{cluster}:{b}:{seed}".encode()).hexdigest()[:8], 16) / 4294967296.0
    return sum(u >= r for r in R.REACHES)


def precision(rows):
    """rows of score, y and weight; equal scores are one step."""
    n = pos = total = 0.0
    for score in sorted({r[0] for r in rows}, reverse=True):
        own = [r for r in rows if r[0] == score]
        here = sum(w * y for _, y, w in own)
        n, pos = n + sum(w for *_, w in own), pos + here
        total += here * pos / n if n else 0.0
    return total / pos if pos else None


@pytest.mark.parametrize("levels", [7, 1000])
def test_paired_precision_equals_plain_loops(spark, levels):
    rng = random.Random(levels)
    rows = [(i, i % 23, i % 3, rng.random() < 0.2 + 0.1 * (i % 2), float(rng.randrange(levels)), rng.random() if i % 50 else 0.5) for i in range(400)]
    rows += [(1000 + i, 99, 7, False, 1.0, 2.0) for i in range(5)]  # a fold without a positive
    df = spark.createDataFrame(rows, "i long, k long, q long, y boolean, a double, b double").repartition(5)
    got = {r["b"]: r for r in R.paired_precision(df, "k", "q", "y", "a", "b", 20, 4).collect()}
    assert len(got) == 20
    for b, r in got.items():
        means = []
        for score in (4, 5):
            folds = [precision([(x[score], int(x[3]), weight(x[1], b, 4)) for x in rows if x[2] == q]) for q in (0, 1, 2, 7)]
            means.append(np.mean([f for f in folds if f is not None]))
        assert (r["ap_first"], r["ap_second"]) == pytest.approx(tuple(means)) and r["gain"] == pytest.approx(means[1] - means[0])


def test_matched_difference_equals_plain_loops(spark):
    rng = random.Random(3)
    rows = [(i % 31, "xyz"[rng.randrange(3)], rng.randrange(2), rng.gauss(0, 1) if i % 9 else None, rng.random() < 0.4, rng.random() < 0.6) for i in range(500)]
    rows += [(5, "only base", 0, 1.0, False, True), (6, "only group", 0, 5.0, True, False)]
    df = spark.createDataFrame(rows, "k long, s string, t int, v double, g boolean, b boolean")

    def estimate(times):
        cells = {}
        for k, s, t, v, g, b in rows:
            if v is not None:
                c = cells.setdefault((s, t), [0.0] * 4)
                for flag, at in ((g, 0), (b, 2)):
                    if flag:
                        c[at] += times(k)
                        c[at + 1] += times(k) * v
        used = [c for c in cells.values() if c[0] > 0 and c[2] > 0]
        n = sum(c[0] for c in used)
        return (sum(c[1] for c in used) - sum(c[0] * c[3] / c[2] for c in used)) / n, n / sum(c[0] for c in cells.values())

    (r,) = R.matched_difference(df, "k", "v", ["s", "t"], "g", "b", 50, 1).collect()
    draws = [estimate(lambda k, b=b: weight(k, b, 1))[0] for b in range(50)]
    assert (r["extra"], r["matched"]) == pytest.approx(estimate(lambda k: 1))
    assert (r["lo"], r["hi"]) == pytest.approx(tuple(np.percentile(draws, [2.5, 97.5])))
    assert r["p"] == pytest.approx(max(min(1.0, 2 * min(np.mean([d <= 0 for d in draws]), np.mean([d >= 0 for d in draws]))), 1 / 50))


def test_no_row_is_multiplied_by_the_resamples(spark):
    rows = spark.createDataFrame([(i, i % 3, float(i), i % 2 == 0, i % 2 == 1) for i in range(30)], "k long, s int, v double, g boolean, b boolean")
    out = R.matched_difference(rows, "k", "v", ["s"], "g", "b", 20, 1)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode(_w" not in plan and "MapInArrow" in plan


def test_weights_of_rows_with_scores_of_their_own_are_short(spark):
    n, pos = np.array([[1, 0, 3], [1, 2, 0], [200, 1, 1]]), np.array([[0, 0, 0], [1, 2, 0], [1, 1, 0]])
    batch = pa.RecordBatch.from_arrays(R._packed(n, pos), ["wide", "n", "pos"])
    assert [len(x) for x in batch.column("n").to_pylist()] == [3, 3, 24] and [len(x) for x in batch.column("pos").to_pylist()] == [0, 1, 24]
    assert all((a == b).all() for a, b in zip(R._opened(batch), (n, pos)))
