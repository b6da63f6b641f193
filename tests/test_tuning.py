"""Search, early stopping, bags, two-part amounts and runs that go on where they stopped."""

import random

import pytest
from pyspark.sql import functions as F

from panelwright.operators import experiments, models, tuning

NUMBERS, LABELS = ["a", "b"], ["g"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(6)
    data = []
    for i in range(500):
        a, b, q = rng.gauss(0, 1), rng.gauss(0, 1), i % 6
        amount = max(0.0, 10 * a + rng.gauss(0, 2))
        data.append((i % 60, q, q + 1, a, b, "xy"[i // 6 % 2], bool(a + 0.2 * rng.gauss(0, 1) > 0.5), amount))
    return spark.createDataFrame(data, "k long, q int, target_q int, a double, b double, g string, y boolean, paid double").cache()


def split(df, cutoff):
    return models.fold(df, cutoff, "q", "target_q")


def test_trials_agree_and_start_with_the_default():
    first = tuning.trials(20, 5)
    assert first == tuning.trials(20, 5) and first[0] == tuning.Params() and len({*first}) == 20
    assert len(tuning.trials(10_000, 1)) == 81


def test_halving_keeps_the_better_half_and_the_default(spark, rows, monkeypatch):
    monkeypatch.setattr(tuning, "fit", lambda fold, params, trees, seed: params)
    monkeypatch.setattr(tuning, "stopped_trees", lambda train, params, most, *rest: most)
    monkeypatch.setattr(tuning, "scored", lambda fold, model: (fold, model))
    fold = tuning.Folded(*split(rows, 4), "y", NUMBERS, LABELS)
    seen = tuning.trials(8, 1)
    value = {p: (0.0 if n == 0 else float(n % 5)) for n, p in enumerate(seen)}
    found = tuning.search([fold], lambda s: value[s[1]], [(1, 2), (1, 4), (1, 8)], 8, 1, "q", "target_q")
    by_rung = [[r["trial"] for r in found if r["rung"] == rung] for rung in range(3)]
    assert by_rung == [[0, 1, 2, 3, 4, 5, 6, 7], [0, 2, 3, 4, 7], [0, 3, 4]]
    assert [r["trial"] for r in found if r["best"]] == [4]


def test_boosting_stops_and_bags_are_means(spark, rows):
    fold = tuning.Folded(*split(rows, 4), "y", NUMBERS, LABELS)
    count = tuning.stopped_trees(fold.train, tuning.Params(step=0.2), 12, "q", "target_q", 3)
    assert tuning.LEAST_TREES <= count <= 12
    only = fold.train.where("q = 3")
    assert tuning.stopped_trees(only, tuning.Params(), 5, "q", "target_q", 3) == 5  # nothing known before the newest period
    bag = tuning.bagged(fold, tuning.Params(), 2, 2, "k")
    again = {(r["k"], r["a"]): r["p"] for r in tuning.bagged(fold, tuning.Params(), 2, 2, "k").collect()}
    assert {(r["k"], r["a"]): r["p"] for r in bag.collect()} == again
    weight = lambda i: tuning.poisson(tuning.uniform(F.col("k").cast("string"), F.lit(str(i))))
    singles = [{(r["k"], r["a"]): r["p"] for r in tuning.scored(fold, tuning.fit(fold, tuning.Params(), 2, i, weight(i))).collect()} for i in range(2)]
    assert again == {key: pytest.approx((p + singles[1][key]) / 2) for key, p in singles[0].items()}


def test_amounts_are_chance_times_size(spark, rows):
    two = tuning.Amounts(*split(rows, 4), "y", NUMBERS, LABELS).two_parts("paid", 5.0, trees=2)
    got = two.select("p_step", "size", "amount", "paid").collect()
    assert len(got) > 50 and all(r["p_step"] * r["size"] == pytest.approx(r["amount"]) for r in got)
    assert sum(abs(r["paid"] - r["amount"]) for r in got) < 0.6 * sum(r["paid"] for r in got)


@pytest.mark.parametrize("step, chance", [(1e9, 0.0), (-1.0, 1.0)])
def test_amounts_without_a_step(spark, rows, step, chance):
    found = tuning.Amounts(*split(rows, 4), "y", NUMBERS, LABELS).two_parts("paid", step, trees=1).select("p_step", "amount").collect()
    assert {r["p_step"] for r in found} == {chance}
    assert ({r["amount"] for r in found} == {0.0}) == (chance == 0.0)


def test_error_summary(spark):
    df = spark.createDataFrame([("t", 10.0, 8.0), ("t", 0.0, 1.0), ("t", 4.0, 4.0)], "block string, y double, m double")
    (r,) = tuning.error_summary(df, ["block"], "y", ["m"], 5.0).collect()
    assert (r["n"], r["mae"], r["bias"], r["mae_stepped"], r["mae_unstepped"]) == (3, pytest.approx(1.0), pytest.approx(1 / 3), 2.0, 0.5)
    assert r["share_stepped"] == pytest.approx(1 / 3) and r["rmse"] == pytest.approx((5 / 3) ** 0.5)


def test_a_stopped_run_goes_on_without_repeating_fits(spark, rows, tmp_path):
    fits = []

    def by_column(column, fail_at=None):
        def fit(train, test, seed):
            fits.append((column, seed))
            if len(fits) == fail_at:
                raise RuntimeError("lost")
            return test.withColumn("p", F.col(column) + F.lit(0.0) * seed)

        return fit

    run = experiments.Run(spark, str(tmp_path / "run"), ["k", "q", "a", "g"], "y")
    with pytest.raises(RuntimeError):
        run.fill({"a": by_column("a", 6), "b": by_column("b", 6)}, [3, 4], [1, 2], lambda c: split(rows, c))
    assert len(fits) == 6 and run.fill({"a": by_column("a"), "b": by_column("b")}, [3, 4], [1, 2], lambda c: split(rows, c)) == 3
    assert run.fill({"a": by_column("a"), "b": by_column("b")}, [3, 4], [1, 2], lambda c: split(rows, c)) == 0
    metrics = run.metrics().collect()
    assert len(metrics) == 8 and all(r["ap"] > 0.8 for r in metrics if r["variant"] == "a")
    assert run.metrics(("g",)).count() == 16
    told = {r["block"]: r for r in run.compared("b", "k", {"early": [3], "both": [3, 4]}, 30).collect()}
    assert {r["variant"] for r in told.values()} == {"a"} and all(r["robust"] and r["lo"] > 0 and r["gain"] > 0.2 for r in told.values())
    assert all(r["margin"] == 0.0 for r in told.values())
