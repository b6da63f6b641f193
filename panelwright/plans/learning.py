"""Models on the panel: rolling-origin scores, calibration, intervals and hazards. Rows only: no SQL trains a model."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.operators import aggregates as A
from panelwright.operators import attribution, experiments, quantiles, resampling, scores, tuning, windows
from panelwright.operators import models as M
from panelwright.plans.panel import labels, panel, survival_rows
from panelwright.plans.registry import query
from panelwright.sources.scratch import stored
from panelwright.sources.session import ship
from panelwright.sources.tables import read
from panelwright.sources.together import AT_ONCE, together
from panelwright.streaming.flows import flow_folder

NUMERIC = ["x", "n", "change", "age"]


def rows(spark, sf_dir):
    """Panel features with next quarter's outcome; written once, since every fold reads them."""
    w = windows.ordered(["k"], "q")
    features = panel(spark, sf_dir).withColumn("change", F.col("x") - F.lag("x").over(w)).withColumn("age", (F.col("q") - F.first("q").over(w)).cast("double")).withColumn("n", F.col("n").cast("double"))
    known = labels(panel(spark, sf_dir), 1).where("y_rise IS NOT NULL").select("k", "q", "target_q", "y_rise")
    segment = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("segment"))
    return stored(features.join(known, ["k", "q"]).join(segment, "k").select("k", "q", "target_q", "segment", *NUMERIC, "y_rise"))


def amounts(spark, sf_dir):
    """rows() with the change of the value by the next quarter, in percent, within -100 and 300."""
    later = panel(spark, sf_dir).select("k", (F.col("q") - 1).alias("q"), F.col("x").alias("next_x"))
    share = F.greatest(F.least(100 * (F.col("next_x") / F.col("x") - 1), F.lit(300.0)), F.lit(-100.0))
    return stored(rows(spark, sf_dir).join(later, ["k", "q"]).where("x > 0").withColumn("y_change", share).drop("next_x"))


#: Labelled rows of a usable cutoff, earlier folds that a calibration is fitted on, quarters a hazard looks ahead.
MIN_ROWS, POOL_FOLDS, AHEAD = 100, 4, 6


def _windows(spark, sf_dir, df):
    """Validation and test cutoffs; small tables need half of their usual rows a quarter."""
    share = F.avg(F.col("x").isNotNull().cast("double"))
    coverage = {r["q"]: r["share"] for r in panel(spark, sf_dir).groupBy("q").agg(share.alias("share")).collect()}
    counts = {r["q"]: r["count"] for r in df.groupBy("q").count().collect()}
    return M.windows(coverage, counts, 1, least=min(MIN_ROWS, sum(counts.values()) // max(1, 2 * len(counts))))


@query("ml_rolling_origin")
def ml_rolling_origin(spark, sf_dir):
    """Average precision by model and cutoff, each trained on what was known then: the validation and the test cutoffs."""
    df = rows(spark, sf_dir)
    fits = {
        "naive": lambda train, test: M.naive(train, test, "y_rise", "segment"),
        "logistic": lambda train, test: M.logistic(train, test, "y_rise", NUMERIC, ["segment"]),
        "boosted": lambda train, test: M.boosted(train, test, "y_rise", NUMERIC, ["segment"]),
    }
    asked = [(name, cutoff) for cutoff in sum(_windows(spark, sf_dir, df), []) for name in fits]

    def scored(one):
        name, cutoff = one
        return fits[name](*M.fold(df, cutoff, "q", "target_q")).select(F.lit(name).alias("model"), F.lit(cutoff).alias("cutoff"), "p", "y_rise")

    out = reduce(DataFrame.unionByName, together(spark, scored, asked))
    return A.average_precision(out, ["model", "cutoff"], "p", "y_rise")


@query("ml_calibrated")
def ml_calibrated(spark, sf_dir):
    """Calibration error before and after Platt and isotonic calibration on the newest folds whose outcomes are known, each
    scored by the model of its own cutoff."""
    df = rows(spark, sf_dir)
    now = _windows(spark, sf_dir, df)[1][0]
    scored = lambda cutoff: M.logistic(*M.fold(df, cutoff, "q", "target_q"), "y_rise", NUMERIC, ["segment"])
    test, pool = scored(now), reduce(DataFrame.unionByName, [scored(now - i) for i in range(1, POOL_FOLDS + 1)])
    versions = {"raw": test.withColumn("p_cal", F.col("p")), "platt": M.platt_calibrated(test, pool, "p", "y_rise"), "isotonic": M.isotonic_calibrated(test, pool, "p", "y_rise")}
    parts = [A.expected_calibration_error(A.calibration_bins(v, "p_cal", "y_rise")).select(F.lit(n).alias("version"), "ece") for n, v in versions.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("ml_intervals")
def ml_intervals(spark, sf_dir):
    """Coverage and pinball loss of 90% intervals of the change, by quantile regressors of each cutoff, before and after they are widened by what
    the cutoff before missed, beside the quantiles of segments."""
    df, out = amounts(spark, sf_dir), None
    cutoffs = sum(_windows(spark, sf_dir, df), [])
    models = together(ship(spark), lambda cutoff: quantiles.fit(M.fold(df, cutoff, "q", "target_q")[0], "y_change", NUMERIC, ["segment"]), cutoffs)
    for cutoff, model in zip(cutoffs, models):
        train, test = M.fold(df, cutoff, "q", "target_q")
        pool = model.predict(df.where(F.col("q") == cutoff - 1))
        wide = model.predict(test).crossJoin(F.broadcast(M.conformal_margin(pool, "y_change", "q05", "q95")))
        plain = M.group_quantiles(train, test, "y_change", ["segment"]).withColumn("margin", F.lit(0.0))
        for name, found in (("regressors", wide), ("segments", plain)):
            inside = lambda m: F.avg(F.col("y_change").between(F.col("q05") - m, F.col("q95") + m).cast("double"))
            loss = lambda level: F.avg(A.pinball(F.col("y_change"), F.col(f"q{level:02d}"), level / 100)).alias(f"pinball_{level:02d}")
            part = found.agg(F.count("*").alias("n"), inside(F.lit(0.0)).alias("before"), inside(F.col("margin")).alias("after"), loss(5), loss(50), loss(95)).select(F.lit(name).alias("method"), F.lit(cutoff).alias("cutoff"), "*")
            out = part if out is None else out.unionByName(part)
    return out


@query("ml_hazard")
def ml_hazard(spark, sf_dir):
    """Chance of a finish within 1 to 6 quarters from a discrete hazard model on the risk set."""
    risk = survival_rows(spark, sf_dir, AHEAD).withColumn("step_d", F.col("step").cast("double"))
    value = panel(spark, sf_dir).select("k", "q", "x")
    train = risk.join(value, ["k", "q"]).persist()
    last = value.groupBy("k").agg(F.max_by("x", "q").alias("x"), F.max("q").alias("q"))
    ahead = last.select("k", "q", "x", F.explode(F.sequence(F.lit(1), F.lit(AHEAD))).alias("step")).withColumn("step_d", F.col("step").cast("double"))
    hazard = M.logistic(train, ahead, "y", ["x", "step_d"], [])
    return hazard.select("k", "step", windows.survival(F.col("p"), ["k"], "step").alias("p_by"))


@query("ml_paired_bootstrap")
def ml_paired_bootstrap(spark, sf_dir):
    """Interval of the gain in within-cutoff average precision of the logistic model over the rates of segments, customers resampled together."""
    df, out = rows(spark, sf_dir), None
    for cutoff in sum(_windows(spark, sf_dir, df), []):
        train, test = M.fold(df, cutoff, "q", "target_q")
        first = M.naive(train, test, "y_rise", "segment").select("k", "q", F.col("y_rise").cast("int").alias("y"), F.col("p").alias("first"))
        part = first.join(M.logistic(train, test, "y_rise", NUMERIC, ["segment"]).select("k", "q", F.col("p").alias("second")), ["k", "q"])
        out = part if out is None else out.unionByName(part)
    boot = resampling.paired_precision(stored(out), "k", "q", "y", "first", "second", 200, 11)
    return boot.agg(F.avg("ap_first").alias("ap_first"), F.avg("ap_second").alias("ap_second"), F.percentile("gain", 0.05).alias("lo"), F.percentile("gain", 0.95).alias("hi"))


@query("ml_scored")
def ml_scored(spark, sf_dir):
    """Current customers scored by boosted trees of all outcomes known, with a tier, quantiles of the change and the five features that add most.

    The shares are exact Shapley values of the trees' margin; base is the margin with no feature known. A row with a null where training
    had none is not scored.
    """
    df = rows(spark, sf_dir)
    now = panel(spark, sf_dir).agg(F.max("q")).first()[0]
    w = windows.ordered(["k"], "q")
    every = panel(spark, sf_dir).withColumn("change", F.col("x") - F.lag("x").over(w)).withColumn("age", (F.col("q") - F.first("q").over(w)).cast("double")).withColumn("n", F.col("n").cast("double"))
    segment = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("segment"))
    current = every.where(F.col("q") == now).join(segment, "k").select("k", "q", "segment", *NUMERIC)
    train = df.where(F.col("target_q") <= now)
    fold = tuning.Folded(train, current, "y_rise", NUMERIC, ["segment"])
    model = tuning.fit(fold, tuning.Params(), 10, 7)
    paths = attribution.tree_paths(model)
    scored = model.transform(fold.test).withColumn("p", vector_to_array("probability")[1]).withColumn("x_", vector_to_array("features"))
    told = attribution.attributed(scored, "x_", fold.names, lambda x: attribution.shares(x, paths))
    bands = quantiles.fit(amounts(spark, sf_dir).where(F.col("target_q") <= now), "y_change", NUMERIC, ["segment"])
    skip = scores.unscorable(told, train, NUMERIC)
    tier = F.when(F.col("p") >= 0.5, "high").when(F.col("p") >= 0.3, "medium").otherwise("low")
    kept = lambda c: F.when(~skip, c)
    out = bands.predict(told).withColumn("base", F.lit(attribution.mean_score(paths)))
    return out.select("k", "q", kept(F.col("p")).alias("p"), kept(tier).alias("tier"), *[kept(F.col(c)).alias(c) for c in ("q05", "q50", "q95")], "base", kept(F.aggregate("shares", F.lit(0.0), lambda s, v: s + v)).alias("shares_sum"), kept(F.to_json("top")).alias("top"))


#: Folds of the search by rung and the most trees there; trials, and models of a bag.
RUNGS, TRIALS, BAG = [(1, 4), (2, 8)], 5, 3


def _precision(scored):
    return A.average_precision(scored, [], "p", "y_rise").first()["ap"]


@query("ml_tuned")
def ml_tuned(spark, sf_dir):
    """The trials of a seeded search on the validation cutoffs, and on the test cutoff the default, the best trial and its bag."""
    df = rows(spark, sf_dir)
    validation, test = _windows(spark, sf_dir, df)
    folded = lambda cutoff: tuning.Folded(*M.fold(df, cutoff, "q", "target_q"), "y_rise", NUMERIC, ["segment"])
    width = max(w for w, _ in RUNGS)
    found = tuning.search(together(spark, folded, validation[-width:]), _precision, RUNGS, TRIALS, 3, "q", "target_q")
    best = next(r for r in found if r["best"])
    fold, trees = folded(test[0]), max(tuning.LEAST_TREES, round(best["trees"]))
    params = tuning.trials(TRIALS, 3)[best["trial"]]
    finals = {
        "default": lambda: tuning.scored(fold, tuning.fit(fold, tuning.Params(), trees, 3)),
        "best": lambda: tuning.scored(fold, tuning.fit(fold, params, trees, 3)),
        "bag": lambda: tuning.bagged(fold, params, trees, BAG, "k"),
    }
    scores_of = dict(zip(finals, together(spark, lambda name: _precision(finals[name]()), finals)))
    last = [{"trial": best["trial"], "rung": len(RUNGS), "params": name, "trees": float(trees), "score": score, "goes_on": False, "best": False} for name, score in scores_of.items()]
    columns = ["trial", "rung", "params", "trees", "score", "goes_on", "best"]
    return spark.createDataFrame([tuple(r[c] for c in columns) for r in [*found, *last]], "trial int, rung int, params string, trees double, score double, goes_on boolean, best boolean")


#: The change, in percent, that counts as a step.
STEP = 5.0


@query("ml_hurdle")
def ml_hurdle(spark, sf_dir):
    """Errors of four forecasts of the change on the validation and the test cutoffs: two parts, the median regressor, zero and the training mean."""
    df, out = amounts(spark, sf_dir), None
    validation, test = _windows(spark, sf_dir, df)
    for block, cutoffs in (("validation", validation), ("test", test)):
        for cutoff in cutoffs:
            train, now = M.fold(df, cutoff, "q", "target_q")
            two = tuning.Amounts(train, now, "y_rise", NUMERIC, ["segment"]).two_parts("y_change", STEP, trees=3)
            median = quantiles.fit(train, "y_change", NUMERIC, ["segment"], (0.5,), rounds=12).predict(now).select("k", "q", "q50")
            mean = train.agg(F.avg("y_change")).first()[0]
            part = two.join(median, ["k", "q"]).select(F.lit(block).alias("block"), "k", "q", "y_change", F.col("amount").alias("two_parts"), "q50", F.lit(0.0).alias("zero"), F.lit(mean).alias("train_mean"))
            out = part if out is None else out.unionByName(part)
    return tuning.error_summary(stored(out), ["block"], "y_change", ["two_parts", "q50", "zero", "train_mean"], STEP)


def run_variants():
    """The champion, the same without the last change, and boosted trees."""
    logistic = lambda columns: lambda train, test, seed: M.logistic(train, test, "y_rise", columns, ["segment"])
    return {
        "all": logistic(NUMERIC),
        "without_change": logistic([c for c in NUMERIC if c != "change"]),
        "boosted": lambda train, test, seed: M.boosted(train, test, "y_rise", NUMERIC, ["segment"], trees=5, seed=seed),
    }


@query("ml_runs")
def ml_runs(spark, sf_dir):
    """A run of the variants on all validation and test cutoffs, compared with the champion: gain, interval, noise margin and verdict."""
    df = rows(spark, sf_dir)
    validation, test = _windows(spark, sf_dir, df)
    run = experiments.Run(spark, flow_folder(spark), ["k", "q", "segment"], "y_rise")
    blocks = {"validation": validation, "test": test}
    run.fill(run_variants(), sum(blocks.values(), []), [1, 2], lambda cutoff: M.fold(df, cutoff, "q", "target_q"), AT_ONCE)
    return run.compared("all", "k", blocks)
