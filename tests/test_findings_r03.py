"""What the third round's findings are about, on small rows."""

import datetime
import math
import os
import random
import threading
import time
import types

import pytest
from pyspark.sql import functions as F

from panelwright.functions import rules
from panelwright.functions import text as X
from panelwright.operators import entity, identity, models, quantiles, retrieval, tagging, tuning
from panelwright.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def of(spark, rule, *texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", rule(F.col("t")).alias("r")).orderBy("i").collect()
    return [r["r"] for r in rows]


def test_sentences_keep_digits_at_their_ends_and_lose_space_separators(spark):
    text = "\n".join(["20 men came in 02 ", " 1 of 31　", "4 and\v 4"])
    assert of(spark, X.sentences, text) == [["20 men came in 02", "1 of 31", "4 and\v 4"]]


def test_tagged_sentences_keep_digits_at_their_ends(spark):
    text = "A first one. 126.40.69.100!!  2 of 21 "
    assert of(spark, tagging.split_sentences, text) == [["A first one.", "126.40.69.100!!", "2 of 21"]]


def test_free_text_of_long_lines_takes_linear_time(spark):
    long = "word " * 60_000
    at = time.time()
    got = of(spark, lambda t: rules.free_text(t, (r"[^\n]*license[^\n]*",)), long, long + "License\nthis is left here", "a license\nb license license\none two three\n\nx license")
    assert got == [long.strip(), "this is left here", "one two three"] and time.time() - at < 20


def test_chunks_meet_proposals_by_their_set(spark):
    plan = registry.QUERIES["rag_mentions"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [id" not in plan and "collect_set" in plan


def test_checklist_means_do_not_depend_on_the_order_of_rows(spark, tmp_path):
    at = datetime.datetime(1996, 1, 1)
    spark.createDataFrame([(k, "c", 1, 5.0, "BUILDING") for k in range(40)], "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(k, k, "O", 10.0, at, "1-URGENT") for k in range(40)], "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    drawn = [0.07, 0.09, 0.0, 0.03, 0.1, 0.02, 0.08, 0.09]
    lines = [(k, d, "R", at) for k in range(40) for d in random.Random(k).sample(drawn, 8)]
    spark.createDataFrame([(k, 1, d, r, t) for k, d, r, t in lines], "l_orderkey long, l_suppkey long, l_discount double, l_returnflag string, l_shipdate timestamp").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    rows = registry.QUERIES["serve_checklist_full"](spark, str(tmp_path)).where("dimension = 'discounts'").select("state", "figure").distinct().collect()
    assert [tuple(r) for r in rows] == [("clear", 0.06)]




def test_nearest_meets_few_rows_and_equals_meeting_all(spark):
    rng = random.Random(3)
    rows = [(i, rng.randrange(400), "xyz"[i % 3], rng.choice([None, rng.random(), float(rng.randrange(3))]), rng.choice([None, 1.0, 2.0, 5.0])) for i in range(3000)]
    df = spark.createDataFrame(rows, "k long, e long, g string, a double, b double")
    got = {(r["query"], r["rank"]): (r["e"], r["k"]) for r in retrieval.nearest(df, "k", "g", "e", ["a", "b"], df.where("k % 100 = 0"), 5).collect()}
    want = {}
    for q, qe, g, *qv in rows[::100]:
        best = {}
        for k, e, h, *v in rows:
            parts = [(x - y) ** 2 for x, y in zip(v, qv) if x is not None and y is not None]
            if h == g and e != qe and parts:
                best[e] = min(best.get(e, (9e9, 0)), (math.sqrt(sum(parts) / len(parts)), k))
        want |= {(q, n + 1): (e, k) for n, ((_, k), e) in enumerate(sorted((b, e) for e, b in best.items())[:5])}
    assert got == want
    asked = df.where("k % 100 = 0 AND a IS NOT NULL AND b IS NOT NULL").select(F.col("k").alias("query"), F.col("e").alias("q_entity"), "g", F.col("a").alias("q_a"), F.col("b").alias("q_b"))
    met = retrieval._asked_alike(df.where("coalesce(a, b) IS NOT NULL"), "k", "g", "e", ["a", "b"], asked, 5).count()
    assert met < 0.3 * 1000 * asked.count()


def test_roads_are_rolled_up_without_copies_of_rows(spark):
    plan = registry.QUERIES["join_road_rollup"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Expand" not in plan


def test_first_links_hold_at_once_where_the_other_end_has_their_marks(spark, monkeypatch):
    """Every hub is first for its leaves, which all have its mark: after the hub's own first link no leaf waits for another."""
    rounds = []
    components = identity.components
    monkeypatch.setattr(identity, "components", lambda edges: rounds.append(1) or components(edges))
    links = [(f"hub{h}", f"leaf{(i + 8 * h) % 40:02}", 100 * i + h) for h in range(2) for i in range(40)]
    marks = [(f"leaf{i:02}", "side", "xy"[i % 2]) for i in range(40)] + [("hub0", "side", "x"), ("hub1", "side", "y")]
    roots, told = identity.constrained_components(spark.createDataFrame(links, "u string, v string, rank int"), spark.createDataFrame(marks, "node string, mark string, value string"), ["rank"], 0)
    root = {r["node"]: r["root"] for r in roots.collect()}
    assert all(root[f"leaf{i:02}"] == root[f"hub{i % 2}"] for i in range(40)) and root["hub0"] != root["hub1"]
    assert told.where("refused = 'side'").count() == 40 and len(rounds) <= 3


def test_rows_of_a_code_meet_only_where_their_shapes_can_reach_the_floor(spark, monkeypatch):
    met, of = [], entity.equal_codes
    monkeypatch.setattr(entity, "equal_codes", lambda *a, **b: met.append(of(*a, **b)) or met[-1])
    hosts = ["red", "blue", "north", "lake", "mill", "oak", "pine", "elm", "ash", "fir"]
    rows = [(i, f"{hosts[i % 10]} {hosts[i // 10 % 10]} house {i}", "A", 10.0 + i % 7) for i in range(800)]
    out = entity.resolve(spark.createDataFrame(rows, "id long, name string, code string, cost double"), "id", "name", "code", "cost").collect()
    assert len(out) == 800 and met[-1].count() < 0.1 * 800 * 799 / 2


def test_blocks_of_frequent_tokens_are_no_pairs_of_all_rows(spark):
    """A host has 100 rows, one in sixty: of those only the first ids are proposed."""
    rows = [(i, f"host{i % 60} n{i // 2}") for i in range(6000)]
    df = entity.candidates(spark.createDataFrame(rows, "id long, name string"), "id", "name", 60, 2)
    got = {(r["id"], r["place"]): (r["other"], r["shared"]) for r in df.collect()}
    assert got[2399, 1] == (2398, 1) and got[2399, 2] == (59, 1) and got[59, 2] == (119, 1) and len(got) == 12000
    assert "windowspecdefinition(key" in df._jdf.queryExecution().optimizedPlan().toString()


def test_repeated_links_are_removed_in_tasks_of_bounded_size(spark, monkeypatch):
    plans, of = [], entity.stored
    monkeypatch.setattr(entity, "stored", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or of(df))
    monkeypatch.setattr(entity, "DISTINCT_ROWS", 10, raising=False)
    links = [(i % 20 + 1, i % 20) for i in range(100)] + [(50, 50)]
    got = {r["node"]: r["root"] for r in entity.components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {n: 0 for n in range(21)} | {50: 50}
    assert "RepartitionByExpression [u" in plans[1] and "], 11" in plans[1]


def test_only_linked_nodes_go_through_unions_of_clean_keys(spark, monkeypatch):
    taken, of = [], identity.constrained_components
    monkeypatch.setattr(identity, "constrained_components", lambda links, *a: taken.append(links) or of(links, *a))
    keys = registry.QUERIES["er_clean_keys"](spark, SF)
    assert keys.count() == spark.read.parquet(f"{SF}/orders.parquet").count()
    assert len(taken) == 2 and all(links.where("u = v").count() == 0 for links in taken)


def test_costs_corroborate_without_copies_of_pairs(spark):
    rng = random.Random(5)
    costs = [0.0, -3.0, -2.995, 0.01, 0.02, 1.09, 1.1, 1.111, 2.2, 2.21, 2.23, 100.0, 101.0, 101.02, 99.0, 5e7, 5.05e7]
    rows = [(f"{s}:{i}", f"w{s}{i} " + rng.choice(["x", "y"]) + " p q r s t", rng.choice([None, *costs])) for s in "AB" for i in range(12) for _ in range(2)]
    pairs = [(f"A:{i}", f"B:{j}") for i in range(12) for j in range(12)]
    out = identity.corroborated(spark.createDataFrame(pairs, "a string, b string"), spark.createDataFrame(rows, "code string, name string, cost double"), alike=2.0)
    by = {}
    for code, name, cost in rows:
        by.setdefault(code, []).append(cost)
    gaps = lambda a, b: [(abs(x - y), y) for x in by[a] for y in by[b] if x is not None and y is not None]
    want = {(a, b): "cost" if any(g <= 0.011 for g, _ in gaps(a, b)) else "near cost and name" if any(g <= 0.01 * y for g, y in gaps(a, b)) else None for a, b in pairs}
    assert {(r["a"], r["b"]): r["detail"] for r in out.collect()} == want and len(set(want.values())) == 3
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert all("cost_a" not in line.split("sequence")[1].split("[")[0] for line in plan.split("\n") if "Generate explode(sequence" in line)


def test_names_that_a_list_has_twice_are_met_as_lists(spark):
    """A name that a list has 2,000 times meets the 2,000 rows without a code elsewhere as one list, not row by row."""
    rows = [(i, "A:1", "s", 1, "big", "n", "n", "c", "x", 1.0) for i in range(2000)] + [(5000 + i, None, "s", 1, f"l{i}", "n", "n", "c", "x", 1.0) for i in range(20)] + [(9000, None, "s", 9, "l", "m", "m", "c", "x", 1.0), (9001, "A:2", "s", 9, "k", "m", "m", "c", "", 1.0), (9002, None, "s", None, "k", "m", "m", "c", "", 1.0)]
    df = identity.name_pairs(spark.createDataFrame(rows, "row long, code string, stream string, period int, list string, name string, name_words string, sector string, agency string, cost double"))
    assert [tuple(r) for r in df.collect()] == [(9000, 9001, "A:2")]
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter NOT twice" in plan or "NOT twice" in plan.split("LeftAnti")[-1]


def meeting(of):
    """of, each call of which waits until another one runs beside it."""
    barrier = threading.Barrier(2)

    def met(*args, **more):
        barrier.wait(30)
        return of(*args, **more)

    return met


def test_folds_are_fitted_together(spark, monkeypatch):
    fit = meeting(lambda train, test, y, numeric, categorical: models.naive(train, test, y, categorical[0]))
    monkeypatch.setattr(models, "logistic", fit)
    monkeypatch.setattr(models, "boosted", fit)
    rows = registry.QUERIES["ml_rolling_origin"](spark, SF).collect()
    ap = {(r["model"], r["cutoff"]): r["ap"] for r in rows}
    assert len(ap) == len(rows) == 21 and all(ap["boosted", c] == pytest.approx(v) for (m, c), v in ap.items())


def test_a_search_fits_no_model_twice(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(tuning, "stopped_trees", lambda train, params, most, *a: calls.append(("stop", params, most)) or (2 if params.depth == 3 else most))
    monkeypatch.setattr(tuning, "fit", lambda fold, params, count, seed: calls.append(("fit", params, count)) or (params, count))
    monkeypatch.setattr(tuning, "scored", lambda fold, model: model)
    fold = types.SimpleNamespace(train=spark.range(1))
    found = tuning.search([fold], lambda model: float(model[0].depth), [(1, 4), (1, 8)], 5, 3, "q", "target_q")
    assert len(calls) == len(set(calls)) and ("stop", tuning.Params(), 8) not in calls
    assert [(r["trial"], r["trees"]) for r in found if r["rung"] == 1] == [(0, 2.0), (3, 8.0)]


def test_intervals_are_fitted_together(spark, monkeypatch):
    cutoffs, fit = [7999, 8000], quantiles.fit
    monkeypatch.setattr(registry.learning, "_windows", lambda *a: (cutoffs[:1], cutoffs[1:]))
    monkeypatch.setattr(quantiles, "fit", meeting(lambda *a: fit(*a, rounds=2)))
    rows = registry.QUERIES["ml_intervals"](spark, SF).collect()
    assert sorted((r["method"], r["cutoff"]) for r in rows) == [(m, c) for m in ("regressors", "segments") for c in cutoffs]
