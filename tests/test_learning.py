"""Cutoffs from coverage, pooled calibration and the hazard's horizon."""

import os

import pytest

from panelwright.operators import models as M
from panelwright.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
driver = pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")


def test_windows_follow_coverage_and_rows():
    coverage = {q: 1.0 for q in range(1, 21)} | {9: 0.5}
    rows = {q: 200 for q in range(1, 20)} | {18: 99}
    # 20 has no rows, 18 too few, 9 and 8 are not reliable or have no reliable target; the run before 9 is not used.
    assert M.windows(coverage, rows, 1) == ([12, 13, 14, 15, 16, 17], [19])
    assert M.windows(coverage, rows, 1, n_val=20) == (list(range(10, 18)), [19])
    assert M.windows(coverage, rows, 1, least=300) == ([], [])


@driver
def test_rolling_origin_has_six_validation_cutoffs_and_a_test(spark, monkeypatch):
    monkeypatch.setattr(M, "boosted", lambda train, test, y, numeric, categorical: M.naive(train, test, y, categorical[0]))
    monkeypatch.setattr(M, "logistic", M.boosted)
    rows = registry.QUERIES["ml_rolling_origin"](spark, SF).select("model", "cutoff").collect()
    cutoffs = sorted({r["cutoff"] for r in rows})
    assert len(cutoffs) == 7 and len(rows) == 3 * 7


@driver
def test_calibration_pools_folds(spark, monkeypatch):
    seen = []
    platt = M.platt_calibrated
    monkeypatch.setattr(M, "platt_calibrated", lambda df, pool, p, y: seen.append((df, pool)) or platt(df, pool, p, y))
    assert {r["version"] for r in registry.QUERIES["ml_calibrated"](spark, SF).collect()} == {"raw", "platt", "isotonic"}
    (now,) = {r["q"] for r in seen[0][0].select("q").collect()}
    pool = seen[0][1].select("q", "target_q").collect()
    assert {r["q"] for r in pool} == set(range(now - registry.learning.POOL_FOLDS, now)) and max(r["target_q"] for r in pool) <= now


@driver
def test_hazard_looks_six_quarters_ahead(spark):
    rows = registry.QUERIES["ml_hazard"](spark, SF).collect()
    assert {r["step"] for r in rows} == set(range(1, 7))
