"""Bootstrap bands against a plain count of paths, and changes of slope that are exactly zero."""

from __future__ import annotations

from datetime import date

import numpy as np
import pytest

from helpers import forecasts, history
from weekloom.forecasters import gram
from weekloom.forecasters.additive import fc_additive, fit_additive
from weekloom.operators import reports as rp
from weekloom.params import AdditiveParams, ForecastParams


def _tables(spark, residuals: dict[str, list[float]], weights: dict[str, float]):
    ds = date(2024, 1, 7)
    found = [("s", m, h, ds, 100.0 * (k + 1)) for k, m in enumerate(weights) for h in (1, 2)]
    found += [("s", "lost", 1, ds, None)]
    chosen = [("s", m, 1.0, True, w) for m, w in weights.items()] + [("s", "lost", 1.0, True, 0.5), ("s", "other", 1.0, False, None)]
    errors = [("s", m, float(e), 0.0) for m, es in residuals.items() for e in es] + [("s", "other", 1e9, 0.0), ("s", next(iter(weights)), None, 0.0)]
    return (
        spark.createDataFrame(found, "series_id string, model string, h int, ds date, yhat double"),
        spark.createDataFrame(chosen, "series_id string, model string, mean_rmse double, selected boolean, weight double"),
        spark.createDataFrame(errors, "series_id string, model string, y_true double, yhat double"),
    )


def test_one_residual_is_a_closed_form(spark):
    tables = _tables(spark, {"a": [5.0], "b": [-20.0]}, {"a": 0.25, "b": 0.75})
    for r in rp.bootstrap_bands(*tables, paths=50).collect():
        assert r.yhat == 175.0 and r.yhat_lower == r.yhat_upper == 0.25 * 105 + 0.75 * 180


def test_bands_hold_their_share_of_the_mixture(spark):
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=40) * 10, rng.normal(size=40) * 30 + 5
    tables = _tables(spark, {"a": a.tolist(), "b": b.tolist()}, {"a": 0.5, "b": 0.5})
    sums = 150 + 0.5 * np.add.outer(a, b).ravel()
    want = np.percentile(sums, [5, 95])
    rows = rp.bootstrap_bands(*tables, share=0.9, paths=20_000, seed=1).collect()
    assert {r.h for r in rows} == {1, 2} and all(r.yhat == 150.0 for r in rows)
    for r in rows:
        np.testing.assert_allclose([r.yhat_lower, r.yhat_upper], want, atol=0.8)
    # The same draws whatever the partitioning, others for another seed.
    again = rp.bootstrap_bands(*(t.repartition(3) for t in tables), share=0.9, paths=20_000, seed=1).collect()
    assert sorted(again) == sorted(rows)
    assert sorted(rp.bootstrap_bands(*tables, share=0.9, paths=20_000, seed=2).collect()) != sorted(rows)


def test_the_settings_choose_the_band(spark):
    tables = _tables(spark, {"a": [5.0, -5.0], "b": [1.0]}, {"a": 0.25, "b": 0.75})
    normal = {r.h: r for r in rp.banded_forecast(*tables, ForecastParams()).collect()}
    drawn = {r.h: r for r in rp.banded_forecast(*tables, ForecastParams(band="bootstrap", band_share=0.8)).collect()}
    assert normal[1].yhat_upper > normal[1].yhat > normal[1].yhat_lower
    assert (drawn[2].yhat_lower, drawn[2].yhat_upper) == (174.5, 177.0)
    with pytest.raises(ValueError):
        ForecastParams(band="guess")


def _objective(g, c, beta, ridge, l1):
    return 0.5 * beta @ g @ beta - c @ beta + 0.5 * ridge @ beta**2 + l1 @ np.abs(beta)


def test_lasso_is_a_minimum():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(5, 60, 8))
    x[:, :, 5] = x[:, :, 4] + 0.05 * rng.normal(size=(5, 60))
    y = x[:, :, 3] * 2 - x[:, :, 0] + 0.3 * rng.normal(size=(5, 60))
    g, c = np.einsum("bni,bnj->bij", x, x), np.einsum("bni,bn->bi", x, y)
    ridge = np.array([0.0, 1.0, 0, 0, 0, 0, 0, 0])
    l1 = np.array([0.0, 0, 0, 5, 5, 5, 5, 5])
    beta = gram.lasso(g, c, ridge, l1)
    assert (beta[:, 4:] == 0).any() and (np.abs(beta[:, 3]) > 1).all()
    for k in range(5):
        own = _objective(g[k], c[k], beta[k], ridge, l1)
        for _ in range(300):
            assert own <= _objective(g[k], c[k], beta[k] + rng.normal(size=8) * rng.choice([1e-4, 1e-2, 1]), ridge, l1) + 1e-9
    np.testing.assert_allclose(gram.lasso(g, c, ridge, l1 * 0 + 1e-12), np.linalg.solve(g + np.diag(ridge), c[:, :, None])[:, :, 0], atol=1e-6)


BARE = {"yearly_seasonality": False, "holidays": False, "trend_penalty": 0.0}


def test_one_planted_kink_gives_one_change_of_slope(spark):
    n = 251
    t = np.arange(n) / (n - 1)
    kink = 0.8 * 10 / 25
    y = 100 + 40 * t + 300 * np.maximum(0, t - kink)
    p = AdditiveParams(changepoints=25, changepoint_l1=1e-4, **BARE)
    beta = np.array(fit_additive(history(spark, {"a": y}), p).first().beta)
    changes = beta[2:]
    assert changes.argmax() == 9 and (np.abs(np.delete(changes, 9)) < 1e-2 * changes[9]).all()
    assert (changes == 0).sum() >= 23
    got = forecasts(fc_additive(history(spark, {"a": y, "empty": [None] * n}), 8, p))
    ahead = np.arange(n, n + 8) / (n - 1)
    np.testing.assert_allclose(got["a"], 100 + 40 * ahead + 300 * (ahead - kink), rtol=1e-2)
    assert all(v is None for v in got["empty"])
