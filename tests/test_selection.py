from __future__ import annotations

from datetime import date

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from helpers import panel
from weekloom.functions.metrics import all_metrics
from weekloom.functions.text import format_magnitude
from weekloom.operators import reports as rp
from weekloom.operators import selection as sl
from weekloom.params import EnsembleParams


def _metrics(spark, pairs):
    df = spark.createDataFrame([(float(a), float(b)) for a, b in pairs], "y double, p double")
    return df.agg(*all_metrics(F.col("y"), F.col("p"))).first()


def test_known_metrics(spark):
    m = _metrics(spark, [(0, 1), (2, 3), (0, 0)])
    np.testing.assert_allclose([m.rmse, m.mae, m.mape, m.smape], [0.816497, 0.666667, 50, 120], rtol=1e-5)
    assert _metrics(spark, [(0, 1), (0, 2)]).mape is None
    assert _metrics(spark, [(0, 0)]).smape is None


def test_metric_bounds(spark):
    rng = np.random.default_rng(0)
    actual = rng.uniform(1e7, 1e9, 8)
    m = _metrics(spark, zip(actual, actual * rng.uniform(0.9, 1.1, 8)))
    assert min(m) >= 0 and m.rmse >= m.mae


SCORES = "series_id string, model string, fold int, rmse double, mae double, mape double, smape double"


def scores(spark, table):
    rows = [(s, m, f, r, r, r, r) for (s, m), values in table.items() for f, r in enumerate(values)]
    return spark.createDataFrame(rows, SCORES)


def test_failed_model_ranks_last_and_ties_keep_order(spark):
    table = {
        ("a", "arima"): [1.0, None],
        ("a", "additive"): [3.0, 3.0],
        ("a", "boosted"): [2.0, 4.0],
        ("a", "recurrent"): [9.0, 9.0],
        ("b", "arima"): [None],
        ("b", "additive"): [None],
    }
    weights = sl.weigh_models(scores(spark, table))
    got = {r.model: r for r in weights.where("series_id = 'a'").collect()}
    assert [got[m].rank for m in ("additive", "boosted", "recurrent", "arima")] == [1, 2, 3, 4]
    assert got["additive"].weight == got["boosted"].weight == 0.5
    assert got["arima"].weight is None and got["arima"].mean_rmse is None
    assert [r.series_id for r in sl.unusable_series(weights).collect()] == ["b"]


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.floats(0, 1e9), min_size=4, max_size=4), st.sampled_from(["inverse_rmse", "uniform"]))
def test_weights_sum_to_one(spark, values, weighting):
    models = ("arima", "additive", "boosted", "recurrent")
    table = {("a", m): [v] for m, v in zip(models, values)}
    rows = sl.weigh_models(scores(spark, table), EnsembleParams(weighting=weighting)).where("selected").collect()
    assert len(rows) == 2 and abs(sum(r.weight for r in rows) - 1) < 1e-9


def test_missing_forecast_shows_as_null(spark):
    folds = panel(spark, {"a": range(4)}).select(
        "series_id", F.lit(0).alias("fold"), F.when(F.col("t") < 2, "train").otherwise("test").alias("role"), "week_end", "t", "y"
    )
    found = spark.createDataFrame([("a", 0, 1, "m1", 2.0), ("a", 0, 2, "m1", 3.5)], "series_id string, fold int, h int, model string, yhat double")
    done = sl.complete_predictions(folds, found, ("m1", "m2"))
    assert {(r.model, r.h, r.y_true, r.yhat) for r in done.collect()} == {
        ("m1", 1, 2.0, 2.0), ("m1", 2, 3.0, 3.5), ("m2", 1, 2.0, None), ("m2", 2, 3.0, None)
    }
    by_model = {r.model: r.rmse for r in sl.score_forecast(done).collect()}
    assert by_model["m2"] is None and by_model["m1"] == pytest.approx(0.5 / 2**0.5)
    assert [r.model for r in sl.failed_folds(done).collect()] == ["m2"]


def test_unknown_series(spark):
    p = panel(spark, {"a": range(3)})
    assert sl.train_subset(p, ["a"]).count() == 3
    with pytest.raises(ValueError, match="unknown series.*zz"):
        sl.train_subset(p, ["a", "zz"])


def _forecast(spark, models):
    rows = [("a", m, h, date(2024, 1, 7), 10.0 * (i + 1)) for i, m in enumerate(models) for h in (1, 2, 4, 8)]
    return spark.createDataFrame(rows, "series_id string, model string, h int, ds date, yhat double")


def test_bands_widen_and_weights_scale_back(spark):
    weights = spark.createDataFrame(
        [("a", "arima", 2.0, 1, True, 0.75), ("a", "additive", 6.0, 2, True, 0.25), ("a", "boosted", 9.0, 3, False, None)],
        "series_id string, model string, mean_rmse double, rank int, selected boolean, weight double",
    )
    both = rp.ensemble_forecast(_forecast(spark, ["arima", "additive", "boosted"]), weights)
    bands = {r.h: r for r in rp.forecast_bands(both).collect()}
    assert bands[1].yhat == 12.5 and bands[4].yhat_upper == pytest.approx(12.5 + 1.96 * 3 * 2, abs=0.01)
    kpis = rp.forecast_kpis(rp.forecast_bands(both)).first()
    assert kpis.week8_width == pytest.approx(2 * 1.96 * 3 * 8**0.5, abs=0.02)
    alone = rp.ensemble_forecast(_forecast(spark, ["arima"]), weights).where("h = 1").first()
    assert (alone.yhat, alone.sigma) == (10.0, 2.0)
    with pytest.raises(ValueError, match="horizon"):
        rp.ensemble_forecast(both, weights, horizon=9)


@pytest.mark.parametrize(
    ("value", "digits", "label"),
    [
        (1.234e9, 0, "1.23B"), (4.56e6, 0, "4.6M"), (6400.0, 0, "6K"), (2500.0, 0, "3K"), (12.0, 0, "12"),
        (12.25, 1, "12.3"), (0.5, 0, "1"), (-7.4, 0, "-7"), (None, 0, "—"), (float("nan"), 0, "—"), (999.6, 0, "1000"),
    ],
)
def test_magnitudes(spark, value, digits, label):
    df = spark.createDataFrame([(value,)], "v double")
    assert df.select(format_magnitude(F.col("v"), digits)).first()[0] == label
