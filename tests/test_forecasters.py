from __future__ import annotations

import glob
from datetime import date, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import SUNDAY, forecasts, history, panel
from weekloom.forecasters import boosted as bo
from weekloom.forecasters.additive import fc_additive
from weekloom.forecasters.arima import fc_arima, fit_arima, stable_lags
from weekloom.forecasters import gram as gr
from weekloom.forecasters.gram import gram_by_group, gram_matrix, gram_sums
from weekloom.forecasters.recurrent import fc_recurrent
from weekloom.forecasters.registry import FORECASTERS
from weekloom.operators import folds as fd
from weekloom.operators.selection import score_forecast
from weekloom.params import (
    MODEL_ORDER,
    AdditiveParams,
    ArimaParams,
    BoostedParams,
    FeatureParams,
    FoldParams,
    ModelParams,
    Settings,
)
from weekloom.plans.training import cv_run, train_run
from weekloom.session import checkpoint_root
from weekloom.sources import runs as rn

N = 160


def yearly(n: int, noise: float = 0.0, level: float = 100.0, seed: int = 7) -> np.ndarray:
    t = np.arange(n)
    rng = np.random.default_rng(seed)
    return level + 20 * np.sin(2 * np.pi * t / 52.1775) + noise * rng.normal(size=n)


def truth_after(n: int) -> np.ndarray:
    return yearly(n + 8)[n:]


def test_gram_sums_agree_with_numpy(spark):
    x = np.random.default_rng(1).normal(size=(50, 3))
    df = spark.createDataFrame([(i % 2, [float(v) for v in row]) for i, row in enumerate(x)], "k int, z array<double>")
    for grams in (gram_matrix(df, ("k",), "z", 3), gram_by_group(df, ("k",), "z", 3)):
        for r in grams.collect():
            part = x[r.k :: 2]
            np.testing.assert_allclose(np.array(r.gram).reshape(3, 3), part.T @ part)
    assert gram_sums(df, ("k",), "z", 3).count() == 2 * 6


def _ill(spark):
    """Rows of a polynomial design with a condition of about 1e9, and the coefficients behind the target."""
    t = np.linspace(-1, 1, 400)
    x = np.column_stack([t**k for k in range(24)])
    beta = np.cos(np.arange(24.0))
    rows = [(i % 2, [*map(float, r), float(r @ beta)]) for i, r in enumerate(x)]
    return x, beta, spark.createDataFrame(rows, "k int, z array<double>").repartition(5)


def test_triangular_factors_solve_what_cross_products_cannot(spark):
    x, beta, df = _ill(spark)
    assert 1e8 < np.linalg.cond(x[::2]) < 1e10
    for factors in (gr.qr_matrix(df, ("k",), "z", 25), gr.qr_by_group(df, ("k",), "z", 25)):
        solved = factors.select("k", gr.triangular_solver(24, [0.0] * 24)("r").alias("b")).collect()
        assert len(solved) == 2
        for r in solved:
            np.testing.assert_allclose(r.b, beta, atol=1e-6)
    bad = gram_matrix(df, ("k",), "z", 25).select(gr.ridge_solver(24, [0.0] * 24)("gram").alias("b")).first().b
    assert bad is None or np.abs(np.array(bad) - beta).max() > 1e-3


def test_factors_of_many_tasks_meet_in_a_tree(spark, monkeypatch):
    monkeypatch.setattr(gr, "_FAN_IN", 2)
    rng = np.random.default_rng(3)
    values = rng.normal(size=(90, 4))
    df = spark.createDataFrame([(int(i % 3), list(map(float, v))) for i, v in enumerate(values)], "k int, z array<double>").repartition(11)
    ridge = np.array([0.0, 2.0, 0.5])
    for r in gr.qr_matrix(df, ("k",), "z", 4).collect():
        own = values[r.k :: 3]
        factor = np.array(r.r).reshape(4, 4)
        np.testing.assert_allclose(factor.T @ factor, own.T @ own, atol=1e-9)
        want = np.linalg.solve(own[:, :3].T @ own[:, :3] + np.diag(ridge), own[:, :3].T @ own[:, 3])
        np.testing.assert_allclose(gr.penalised(factor, 3, ridge)[:, 0], want, atol=1e-9)
    few = gr.qr_matrix(df.limit(2), ("k",), "z", 4).collect()
    assert all(len(r.r) == 16 for r in few)
    nan = spark.createDataFrame([(1, [1.0, float("nan")]), (2, [1.0, 2.0])], "k int, z array<double>")
    with pytest.raises(Exception, match="not finite"):
        gr.qr_matrix(nan, ("k",), "z", 2).collect()
    assert {r.k: r.r is None for r in gr.qr_by_group(nan, ("k",), "z", 2).collect()} == {1: True, 2: False}


def test_gram_refuses_values_that_are_not_finite(spark):
    """Such a row would silently take the sums of its whole task with it."""
    good = F.array(F.lit(1.0), F.lit(2.0))
    df = spark.range(0, 4000, 1, 4).select(F.lit(1).alias("k"), good.alias("z"))
    assert gram_matrix(df, ("k",), "z", 2).first().gram == [4000.0, 8000.0, 8000.0, 16000.0]
    bad = spark.range(0, 4000, 1, 4).select(
        F.lit(1).alias("k"), F.when(F.col("id") == 17, F.array(F.lit(1.0), F.lit(float("nan")))).otherwise(good).alias("z")
    )
    with pytest.raises(Exception, match="not finite"):
        gram_matrix(bad, ("k",), "z", 2).collect()
    assert gram_by_group(bad, ("k",), "z", 2).first().gram is None


@pytest.mark.parametrize("name", MODEL_ORDER)
def test_a_series_without_values_leaves_the_others_alone(spark, name):
    clean = {f"s{i}": yearly(N, 0.5, seed=i) for i in range(3)}
    settings = Settings(models=ModelParams(boosted=QUICK), features=FEW)
    want = forecasts(FORECASTERS[name](history(spark, clean), 8, settings))
    got = forecasts(FORECASTERS[name](history(spark, clean | {"empty": [None] * N}), 8, settings))
    assert all(v is None for v in got.pop("empty", []))
    assert set(got) == set(want) == set(clean)
    for s in clean:
        np.testing.assert_allclose(got[s], want[s], rtol=1e-6)


def test_gram_sums_of_many_groups_are_whole(spark):
    """More groups than a task holds at a time, each spread over the whole input."""
    df = spark.range(0, 6000, 1, 2).select((F.col("id") % 1500).alias("k"), F.array(F.lit(1.0), F.col("id").cast("double")).alias("z"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    try:
        got = {r.k: r.gram for r in gram_matrix(df, ("k",), "z", 2).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == 1500
    for k in (0, 7, 1499):
        ids = [k + 1500 * j for j in range(4)]
        np.testing.assert_allclose(got[k], [4, sum(ids), sum(ids), sum(i * i for i in ids)])


def test_additive_follows_a_line(spark):
    line = [50 + 2.0 * t for t in range(N)]
    p = AdditiveParams(yearly_seasonality=False, holidays=False)
    got = forecasts(fc_additive(history(spark, {"a": line}), 8, p))["a"]
    np.testing.assert_allclose(got, [50 + 2.0 * t for t in range(N, N + 8)], rtol=0.01)


def test_additive_follows_a_season(spark):
    got = forecasts(fc_additive(history(spark, {"a": yearly(N)}), 8))["a"]
    np.testing.assert_allclose(got, truth_after(N), rtol=0.05)


def test_additive_holiday_effect(spark):
    from weekloom.functions.calendar import holiday_flag

    weeks = [SUNDAY + timedelta(days=7 * i) for i in range(N + 8)]
    df = spark.createDataFrame([(w,) for w in weeks], "w date")
    flag = {r.w: r.f for r in df.select("w", holiday_flag(F.col("w")).alias("f")).collect()}
    y = [100.0 + 30.0 * flag[w] for w in weeks]
    got = forecasts(fc_additive(history(spark, {"a": y[:N]}), 8))["a"]
    np.testing.assert_allclose(got, y[N:], rtol=0.05)


def _ar1(phi: float, n: int, seed: int) -> np.ndarray:
    e, y = np.random.default_rng(seed).normal(size=n), np.zeros(n)
    for t in range(1, n):
        y[t] = phi * y[t - 1] + e[t]
    return y + 50


def test_arima_finds_ar1_processes(spark):
    """Over twenty draws: rarely differenced, and mostly close to the forecast of the true process."""
    series = {f"s{i}": _ar1(0.7, 400, i) for i in range(20)}
    rows = fit_arima(history(spark, series), 8).collect()
    assert sum(r.d == 0 for r in rows) >= 16
    gaps = []
    for r in rows:
        y = series[r.series_id]
        expected = 50 + (y[-1] - 50) * 0.7 ** np.arange(1, 9)
        gaps.append(abs(np.array(r.yhat) - expected).max())
    assert np.median(gaps) < 0.8


def test_arima_differences_a_random_walk(spark):
    walk = np.cumsum(np.random.default_rng(5).normal(size=300) + 0.5)
    row = fit_arima(history(spark, {"a": walk}), 8).first()
    assert row.d >= 1
    assert abs(row.yhat[0] - walk[-1]) < 4


def test_arima_short_and_constant_series(spark):
    rows = history(spark, {"short": list(range(12)), "flat": [5.0] * 120})
    got = {r.series_id: r.yhat for r in fit_arima(rows, 8).collect()}
    assert got["short"] is None
    np.testing.assert_allclose(got["flat"], [5.0] * 8, atol=1e-6)
    given = forecasts(fc_arima(rows, 8))
    assert given["short"] == [None] * 8 and None not in given["flat"]


def test_arima_uses_all_weeks_of_the_chosen_order(spark):
    p = ArimaParams(max_P=0, max_Q=0)
    short = fit_arima(history(spark, {"a": yearly(104, 3.0)}), 8, p).first()
    assert short.n_rows >= 90 and short.error is None
    fitted = fit_arima(history(spark, {"a": yearly(104, 3.0), "b": yearly(60, 3.0)}), 8).collect()
    assert {r.series_id: r.seasonal for r in fitted} == {"a": True, "b": False}


def test_arima_stability_is_that_of_the_whole_polynomial():
    assert stable_lags(np.array([0.7]), [1]) and stable_lags(np.array([0.7]), [52])
    assert not stable_lags(np.array([0.7, 0.7]), [1, 52])
    assert stable_lags(np.array([1.2, -0.5]), [1, 2]) and stable_lags(np.array([]), [])
    assert not stable_lags(np.array([1.2]), [1])


def test_arima_gives_the_reason_of_a_failure(spark):
    rows = fc_arima(history(spark, {"a": yearly(10)}), 8).collect()
    assert [r.h for r in rows] == list(range(1, 9)) and all(r.yhat is None and "too few" in r.error for r in rows)


def test_arima_non_seasonal_orders_only(spark):
    row = fit_arima(history(spark, {"a": yearly(N, 1.0)}), 8, ArimaParams(seasonal=False)).first()
    assert row.order.endswith("(0,0)") and len(row.yhat) == 8


def test_recurrent_beats_the_mean_on_a_season(spark):
    series = {f"s{i}": yearly(N, 0.5, 100 + i, seed=i) for i in range(4)}
    got = forecasts(fc_recurrent(history(spark, series), 8))
    for i in range(4):
        target = truth_after(N) + i
        error = np.sqrt(np.mean((np.array(got[f"s{i}"]) - target) ** 2))
        flat = np.sqrt(np.mean((series[f"s{i}"].mean() - target) ** 2))
        assert error < 0.5 * flat


def test_recurrent_leaves_out_short_series(spark):
    endless = yearly(N)
    endless[9] = np.inf
    rows = history(spark, {"short": yearly(75), "long": yearly(N), "endless": endless})
    assert forecasts(fc_recurrent(rows, 8)).keys() == {"long"}


FEW = FeatureParams(lags=(1, 2), rolling_windows=(4,), fourier_terms=1)
QUICK = BoostedParams(n_estimators=10, max_depth=4, per_horizon=False, min_child_weight=1, subsample=1.0, colsample=1.0)


def test_boosted_beats_the_mean_on_a_season(spark):
    series = {f"s{i}": yearly(N, 0.5, seed=i) for i in range(3)}
    got = forecasts(bo.fc_boosted_direct(history(spark, series), 8, QUICK, FEW))
    for s in series:
        error = np.sqrt(np.mean((np.array(got[s]) - truth_after(N)) ** 2))
        assert error < 0.6 * np.sqrt(np.mean((100 - truth_after(N)) ** 2))


def test_boosted_per_week_ahead(spark):
    p = BoostedParams(n_estimators=2, max_depth=2)
    got = forecasts(bo.fc_boosted_direct(history(spark, {"a": yearly(N)}), 2, p, FEW))
    assert len(got["a"]) == 2


def test_trials_are_seeded_and_in_range():
    first, again = bo.sample_trials(BoostedParams(n_trials=20)), bo.sample_trials(BoostedParams(n_trials=20))
    assert first == again and len({t.learning_rate for t in first}) == 20
    assert all(100 <= t.n_estimators <= 1000 and 3 <= t.max_depth <= 10 and 0.01 <= t.learning_rate <= 0.3 for t in first)


@pytest.mark.parametrize("on_test", [False, True])
def test_tuning_prefers_trees_that_learn(spark, on_test):
    folds = fd.walk_forward_folds(panel(spark, {f"s{i}": yearly(N, 0.5, seed=i) for i in range(3)}))
    trials = [
        BoostedParams(n_estimators=1, max_depth=1, learning_rate=0.01, per_horizon=False, subsample=0.1),
        QUICK,
    ]
    tuned = bo.tune_boosted(folds, 8, QUICK, FEW, trials, validate_on_test=on_test)
    rows = {r.trial: r for r in tuned.collect()}
    assert rows[1].is_best and not rows[0].is_best and rows[1].rmse < rows[0].rmse
    assert rows[0].subsample == 0.3
    assert bo.best_params(tuned, QUICK).max_depth == 4


def test_shapley_values_add_up(spark):
    rows = bo.direct_rows(history(spark, {"a": yearly(N, 2.0), "b": yearly(N, 2.0, seed=8)}), 1, FEW)
    model = bo.fit_first_week(rows, QUICK, FEW, 0)
    values = bo.explain_boosted(model, rows.targets, ("series_id", "t"), FEW, permutations=3)
    per_row = values.groupBy("series_id", "t").agg(
        F.sum("shapley").alias("total"), F.count("*").alias("n"), F.first("prediction").alias("fx"), F.first("base").alias("fb")
    )
    scored = model.transform(bo._assembler(FEW, True).transform(rows.targets))
    joined = scored.join(per_row, ["series_id", "t"]).select("yhat", "total", "n", "fx", "fb").toPandas()
    assert len(joined) == rows.targets.count() and set(joined.n) == {len(bo.feature_names(FEW))}
    np.testing.assert_allclose(joined.fx, joined.yhat, atol=1e-9)
    np.testing.assert_allclose(joined.total, joined.fx - joined.fb, atol=1e-9)
    # Backgrounds come from all rows, so they differ from row to row.
    assert joined.fb.nunique() > 20


def test_dense_numbers(spark):
    rows, n = bo.numbered(spark.range(0, 1000, 1, 7).where("id % 3 > 0"))
    assert n == 666 and sorted(r["_id"] for r in rows.select("_id").collect()) == list(range(n))


def test_one_failing_forecaster_does_not_stop_the_others(spark, monkeypatch):
    def empty(train, horizon, s):
        return train.where("false").select("series_id", "fold", F.lit(1).alias("h"), F.col("y").alias("yhat"))

    monkeypatch.setitem(FORECASTERS, "arima", empty)
    folds = fd.walk_forward_folds(panel(spark, {"a": yearly(N, 1.0)}))
    scores = score_forecast(cv_run(folds, models=("arima", "additive"))).collect()
    assert {(r.model, r.rmse is None) for r in scores} == {("arima", True), ("additive", False)}
    assert set(FORECASTERS) == set(MODEL_ORDER)


def test_whole_run_is_stored_and_read_back(spark, tmp_path):
    days = [date(2020, 1, 1) + timedelta(days=3 * i) for i in range(400)]
    rng = np.random.default_rng(2)
    rows = [(s, d, float(100 + 10 * np.sin(i / 17) + rng.normal()), "c") for s in ("Ohio", "Iowa") for i, d in enumerate(days)]
    rows += [("Tiny", days[0], 1.0, "c")] + [("Empty", d, None, "c") for d in days]
    sales = spark.createDataFrame(rows, "series_id string, ds date, value double, category string")
    settings = Settings(
        cv=FoldParams(max_folds=3), features=FEW, models=ModelParams(boosted=QUICK)
    )
    at, root = datetime(2024, 1, 1), str(tmp_path / "runs")
    train_run(sales, root, rn.version_name(at), at, settings)
    weights = rn.read_run(spark, root, "weights", "v20240101_000000").collect()
    assert len(weights) == 8 and sum(r.selected for r in weights) == 4
    found = rn.read_run(spark, root, "forecasts", "v20240101_000000", "ohio").collect()
    assert len(found) == 16 and len({r.model for r in found}) == 2
    last = max(d for d in days)
    assert min(r.ds for r in found) > last and {r.h for r in found} == set(range(1, 9))
    skipped = rn.read_run(spark, root, "skipped", "v20240101_000000").collect()
    assert {r.series_id: r.error for r in skipped}["Empty"] == "series has no values"
    assert {r.series_id for r in skipped} == {"Tiny", "Empty"}
    assert spark.read.parquet(f"{root}/runs").first().n_series == 4
    version = "v20240101_000000"
    summary = {r.series_id: r for r in rn.read_run(spark, root, "summary", version).collect()}
    assert set(summary) == {"Ohio", "Iowa", "Tiny", "Empty"} and summary["Ohio"].selected
    assert rn.read_run(spark, root, "metadata", version).count() == 2
    assert [r.series_id for r in rn.read_run(spark, root, "unfilled", version).collect()] == ["Empty"]
    assert "error" in rn.read_run(spark, root, "cv_scores", version).columns
    assert not glob.glob(f"{checkpoint_root(spark)}/weekloom/stage-*/panel*")
    with pytest.raises(ValueError, match="unknown series"):
        train_run(sales, root, "v20240102_000000", at, settings, names=["Ohio", "Utah"], models=("additive",))


def test_additive_gathers_weeks_not_regressors(spark):
    """What is gathered per series and fold is a few numbers per week; the wide rows are made of them behind it."""
    import re

    from weekloom.forecasters.additive import fit_additive
    from weekloom.params import AdditiveParams

    train = history(spark, {"a": yearly(N)})
    for p in (AdditiveParams(), AdditiveParams(changepoint_l1=0.1)):
        plan = fit_additive(train, p)._jdf.queryExecution().optimizedPlan().toString()
        gathered = re.findall(r"collect_list\(([^\n]*?), 0, 0\)", plan)
        assert gathered and all("day" in g and "SIN" not in g for g in gathered)


def test_rows_made_of_parts_give_the_same_factors(spark):
    rows = [(k, t, float((7 * t + k) % 5)) for k in (1, 2) for t in range(9)]
    df = spark.createDataFrame(rows, "k int, t int, y double").coalesce(1).sortWithinPartitions("k", "t")
    wide = lambda w: F.array(F.lit(1.0), w["t"].cast("double"), w["y"])
    direct = df.select("k", wide({c: F.col(c) for c in ("t", "y")}).alias("z"))
    for make, out in ((gr.gram_by_group, "gram"), (gr.qr_by_group, "r")):
        plain = {r.k: r[out] for r in make(direct, ("k",), "z", 3).collect()}
        parts = {r.k: r[out] for r in make(df, ("k",), wide, 3, ("t", "y")).collect()}
        assert parts == plain
