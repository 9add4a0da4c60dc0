"""The trained recurrence: gradients, early stopping, best weights, a signal the mean does not see."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pytest

from test_forecasters import N, forecasts, history, truth_after, yearly
from weekloom.forecasters import gated
from weekloom.forecasters.registry import FORECASTERS
from weekloom.params import ModelParams, RecurrentParams, Settings

SMALL = RecurrentParams(kind="gated", units=16, epochs=25, patience=4, learning_rate=0.02)


def test_gradient_equals_differences():
    rng = np.random.default_rng(1)
    net = gated.GatedNet(3, 2, 4)
    weights = net.start(5)
    x, y = rng.normal(size=(6, 7, 4)), rng.normal(size=(6, 2))
    _, gradient = net.loss_and_gradient(weights, x, y)
    for i in range(len(weights)):
        step = np.zeros_like(weights)
        step[i] = 1e-6
        up, down = (net.loss_and_gradient(weights + s, x, y)[0] for s in (step, -step))
        assert abs((up - down) / 2e-6 - gradient[i]) < 1e-7


def test_adam_moves_by_the_rate_and_clips():
    p = replace(SMALL, learning_rate=0.1, clip=1.0)
    state = gated.adam_step(np.zeros(7), np.array([30.0, -40.0]), p)
    assert np.allclose(state[:2], [-0.1, 0.1]) and state[-1] == 1
    assert np.allclose(state[2:4], [0.06, -0.08])


def test_beats_the_mean_on_a_season(spark):
    series = {f"s{i}": yearly(N, 0.5, 100 + i, seed=i) for i in range(4)}
    settings = Settings(models=replace(ModelParams(), recurrent=SMALL))
    got = forecasts(FORECASTERS["recurrent"](history(spark, series), 8, settings))
    for i in range(4):
        target = truth_after(N) + i
        error = np.sqrt(np.mean((np.array(got[f"s{i}"]) - target) ** 2))
        flat = np.sqrt(np.mean((series[f"s{i}"].mean() - target) ** 2))
        assert error < 0.5 * flat


def test_loss_falls_and_the_best_weights_stay(spark):
    series = {f"s{i}": yearly(N, 0.5, 100 + i, seed=i) for i in range(2)}
    p = replace(SMALL, epochs=40, patience=2, learning_rate=0.05)
    _, windows = gated.training_windows(history(spark, series), 8, p)
    rows = windows.collect()
    count = N - p.lookback - 8 + 1
    held = max(1, int(0.1 * count))
    assert len(rows) == 2 * count and sum(r["validation"] for r in rows) == 2 * held
    trained = gated.train_gated(windows, 8, p)
    losses = [h[5] for h in trained.history]
    assert {h[2:4] for h in trained.history[:40]} == {(2 * (count - held), 2 * held)}
    assert min(losses) < 0.5 * losses[0]
    assert [h[6] for h in trained.history] == [v < min(losses[:i], default=np.inf) for i, v in enumerate(losses)]
    # Two epochs without a gain end it, unless the epochs ran out first.
    assert len(losses) == 41 or losses.index(min(losses)) == len(losses) - 3
    net, (fold, weights) = gated.GatedNet(p.units, 8), next(iter(trained.weights.items()))
    asked = [r for r in rows if r["validation"] and r["fold"] == fold]
    left = net.forecast(weights, np.array([r["inputs"] for r in asked])) - np.array([r["targets"] for r in asked])
    assert abs((left**2).mean() - min(losses)) < 1e-9
    assert gated.train_gated(windows, 8, p).history == trained.history


def test_short_missing_constant_and_no_series(spark):
    broken = yearly(N)
    broken[50] = np.nan
    rows = history(spark, {"short": yearly(75), "broken": broken, "endless": np.where(np.arange(N) == 9, np.inf, yearly(N)), "flat": np.full(N, 7.0), "long": yearly(N)})
    p = replace(SMALL, epochs=2)
    got = forecasts(gated.fc_gated(rows, 8, p))
    assert got.keys() == {"long", "flat"} and all(len(v) == 8 and np.isfinite(v).all() for v in got.values())
    assert gated.fc_gated(rows.limit(0), 8, p).count() == 0
    assert gated.gated_history(rows.limit(0), 8, p).count() == 0


def test_unknown_kind():
    with pytest.raises(ValueError, match="unknown recurrence"):
        RecurrentParams(kind="other")
