"""Cross-validation of many series: forecasts count, and what is worked on together equals what is worked on alone."""

from __future__ import annotations

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import history
from weekloom.checks import queries
from weekloom.forecasters import arima
from weekloom.forecasters import forest as fo
from weekloom.forecasters.additive import fc_additive
from weekloom.forecasters.registry import FORECASTERS
from weekloom.params import BoostedParams


def _no_forecast(value, reason=None):
    def fc(train, horizon, settings):
        keys = train.select("series_id", "fold").distinct()
        rows = keys.select("*", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("h"))
        return rows.select("*", F.lit(value).cast("double").alias("yhat"), F.lit(reason).cast("string").alias("error"))

    return fc


def test_customers_without_a_forecast_are_missing(spark, tmp_path, monkeypatch):
    """A week is there for each model that forecast it or said why not; the other models' weeks are not."""
    day = datetime(1996, 1, 1)
    rows = [(k, k % 2, "F", 100.0 + k % 7, day + timedelta(days=7 * (k // 2)), "1-URGENT") for k in range(2 * 130)]
    orders = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string"
    spark.createDataFrame(rows, orders).write.parquet(f"{tmp_path}/orders.parquet")
    for name, fc in (("boosted", _no_forecast(1.0)), ("recurrent", _no_forecast(float("nan"))), ("arima", _no_forecast(None, "why"))):
        monkeypatch.setitem(FORECASTERS, name, fc)
    weeks = {r.model: r["count"] for r in queries.cv_run_customers(spark, str(tmp_path)).groupBy("model").count().collect()}
    assert weeks == {"arima": 80, "additive": 80, "boosted": 80}


@pytest.mark.parametrize("share", [1.0, 0.5])
def test_rows_made_of_weeks_are_the_rows(spark, share):
    """Trees on weeks with several values ahead equal those on one row per value, and a week's bins are stored once."""
    rng = np.random.default_rng(5)
    n, names = 300, ["a", "b", "h"]
    x = rng.normal(size=(n, 2))
    ahead = [[float(a * h + b) if (k + h) % 11 else None for h in (1, 2, 3)] for k, (a, b) in enumerate(x)]
    weeks = spark.createDataFrame([(0, ahead[k], *map(float, x[k])) for k in range(n)], "grp int, y array<double>, a double, b double").coalesce(1)
    long = weeks.select("grp", F.posexplode("y").alias("p", "v"), "a", "b").where("v IS NOT NULL")
    rows = long.select("grp", F.array("v").alias("y"), "a", "b", (F.col("p") + 1).alias("h"))
    score = rows.select("grp", F.concat_ws("/", "a", "h").alias("name"), F.lit(1.0).alias("scale"), F.array(F.lit(None).cast("double")).alias("truth"), *names)
    edges = [*fo.quantile_edges(weeks, ["a", "b"], 16), np.arange(1, 3, dtype=np.float64)]
    p = BoostedParams(n_estimators=4, max_depth=3, subsample=share, colsample=1.0)
    found = []
    for learn, unfold in ((weeks, True), (rows, False)):
        chunks = fo.make_chunks(learn, score, names, edges, 1, unfold=unfold)
        learned = chunks.where("names IS NULL").select("n", F.length("bins").alias("size")).collect()
        assert sum(r.n for r in learned) == sum(v is not None for a in ahead for v in a)
        assert sum(r.size for r in learned) == (2 * n if unfold else 3 * sum(r.n for r in learned))
        forest = fo.Forest([fo.Model(0, 0, p, 0.5)], 1, edges)
        found.append({r["name"]: r["yhat"] for r in forest.forecasts(forest.fit(chunks)).collect()})
    assert found[0].keys() == found[1].keys() and np.std(list(found[0].values())) > 0.1
    np.testing.assert_allclose([found[0][k] for k in found[0]], [found[1][k] for k in found[0]], rtol=1e-9)


def test_series_side_by_side_are_those_alone(spark):
    """Series of several lengths, one of them too short and one constant, get what they get alone."""
    rng = np.random.default_rng(2)
    series = {f"s{k}": 50 + np.cumsum(rng.normal(size=100 + 10 * (k % 3))) for k in range(9)}
    series |= {"short": np.arange(12.0), "flat": np.full(110, 3.7)}
    for fc in (arima.fc_arima, fc_additive):
        together = {(r.series_id, r.h): (r.yhat, r.error) for r in fc(history(spark, series), 8).collect()}
        for name in ("s0", "s4", "short", "flat"):
            for r in fc(history(spark, {name: series[name]}), 8).collect():
                yhat, error = together[name, r.h]
                assert error == r.error and (yhat is None) == (r.yhat is None)
                assert yhat is None or abs(yhat - r.yhat) < 1e-9 * max(1, abs(yhat))


def test_steps_down_tell_what_the_roots_tell():
    rng = np.random.default_rng(1)
    for lags in ([1, 2, 3, 52], [1, 2], [52]):
        c = rng.normal(size=(60, len(lags))) * rng.choice([0.3, 1.0], size=(60, 1))
        size, told = max(lags), arima.stable_rows(c, lags)
        for row, stable in zip(c, told):
            companion = np.eye(size, k=-1)
            companion[0, np.array(lags) - 1] = row
            assert stable == (np.abs(np.linalg.eigvals(companion)).max() < 0.999)
