from __future__ import annotations

from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from helpers import history, panel
from weekloom.functions.calendar import holiday_flag, iso_week
from weekloom.operators import features as ft
from weekloom.operators import windows as wd
from weekloom.params import FeatureParams, FoldParams


def test_feature_names_and_warmup():
    assert len(ft.feature_names()) == 20 and FeatureParams().warmup == 30
    assert FeatureParams(lags=(1,), rolling_windows=(13,)).warmup == 12


def test_lags_and_rolling_agree_with_pandas(spark):
    rng = np.random.default_rng(1)
    y = pd.Series(rng.uniform(1e7, 1e9, 120))
    got = ft.feature_matrix(panel(spark, {"a": list(y)})).toPandas().sort_values("t")
    for k in (1, 7, 30):
        np.testing.assert_allclose(got[f"lag_{k}"], y.shift(k))
    for n in (4, 8, 13):
        np.testing.assert_allclose(got[f"rolling_mean_{n}"], y.rolling(n).mean())
        np.testing.assert_allclose(got[f"rolling_std_{n}"], y.rolling(n).std(), rtol=1e-6)
    assert len(ft.drop_warmup(ft.feature_matrix(panel(spark, {"a": list(y)}))).toPandas()) == 90


@pytest.mark.parametrize(("day", "week"), [(date(2023, 1, 1), 52), (date(2020, 12, 31), 53)])
def test_iso_week(spark, day, week):
    assert spark.range(1).select(iso_week(F.lit(day))).first()[0] == week


def _federal_days(year: int) -> set[date]:
    """Brute force: walk over the days of the year."""
    days = [date(year, 1, 1) + timedelta(days=i) for i in range(366)]
    days = [d for d in days if d.year == year]

    def nth(month, weekday, n):
        return [d for d in days if d.month == month and d.weekday() == weekday][n]

    fixed = [(1, 1), (7, 4), (11, 11), (12, 25)] + ([(6, 19)] if year >= 2021 else [])
    out = set()
    for month, day in fixed:
        d = date(year, month, day)
        out |= {d, d - timedelta(days=d.weekday() == 5) + timedelta(days=d.weekday() == 6)}
    return out | {nth(1, 0, 2), nth(2, 0, 2), nth(5, 0, -1), nth(9, 0, 0), nth(10, 0, 1), nth(11, 3, 3)}


def test_holiday_weeks(spark):
    federal = set().union(*[_federal_days(y) for y in range(1994, 2032)])
    weeks = [date(1995, 1, 1) + timedelta(days=7 * i) for i in range(1900)]
    df = spark.createDataFrame([(w,) for w in weeks], "w date")
    got = {r.w: r.f for r in df.select("w", holiday_flag(F.col("w")).alias("f")).collect()}
    for w in weeks:
        assert got[w] == int(any(w - timedelta(days=i) in federal for i in range(7))), w
    assert got[date(2022, 12, 25)] == 1 and got[date(2023, 1, 1)] == 1


def test_direct_targets_stay_inside(spark):
    rows = ft.direct_targets(panel(spark, {"a": range(10), "b": range(3)}), 8)
    pairs = {(r.series_id, r.t, r.h, r.target) for r in rows.collect()}
    expected = {
        (s, t, h, float(t + h)) for s, n in (("a", 10), ("b", 3)) for t in range(n) for h in range(1, 9) if t + h < n
    }
    assert pairs == expected


def test_future_calendar(spark):
    weeks = ft.future_calendar(panel(spark, {"a": range(3)}), 2).orderBy("h").collect()
    assert [(r.h, r.ds) for r in weeks] == [(1, date(2020, 1, 26)), (2, date(2020, 2, 2))]


def test_tail_features_have_no_nulls(spark):
    rows = ft.tail_transform(panel(spark, {"a": range(128)}), FoldParams())
    assert rows.count() == 40 and rows.na.drop().count() == 40


def test_minmax_round_trip_and_constant(spark):
    rows = history(spark, {"a": [3, 9, 6], "c": [5, 5, 5]})
    scaled = wd.minmax_scale(rows)
    back = scaled.withColumn("b", wd.minmax_inverse(F.col("y_scaled"), F.col("y_min"), F.col("y_range")))
    got = {(r.series_id, r.t): (r.y_scaled, r.b) for r in back.collect()}
    assert got[("a", 2)] == (0.5, 6.0) and got[("c", 1)] == (0.0, 5.0)


def test_window_count_and_holdout(spark):
    steps = wd.timestep_features(wd.minmax_scale(history(spark, {"a": range(104)})))
    windows = wd.chrono_holdout(wd.lookback_windows(steps))
    rows = windows.orderBy("t").collect()
    assert len(rows) == 104 - 52 - 8 + 1 and [r.t for r in rows] == list(range(51, 96))
    assert sum(r.validation for r in rows) == 4 and rows[-1].validation and not rows[0].validation
    assert len(rows[0].inputs) == 52 and len(rows[0].inputs[0]) == 12
    np.testing.assert_allclose(rows[3].targets, [(55 + i) / 103 for i in range(8)])


def test_short_series_guard(spark):
    bad = wd.min_length_guard(history(spark, {"short": range(10), "long": range(76)}), 76).collect()
    assert [(r.series_id, r.error) for r in bad] == [("short", "needs at least 76 weeks, got 10")]
