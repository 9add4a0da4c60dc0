from __future__ import annotations

from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from helpers import panel
from weekloom.operators import folds as fd
from weekloom.operators import panel as pn
from weekloom.params import FoldParams, PanelParams

SALES = "series_id string, ds date, value double, category string"


def sales(spark, rows):
    return spark.createDataFrame([(s, d, v, "c") for s, d, v in rows], SALES)


def values(df):
    return [r.y for r in df.orderBy("series_id", "week_end").collect()]


def test_week_edges_and_gap(spark):
    rows = [("a", date(2024, 1, 7), 1.0), ("a", date(2024, 1, 8), 2.0), ("a", date(2024, 1, 22), 3.0)]
    grid = pn.gap_fill_grid(pn.weekly_resample(sales(spark, rows)))
    assert [(r.week_end, r.t, r.y) for r in grid.orderBy("t").collect()] == [
        (date(2024, 1, 7), 0, 1.0),
        (date(2024, 1, 14), 1, 2.0),
        (date(2024, 1, 21), 2, None),
        (date(2024, 1, 28), 3, 3.0),
    ]


def test_week_of_nulls_stays_null(spark):
    rows = [("a", date(2024, 1, 7), None), ("a", date(2024, 1, 9), None), ("a", date(2024, 1, 9), 2.0)]
    for params in (PanelParams(), PanelParams(minor_digits=2)):
        assert values(pn.weekly_resample(sales(spark, rows), params)) == [None, 2.0]


@pytest.mark.parametrize(
    ("mode", "given_", "expected"),
    [
        ("linear", [1, None, 3, None], [1, 2, 3, 3]),
        ("linear", [None, 2, 4], [2, 2, 4]),
        ("linear", [1, None, None, 4], [1, 2, 3, 4]),
        ("ffill", [None, 2, None, 4], [2, 2, 2, 4]),
        ("bfill", [None, 2, None, 4, None], [2, 2, 4, 4, 4]),
        ("linear", [None, None], [None, None]),
    ],
)
def test_impute(spark, mode, given_, expected):
    assert values(pn.impute(panel(spark, {"a": given_}), mode)) == expected


def test_unknown_modes():
    with pytest.raises(ValueError):
        PanelParams(imputation="spline")
    with pytest.raises(ValueError):
        PanelParams(outlier_strategy="drop")


def test_quartiles_and_constant_series(spark):
    rows = pn.iqr_bounds(panel(spark, {"a": [1, 2, 4, 10]}), 0.0).collect()
    assert {(r.lower, r.upper) for r in rows} == {(1.75, 5.5)}
    assert values(pn.iqr_cap(panel(spark, {"a": [5, 5, 5]}))) == [5, 5, 5]


def test_fold_counts(spark):
    lengths = {"n119": 119, "n120": 120, "n128": 128, "n256": 256}
    p = panel(spark, {k: range(n) for k, n in lengths.items()})
    folds = fd.walk_forward_folds(p)
    got = {r.series_id: r.n for r in folds.groupBy("series_id").agg(F.count_distinct("fold").alias("n")).collect()}
    assert got == {"n120": 3, "n128": 5, "n256": 5}
    skipped = fd.skipped_series(p).collect()
    assert [(r.series_id, r.n_folds) for r in skipped] == [("n119", 2)]
    assert "119 weeks gives 2 folds" in skipped[0].error
    tests = folds.where("role = 'test'").groupBy("series_id", "fold").count()
    assert {r["count"] for r in tests.collect()} == {8}
    assert fd.leaking_folds(folds).count() == 0


def test_folds_from_the_end_cover_the_newest_week(spark):
    p = panel(spark, {"a": range(256)})
    folds = fd.walk_forward_folds(p, FoldParams(anchor="end"))
    spans = folds.where("role = 'test'").groupBy("fold").agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    assert {(r.fold, r.lo, r.hi) for r in spans.collect()} == {(f, 232 + 4 * f, 239 + 4 * f) for f in range(5)}


def test_fold_scoped_cap_does_not_see_test_weeks(spark):
    base = [float(i % 7) for i in range(112)]
    high = base[:104] + [1e6] * 8
    p = FoldParams(max_folds=1, min_folds=1)
    capped = []
    for series in (base, high):
        folds = fd.walk_forward_folds(panel(spark, {"a": series}), p)
        capped.append(values(fd.fold_scoped_cap(folds).where("role = 'train'")))
    assert capped[0] == capped[1]


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    st.lists(
        st.tuples(
            st.sampled_from("ab"),
            st.integers(0, 300),
            st.one_of(st.none(), st.integers(-1000, 100000).map(lambda c: c / 100)),
        ),
        min_size=1,
        max_size=60,
    )
)
def test_panel_agrees_with_pandas(spark, raw):
    rows = [(s, date(2021, 3, 1) + timedelta(days=d), v) for s, d, v in raw]
    got = pn.prepare_panel(sales(spark, rows), PanelParams(minor_digits=2, iqr_multiplier=1.0)).toPandas()
    frame = pd.DataFrame(rows, columns=["s", "d", "v"]).assign(d=lambda f: pd.to_datetime(f.d))
    for name, group in frame.groupby("s"):
        y = group.set_index("d").v.astype(float).sort_index().resample("W-SUN").sum(min_count=1)
        y = y.interpolate("linear").ffill().bfill()
        q1, q3 = y.quantile(0.25), y.quantile(0.75)
        y = y.clip(q1 - (q3 - q1), q3 + (q3 - q1))
        mine = got[got.series_id == name].sort_values("week_end")
        assert list(pd.to_datetime(mine.week_end)) == list(y.index)
        np.testing.assert_allclose(mine.y.to_numpy(float), y.to_numpy(float), rtol=1e-9, atol=1e-9)
        assert list(mine.t) == list(range(len(y)))


def test_all_folds_and_series_without_values(spark):
    p = panel(spark, {"n256": [1.0] * 256, "none": [None] * 256})
    folds = fd.walk_forward_folds(p, FoldParams(max_folds=None))
    assert {r.series_id for r in folds.select("series_id").distinct().collect()} == {"n256"}
    assert folds.select("fold").distinct().count() == (256 - 112) // 4 + 1
    assert [(r.series_id, r.error) for r in fd.skipped_series(p).collect()] == [("none", "series has no values")]


def test_neighbours_spare_the_sort_of_the_grid(spark):
    """Values, empty weeks, weeks of NULLs, a row without a date and a series without any value."""
    day = date(2024, 1, 7)
    known = {0: None, 2: 4.0, 5: None, 7: 10.0, 8: None, 12: 3.0, 14: None}
    rows = [("a", day + timedelta(days=7 * w), v) for w, v in known.items()]
    rows += [("b", day + timedelta(days=7 * w), None) for w in (0, 3)]
    rows += [("a", None, 99.0), (None, day, 1.0), (None, day + timedelta(days=21), 7.0), ("c", day, 5.0)]
    weekly = pn.weekly_resample(sales(spark, rows))
    for mode in ("linear", "ffill", "bfill"):
        plain = pn.impute(pn.gap_fill_grid(weekly), mode)
        spared = pn.impute(pn.gap_fill_grid(weekly, neighbours=True), mode)
        assert spared.columns == plain.columns
        key = lambda r: (r.series_id or "", r.week_end)
        assert sorted(spared.collect(), key=key) == sorted(plain.collect(), key=key)
    # One window, over the observed weeks; the whole panel needs one more, for the capping bounds.
    for df, windows in ((spared, 1), (pn.prepare_panel(sales(spark, rows)), 2)):
        assert df._jdf.queryExecution().sparkPlan().toString().count("Window [") == windows
