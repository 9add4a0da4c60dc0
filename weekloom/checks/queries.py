"""One query per operator, each over whole tables. Keys match ``oracles.py``."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weekloom.checks.stand_ins import STAND_INS, stand_in_forecasts
from weekloom.forecasters.additive import fc_additive as additive_forecast
from weekloom.forecasters.arima import fc_arima as arima_forecast
from weekloom.forecasters.arima import arma_likelihood, differencing_order, fit_arima
from weekloom.forecasters.boosted import direct_rows, fit_trees
from weekloom.forecasters.boosted import explain_trees as explain_forest
from weekloom.forecasters.boosted import fc_boosted_direct as boosted_forecast
from weekloom.forecasters.boosted import tune_boosted as tune_trees
from weekloom.forecasters.gated import fc_gated as gated_forecast
from weekloom.forecasters.gated import gated_history
from weekloom.forecasters.gram import gram_sums
from weekloom.forecasters.recurrent import fc_recurrent as recurrent_forecast
from weekloom.functions.metrics import mae, mape, rmse, smape
from weekloom.functions.text import format_magnitude
from weekloom.operators import features as ft
from weekloom.operators import folds as fd
from weekloom.operators import panel as pn
from weekloom.operators import reports as rp
from weekloom.operators import selection as sl
from weekloom.operators import windows as wd
from weekloom.params import (
    BoostedParams,
    FeatureParams,
    FoldParams,
    ModelParams,
    AdditiveParams,
    ArimaParams,
    PanelParams,
    RecurrentParams,
    SalesColumns,
    Settings,
)
from weekloom.plans import training as tr
from weekloom.session import new_table_path, write_table
from weekloom.sources import orders as od
from weekloom.sources import runs as rn
from weekloom.sources import sales as so
from weekloom.sources.workbook import write_workbooks

Query = Callable[[SparkSession, str], DataFrame]

MONEY = PanelParams(minor_digits=2)
NOW = datetime(2024, 4, 1, 12, 0, 0)
# Forecasts are checked in another currency. A rate with many digits keeps averages away from exact
# halves of the last printed digit, which Spark and DuckDB round to different sides.
RATE = 0.9137254901
REGISTRY: dict[str, Query] = {}


def query(fn: Query) -> Query:
    REGISTRY[fn.__name__] = fn
    return fn


def rounded(df: DataFrame, digits: int = 4, **special: int) -> DataFrame:
    """Round every DOUBLE column: sums of doubles differ in the last bits between engines."""
    columns: list[Column] = []
    for name, kind in df.dtypes:
        if kind == "double":
            columns.append(F.round(name, special.get(name, digits)).alias(name))
        else:
            columns.append(F.col(name))
    return df.select(*columns)


def _segments(spark, d):
    return od.nation_sales(spark, d, ("n_name", "c_mktsegment"))


def _nation_panel(spark, d):
    return pn.prepare_panel(od.nation_sales(spark, d), MONEY)


def _segment_panel(spark, d):
    return pn.prepare_panel(_segments(spark, d), MONEY)


def _nation_folds(spark, d):
    return fd.walk_forward_folds(_nation_panel(spark, d))


def _converted_panel(spark, d):
    return _nation_panel(spark, d).withColumn("y", F.col("y") * RATE)


def _converted_folds(spark, d):
    return fd.walk_forward_folds(_converted_panel(spark, d))


def _cv_predictions(spark, d):
    folds = _converted_folds(spark, d)
    forecasts = stand_in_forecasts(fd.training_rows(folds))
    return sl.complete_predictions(folds, forecasts, STAND_INS)


def _cv_scores(spark, d):
    return sl.score_forecast(_cv_predictions(spark, d))


def _weights(spark, d):
    return sl.weigh_models(_cv_scores(spark, d), models=STAND_INS)


def _forecasts(spark, d):
    return stand_in_forecasts(fd.full_history(_converted_panel(spark, d)))


# -- sources ----------------------------------------------------------------------------------


@query
def scan_workbook(spark, d):
    """All orders written as workbooks, days as native dates and as day-first text by turns, and read back."""
    day = F.col("o_orderdate").cast("date")
    text = F.when(F.col("o_orderkey") % 5 < 2, F.date_format(day, "yyyy-MM-dd")).otherwise(F.date_format(day, "dd-MM-yyyy"))
    raw = spark.read.parquet(f"{d}/orders.parquet").select(
        F.col("o_custkey").cast("string").alias("State"),
        text.alias("Date"),
        F.col("o_totalprice").alias("Total"),
        F.col("o_orderpriority").alias("Category"),
    )
    path = new_table_path(spark, "workbooks")
    write_workbooks(raw, path, native_dates=("Date",))
    return so.scan_sales(spark, path, fmt="xlsx")


@query
def scan_sales(spark, d):
    """The stored orders as raw sales of customers; the columns are checked on the way."""
    columns = SalesColumns("o_custkey", "o_orderdate", "o_totalprice", "o_orderpriority")
    return so.scan_sales(spark, f"{d}/orders.parquet", columns)


@query
def validate_columns(spark, d):
    """The stored orders pass with the columns they have; the names found come back."""
    orders = so.read_raw(spark, f"{d}/orders.parquet")
    checked = so.validate_columns(orders, ("o_custkey", "o_orderdate", "o_totalprice"))
    return checked.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n_rows"))


@query
def parse_mixed_dates(spark, d):
    """Order dates written as day-first text, ISO text and serial numbers, then read back."""
    orders = spark.read.parquet(f"{d}/orders.parquet")
    day = F.col("o_orderdate").cast("date")
    kind = F.pmod("o_orderkey", F.lit(3))
    text = (
        F.when(kind == 0, F.date_format(day, "dd-MM-yyyy"))
        .when(kind == 1, F.date_format(day, "yyyy-MM-dd"))
        .otherwise(F.datediff(day, F.lit(so.SERIAL_DAY_ZERO).cast("date")).cast("string"))
    )
    raw = orders.select("o_orderkey", text.alias("raw_date"), text.alias("ds"))
    return so.parse_mixed_dates(raw, "ds")


@query
def cast_target(spark, d):
    orders = spark.read.parquet(f"{d}/orders.parquet")
    text = orders.select("o_orderkey", F.format_string("%.2f", "o_totalprice").alias("value"))
    return so.cast_target(text, "value")


@query
def null_audit(spark, d):
    return so.null_audit(od.customer_sales(spark, d))


@query
def dataset_profile(spark, d):
    return so.dataset_profile(od.nation_sales(spark, d))


# -- panel ------------------------------------------------------------------------------------


@query
def weekly_resample(spark, d):
    return pn.weekly_resample(od.customer_sales(spark, d), MONEY)


@query
def gap_fill_grid(spark, d):
    return pn.gap_fill_grid(pn.weekly_resample(od.customer_sales(spark, d), MONEY))


def _customer_grid(spark, d, neighbours=False):
    return pn.gap_fill_grid(pn.weekly_resample(od.customer_sales(spark, d), MONEY), neighbours)


@query
def impute_linear(spark, d):
    return pn.impute(_customer_grid(spark, d, neighbours=True), "linear")


@query
def impute_ffill_bfill(spark, d):
    """Interior gaps left to the ends: forward fill, then back fill."""
    return pn.impute(_customer_grid(spark, d, neighbours=True), "ffill")


@query
def impute_mode(spark, d):
    return pn.impute(_customer_grid(spark, d, neighbours=True), "bfill")


@query
def impute_residual_check(spark, d):
    """Customers all of whose orders are pending have no value to impute from."""
    return pn.impute_residual_check(pn.impute(_customer_grid(spark, d, neighbours=True)))


@query
def iqr_cap(spark, d):
    return _segment_panel(spark, d)


@query
def iqr_cap_report(spark, d):
    panel = pn.prepare_panel(_segments(spark, d), MONEY, cap=False)
    return pn.iqr_cap_report(panel, 1.5)


@query
def outlier_none(spark, d):
    params = PanelParams(outlier_strategy="none", minor_digits=2)
    return pn.prepare_panel(_segments(spark, d), params)


@query
def preprocess_report(spark, d):
    return rounded(pn.preprocess_report(od.customer_sales(spark, d), MONEY))


@query
def panel_span(spark, d):
    return pn.panel_span(pn.preprocess_report(od.customer_sales(spark, d), MONEY))


# -- folds ------------------------------------------------------------------------------------


@query
def walk_forward_folds(spark, d):
    return _nation_folds(spark, d)


@query
def walk_forward_folds_end(spark, d):
    """Folds counted back from the newest week."""
    return fd.walk_forward_folds(_nation_panel(spark, d), FoldParams(anchor="end"))


@query
def fold_min_guard(spark, d):
    return fd.skipped_series(pn.prepare_panel(od.event_sales(spark, d), MONEY))


@query
def fold_param_override(spark, d):
    return fd.walk_forward_folds(_nation_panel(spark, d), FoldParams(60, 4, 2, 8, 2))


@query
def fold_param_all(spark, d):
    """Every fold the series are long enough for."""
    return fd.walk_forward_folds(_nation_panel(spark, d), FoldParams(60, 4, 26, None, 2))


def _customer_panel(spark, d):
    """Series of customers: many, short and long ones, some without any value."""
    return pn.prepare_panel(od.customer_sales(spark, d), MONEY)


@query
def skipped_customers(spark, d):
    return fd.skipped_series(_customer_panel(spark, d))


@query
def fold_leakage_check(spark, d):
    return fd.leaking_folds(_nation_folds(spark, d))


@query
def fold_scoped_cap(spark, d):
    panel = pn.prepare_panel(od.nation_sales(spark, d), MONEY, cap=False)
    return fd.fold_scoped_cap(fd.walk_forward_folds(panel), 1.5)


# -- features ---------------------------------------------------------------------------------

FEATURES = ft.FeatureParams()


@query
def lag_features(spark, d):
    panel = _segment_panel(spark, d)
    return panel.select("series_id", "week_end", *ft.lag_features(FEATURES))


def _rolling(spark, d, stat):
    p = ft.FeatureParams(rolling_stats=(stat,))
    return _segment_panel(spark, d).select("series_id", "week_end", *ft.rolling_features(p))


@query
def rolling_mean(spark, d):
    return _rolling(spark, d, "mean")


@query
def rolling_std(spark, d):
    return rounded(_rolling(spark, d, "std"), 2)


@query
def calendar_features(spark, d):
    panel = _segment_panel(spark, d)
    return panel.select("series_id", "week_end", *ft.calendar_features(FEATURES))


@query
def holiday_flag(spark, d):
    panel = _segment_panel(spark, d)
    return panel.select("series_id", "week_end", ft.holiday_flag(F.col("week_end")).alias("holiday"))


@query
def fourier_features(spark, d):
    panel = _segment_panel(spark, d)
    return rounded(panel.select("series_id", "week_end", *ft.fourier_features(FEATURES)), 6)



def _rounded_features(df):
    """Deviations and Fourier terms rounded; lags and means are exact in both engines."""
    digits = {f"rolling_std_{n}": 2 for n in FEATURES.rolling_windows}
    digits |= {n: 6 for n in ft.feature_names() if n.startswith("fourier_")}
    return df.withColumns({c: F.round(c, k) for c, k in digits.items()})



@query
def feature_matrix(spark, d):
    return _rounded_features(ft.feature_matrix(_nation_panel(spark, d)))


@query
def drop_warmup(spark, d):
    return _rounded_features(ft.drop_warmup(ft.feature_matrix(_nation_panel(spark, d))))


@query
def tail_transform(spark, d):
    return _rounded_features(ft.tail_transform(_nation_panel(spark, d)))


@query
def feature_null_audit(spark, d):
    return ft.feature_null_audit(ft.feature_matrix(_segment_panel(spark, d)))


@query
def direct_targets(spark, d):
    lags = _nation_panel(spark, d).select("*", *ft.lag_features(FEATURES))
    return ft.direct_targets(lags.drop("lag_7", "lag_30"), 8)


@query
def last_feature_row(spark, d):
    folds = fd.training_rows(_nation_folds(spark, d))
    lagged = folds.select("*", *ft.lag_features(FEATURES, ("series_id", "fold")))
    return ft.last_feature_row(lagged, ("series_id", "fold"))


@query
def future_calendar(spark, d):
    return ft.future_calendar(_segment_panel(spark, d), 8)


# -- scaling and windows ----------------------------------------------------------------------


def _scaled_train(spark, d):
    return wd.minmax_scale(fd.training_rows(_nation_folds(spark, d)))


def _timesteps(spark, d):
    return wd.timestep_features(_scaled_train(spark, d))


@query
def minmax_scale(spark, d):
    """Scaled on the train rows of each fold, test rows with the same bounds, and scaled back."""
    train = F.col("role") == "train"
    scaled = wd.minmax_scale(_nation_folds(spark, d), fit_rows=train)
    back = wd.minmax_inverse(F.col("y_scaled"), F.col("y_min"), F.col("y_range"))
    return scaled.withColumn("y_back", back)


@query
def timestep_features(spark, d):
    return rounded(_timesteps(spark, d).select("series_id", "fold", "t", *wd.timestep_names()), 6)


def _windows(spark, d):
    return wd.lookback_windows(_timesteps(spark, d))


@query
def lookback_windows(spark, d):
    """Windows with their size, first and last inputs and targets as plain columns."""
    w = _windows(spark, d)
    return rounded(
        w.select(
            "series_id",
            "fold",
            "week_end",
            "t",
            F.size("inputs").alias("n_inputs"),
            F.size(F.col("inputs")[0]).alias("n_cells"),
            F.size("targets").alias("n_targets"),
            F.col("inputs")[0][0].alias("first_value"),
            F.col("inputs")[51][0].alias("last_value"),
            F.col("inputs")[51][1].alias("last_week"),
            F.col("targets")[0].alias("first_target"),
            F.col("targets")[7].alias("last_target"),
        ),
        8,
    )


@query
def chrono_holdout(spark, d):
    return wd.chrono_holdout(_windows(spark, d)).select("series_id", "fold", "t", "validation")


@query
def min_length_guard(spark, d):
    """Customers whose series is shorter than one window, its targets and a batch."""
    grid = _customer_grid(spark, d)
    return wd.min_length_guard(grid, 76, ("series_id",))


# -- metrics ----------------------------------------------------------------------------------


def _metric(spark, d, name, fn):
    value = fn(F.col("y_true"), F.col("yhat")).alias(name)
    return rounded(_cv_predictions(spark, d).groupBy("series_id", "model", "fold").agg(value))


@query
def metric_rmse(spark, d):
    return _metric(spark, d, "rmse", rmse)


@query
def metric_mae(spark, d):
    return _metric(spark, d, "mae", mae)


@query
def metric_mape(spark, d):
    return _metric(spark, d, "mape", mape)


@query
def metric_smape(spark, d):
    return _metric(spark, d, "smape", smape)


@query
def score_forecast(spark, d):
    return rounded(_cv_scores(spark, d))


# -- selection --------------------------------------------------------------------------------


@query
def mean_cv_rmse(spark, d):
    return rounded(sl.mean_cv_rmse(_cv_scores(spark, d)))


@query
def rank_models(spark, d):
    return rounded(sl.rank_models(sl.mean_cv_rmse(_cv_scores(spark, d)), STAND_INS))


@query
def select_top_k(spark, d):
    return rounded(_weights(spark, d).where("selected").drop("weight"))


@query
def weights_inverse_rmse(spark, d):
    return rounded(_weights(spark, d), weight=8)


@query
def weights_uniform(spark, d):
    selection = sl.select_top_k(sl.rank_models(sl.mean_cv_rmse(_cv_scores(spark, d)), STAND_INS))
    return rounded(sl.ensemble_weights(selection, "uniform"), weight=8)


@query
def fold0_overfit_check(spark, d):
    return rounded(sl.fold0_overfit_check(_cv_scores(spark, d), "lag_52", 1.2))


@query
def clip_sampling_params(spark, d):
    """Sampling shares spread over and beyond the safe range, one row per line item."""
    lines = spark.read.parquet(f"{d}/lineitem.parquet")
    trials = lines.select(
        "l_orderkey",
        "l_linenumber",
        (F.col("l_quantity") / 40).alias("subsample"),
        (F.col("l_discount") * 15).alias("colsample"),
    )
    return rounded(sl.clip_sampling_params(trials), 6)


@query
def train_subset(spark, d):
    names = ["NATION_3", "NATION_7", "NATION_11"]
    return sl.train_subset(write_table(_nation_panel(spark, d), "panel"), names)


@query
def run_summary(spark, d):
    """Nations with their models; event types as skipped series."""
    skipped = fd.skipped_series(pn.prepare_panel(od.event_sales(spark, d), MONEY))
    return rounded(sl.run_summary(_weights(spark, d), skipped, STAND_INS))


@query
def model_failure_isolation(spark, d):
    """One stand-in fails on one fold: only that model's score is lost."""
    folds = _converted_folds(spark, d)
    forecasts = stand_in_forecasts(fd.training_rows(folds))
    failing = (F.col("model") == "drift") & (F.col("fold") == 2)
    broken = forecasts.withColumn("yhat", F.when(~failing, F.col("yhat")))
    scores = sl.score_forecast(sl.complete_predictions(folds, broken, STAND_INS))
    return rounded(sl.weigh_models(scores, models=STAND_INS), weight=8)


@query
def failed_folds(spark, d):
    folds = _converted_folds(spark, d)
    forecasts = stand_in_forecasts(fd.training_rows(folds))
    kept = forecasts.where((F.col("model") != "drift") | (F.col("fold") != 2))
    return sl.failed_folds(sl.complete_predictions(folds, kept, STAND_INS))


# -- runs -------------------------------------------------------------------------------------


def _event_runs(spark, d):
    """Every second with events as a version, its users as the series."""
    events = spark.read.parquet(f"{d}/events.parquet")
    version = F.concat(F.lit("v"), F.date_format("ts", "yyyyMMdd_HHmmss"))
    return events.groupBy(version.alias("version")).agg(
        F.max("ts").cast("timestamp").alias("created_at"),
        F.count_distinct("user_id").alias("n_series"),
    )


@query
def run_metadata(spark, d):
    meta = rn.run_metadata(_weights(spark, d).withColumn("version", F.lit("v20240101_000000")))
    return meta.select(
        "version",
        "series_id",
        F.array_join("selected", "+").alias("selected"),
        F.round(F.col("weights")[0], 6).alias("first_weight"),
        F.array_join("models", ",").alias("models"),
        F.array_join(F.col("mean_rmse").cast("array<string>"), ",").alias("mean_rmse"),
    )


@query
def run_manifest(spark, d):
    """Users as versions, made at their newest event: the order of names is not that of times."""
    events = spark.read.parquet(f"{d}/events.parquet")
    runs = events.groupBy(F.concat(F.lit("v"), F.col("user_id").cast("string")).alias("version")).agg(
        F.max("ts").cast("timestamp").alias("created_at"), F.count_distinct("event_type").alias("n_series")
    )
    listed = rn.run_manifest(runs)
    return listed.withColumn("created_at", F.unix_micros("created_at"))


@query
def latest_version(spark, d):
    """Days of orders are runs, days of shipping have stored tables: the newest day with both is current."""

    def version(column):
        return F.concat(F.lit("v"), F.date_format(column, "yyyyMMdd_HHmmss")).alias("version")

    orders, lines = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("orders", "lineitem"))
    runs = orders.groupBy(version("o_orderdate")).agg(F.max("o_orderdate").cast("timestamp").alias("created_at"))
    return rn.latest_version(runs, lines.select(version("l_shipdate")))


@query
def latest_per_series(spark, d):
    """Users as series, the seconds of their events as versions."""
    events = spark.read.parquet(f"{d}/events.parquet")
    version = F.concat(F.lit("v"), F.date_format("ts", "yyyyMMdd_HHmmss"))
    stored = events.select(so.series_key("user_id").alias("series_id"), version.alias("version"), "event_id")
    return rn.latest_per_series(stored)


@query
def list_series(spark, d):
    return rn.list_series(_weights(spark, d))


@query
def model_staleness(spark, d):
    runs = _event_runs(spark, d).select("version", "n_series")
    return rn.model_staleness(runs, NOW, limit_weeks=10)


# -- reports ----------------------------------------------------------------------------------


@query
def normalize_series_name(spark, d):
    return rp.find_series(_nation_panel(spark, d), "  nation_4 ")


@query
def ensemble_forecast(spark, d):
    return rounded(rp.ensemble_forecast(_forecasts(spark, d), _weights(spark, d)), 2)


@query
def forecast_bands(spark, d):
    return rp.forecast_bands(rp.ensemble_forecast(_forecasts(spark, d), _weights(spark, d)))


@query
def forecast_breakdown(spark, d):
    return rounded(rp.forecast_breakdown(_forecasts(spark, d), _weights(spark, d)), weight=8)


@query
def breakdown_table(spark, d):
    return rounded(rp.breakdown_table(_forecasts(spark, d), _weights(spark, d), STAND_INS), 2)


@query
def bootstrap_bands(spark, d):
    """Every model with one residual, its mean: all paths are the ensemble moved by the weighted means."""
    predictions = _cv_predictions(spark, d)
    mean = predictions.groupBy("series_id", "model").agg(F.avg(F.col("y_true") - F.col("yhat")).alias("y_true"))
    one = mean.withColumn("yhat", F.lit(0.0))
    return rp.bootstrap_bands(_forecasts(spark, d), _weights(spark, d), one)


@query
def forecast_kpis(spark, d):
    bands = rp.forecast_bands(rp.ensemble_forecast(_forecasts(spark, d), _weights(spark, d)))
    return rounded(rp.forecast_kpis(bands), 2)


@query
def cv_metrics(spark, d):
    return rounded(rp.cv_metrics(_cv_scores(spark, d), _weights(spark, d), "Nation_4"))


@query
def cv_metrics_summary(spark, d):
    return rp.cv_metrics_summary(_weights(spark, d), STAND_INS)


@query
def backtest_table(spark, d):
    return rounded(rp.backtest_table(_cv_predictions(spark, d), STAND_INS))


@query
def backtest_rmse(spark, d):
    return rounded(rp.backtest_rmse(_cv_predictions(spark, d), STAND_INS))


@query
def fold_boundaries(spark, d):
    return rp.fold_boundaries(_cv_predictions(spark, d))


@query
def metrics_avg(spark, d):
    return rounded(rp.metrics_avg(_cv_scores(spark, d)))


@query
def best_per_metric(spark, d):
    return rounded(rp.best_per_metric(rp.metrics_avg(_cv_scores(spark, d)), STAND_INS))


@query
def fold_rmse_trend(spark, d):
    return rounded(rp.fold_rmse_trend(_cv_scores(spark, d), STAND_INS))


@query
def metrics_leaderboard(spark, d):
    return rounded(rp.metrics_leaderboard(_cv_scores(spark, d), _weights(spark, d)))


@query
def format_magnitude_labels(spark, d):
    """Weekly totals of customers, and a thousand and a million times as much, as labels."""
    weekly = _customer_grid(spark, d)
    y = F.col("y")
    return weekly.select(
        "series_id",
        "week_end",
        format_magnitude(y).alias("as_is"),
        format_magnitude(y / 1000, 1).alias("small"),
        format_magnitude(y * 1000).alias("large"),
        format_magnitude(y * 1000000).alias("huge"),
    )


# -- stored runs ------------------------------------------------------------------------------

VERSION = "v20240101_000000"


def _stored(spark, d) -> str:
    """A run of the stand-ins, written to the shared folder."""
    root = new_table_path(spark, "run")
    predictions = _cv_predictions(spark, d)
    rn.write_run(
        root,
        VERSION,
        {
            "weights": _weights(spark, d),
            "cv_scores": sl.score_forecast(predictions),
            "cv_predictions": predictions,
            "forecasts": _forecasts(spark, d).drop("fold"),
        },
    )
    return root


@query
def write_run(spark, d):
    """All rows of the four stored tables, read back, with the values each has."""
    root = _stored(spark, d)
    parts = {
        "weights": (F.col("rank").cast("int"), F.lit(None).cast("int"), F.col("mean_rmse"), F.col("weight")),
        "cv_scores": (F.col("fold"), F.lit(None).cast("int"), F.col("rmse"), F.col("mae")),
        "cv_predictions": (F.col("fold"), F.col("h"), F.col("y_true"), F.col("yhat")),
        "forecasts": (F.lit(None).cast("int"), F.col("h"), F.col("yhat"), F.lit(None).cast("double")),
    }
    whole = None
    for table, (at, h, first, second) in parts.items():
        rows = rn.read_run(spark, root, table, VERSION).select(
            F.lit(table).alias("table_name"), "series_id", "model", at.cast("int").alias("at"),
            h.cast("int").alias("h"), F.round(first, 3).alias("first"), F.round(second, 5).alias("second"),
        )
        whole = rows if whole is None else whole.unionByName(rows)
    return whole


@query
def read_run(spark, d):
    stored = rn.read_run(spark, _stored(spark, d), "weights", VERSION, "nation_4").drop("version")
    return rounded(stored, weight=8)


# -- forecasters ------------------------------------------------------------------------------

# Few and shallow trees with the week ahead as a feature: the settings of the checks, not a default.
QUICK = BoostedParams(n_estimators=8, max_depth=3, per_horizon=False)
QUICK_SETTINGS = Settings(preprocessing=MONEY, models=ModelParams(boosted=QUICK))


@query
def gram_solve(spark, d):
    """Sums of products of 1, three lags and the value in millions, per nation and fold."""
    rows = fd.training_rows(_converted_folds(spark, d)).withColumn("y", F.col("y") / 1e6)
    lagged = rows.select("*", *ft.lag_features(FEATURES, ("series_id", "fold"))).na.drop()
    z = F.array(F.lit(1.0), *[f"lag_{k}" for k in FEATURES.lags], "y")
    sums = gram_sums(lagged.select("series_id", "fold", z.alias("z")), ("series_id", "fold"), "z", 5)
    return rounded(sums, 6)


@query
def fc_arima(spark, d):
    return arima_forecast(fd.training_rows(_nation_folds(spark, d)), 8)


@query
def arima_orders(spark, d):
    """The order chosen per nation and fold."""
    fitted = fit_arima(fd.training_rows(_nation_folds(spark, d)), 8)
    return fitted.select("series_id", "fold", "d", "order", "aic")


@query
def arima_differencing(spark, d):
    """KPSS statistics of the values and their changes, and the differencing order they give."""
    rows = differencing_order(fd.training_rows(_nation_folds(spark, d)))
    per_fold = rows.groupBy("series_id", "fold").agg(
        F.first("k0").alias("k0"), F.first("k1").alias("k1"), F.first("d").alias("d")
    )
    return rounded(per_fold, 6)


@query
def fc_additive(spark, d):
    return additive_forecast(fd.training_rows(_nation_folds(spark, d)), 8)


@query
def fc_boosted_direct(spark, d):
    return boosted_forecast(fd.training_rows(_nation_folds(spark, d)), 8, QUICK)


@query
def fc_recurrent(spark, d):
    return recurrent_forecast(fd.training_rows(_nation_folds(spark, d)), 8)


@query
def fc_recurrent_gated(spark, d):
    """The trained recurrence, with fewer units and epochs than by default."""
    p = RecurrentParams(kind="gated", units=16, epochs=4)
    return gated_forecast(fd.training_rows(_nation_folds(spark, d)), 8, p)


@query
def recurrent_epochs(spark, d):
    """An epoch learns from each window of a fold once and is measured on each that is held out."""
    p = RecurrentParams(kind="gated", units=4, epochs=2, patience=3)
    history = gated_history(fd.training_rows(_nation_folds(spark, d)), 8, p)
    finite = (F.col("validation_loss") > 0) & (F.col("validation_loss") < 1)
    return history.select("fold", "epoch", "windows", "held_out", finite.alias("sound"))


@query
def tune_boosted(spark, d):
    """Two passes of trials over the whole search ranges; only the patience is short."""
    p = replace(QUICK, n_trials=12, trials_at_once=6, first_rung=2, early_stopping_rounds=3)
    return tune_trees(_nation_folds(spark, d), 8, p)


@query
def explain_boosted(spark, d):
    """Contribution of every feature to every weekly forecast of every nation, exact for these trees."""
    rows = direct_rows(fd.full_history(_nation_panel(spark, d)), 1, FEATURES)
    return explain_forest(fit_trees(rows, QUICK, FEATURES, fd.REFIT_FOLD), rows.targets, ("series_id", "t"))


@query
def cv_run(spark, d):
    panel = write_table(_nation_panel(spark, d), "panel")
    return tr.cv_run(fd.walk_forward_folds(panel), QUICK_SETTINGS)


@query
def refit_full(spark, d):
    """The two best of the four models per nation, chosen by cross-validation."""
    panel = write_table(_nation_panel(spark, d), "panel")
    predictions = write_table(tr.cv_run(fd.walk_forward_folds(panel), QUICK_SETTINGS), "predictions")
    weights = write_table(sl.weigh_models(sl.score_forecast(predictions)), "weights")
    return tr.refit_full(panel, weights, QUICK_SETTINGS)


@query
def train_run(spark, d):
    """A whole stored run of the four models; its ensemble forecast with bands, read back."""
    root = new_table_path(spark, "run")
    tr.train_run(od.nation_sales(spark, d), root, VERSION, NOW, QUICK_SETTINGS)
    forecasts = rn.read_run(spark, root, "forecasts", VERSION)
    weights = rn.read_run(spark, root, "weights", VERSION)
    return rp.forecast_bands(rp.ensemble_forecast(forecasts, weights))


# -- forecasters whose answer has a closed form -----------------------------------------------


def _in_millions(forecast: DataFrame) -> DataFrame:
    """Numerical solvers and sums of squares differ in the last digits of large amounts."""
    return forecast.select("series_id", "fold", F.col("h").cast("int").alias("h"), F.round(F.col("yhat") / 1e6, 3).alias("yhat"))


@query
def fc_arima_one_lag(spark, d):
    """At most one lag and no differencing: least squares on the week before, or the mean."""
    p = ArimaParams(seasonal=False, max_p=1, max_q=0, max_d=0)
    return _in_millions(arima_forecast(fd.training_rows(_nation_folds(spark, d)), 8, p))


@query
def fc_additive_sparse(spark, d):
    """Changes of slope so heavily penalised that none is left: the least-squares line again."""
    p = AdditiveParams(yearly_seasonality=False, holidays=False, changepoints=25, trend_penalty=0.0, changepoint_l1=1e6)
    return _in_millions(additive_forecast(fd.training_rows(_nation_folds(spark, d)), 8, p))


@query
def arima_likelihood(spark, d):
    """The exact likelihood of a first-order autoregression with coefficient 0.6 on the standardised weeks."""
    rows = fd.training_rows(_nation_folds(spark, d))
    return rounded(arma_likelihood(rows, (0.6,), p=ArimaParams(max_d=0)), 5)


@query
def fc_arima_likelihood(spark, d):
    """Orders walked step by step up to the usual bounds and fitted by maximum likelihood."""
    p = ArimaParams(max_p=5, max_q=5, seasonal=False, stepwise=True, likelihood=True)
    return arima_forecast(fd.training_rows(_nation_folds(spark, d)), 8, p)


@query
def fc_additive_line(spark, d):
    """Neither changepoints nor seasons nor penalties: the least-squares line over time."""
    p = AdditiveParams(yearly_seasonality=False, holidays=False, changepoints=0, trend_penalty=0.0)
    return _in_millions(additive_forecast(fd.training_rows(_nation_folds(spark, d)), 8, p))


@query
def fc_recurrent_mean(spark, d):
    """So strong a ridge that only the intercepts are left: the mean scaled target of all windows."""
    p = RecurrentParams(ridge_grid=(1e15,))
    return _in_millions(recurrent_forecast(fd.training_rows(_nation_folds(spark, d)), 8, p))


@query
def fc_boosted_mean(spark, d):
    """A tree without splits: the mean of the pooled scaled targets, in the scale of the series."""
    p = BoostedParams(n_estimators=1, max_depth=0, subsample=1.0, colsample=1.0, per_horizon=False)
    return _in_millions(boosted_forecast(fd.training_rows(_nation_folds(spark, d)), 8, p))


@query
def fc_boosted_stump(spark, d):
    """One split with penalised leaves: the cut of the year, and the leaf weights, that gain most."""
    p = BoostedParams(n_estimators=1, max_depth=1, learning_rate=1.0, subsample=1.0, colsample=1.0, reg_alpha=0.5, reg_lambda=2.0)
    seasons = FeatureParams(lags=(), rolling_windows=(), time_features=("month", "quarter"), holidays=False, fourier_terms=0)
    return _in_millions(boosted_forecast(fd.training_rows(_nation_folds(spark, d)), 8, p, seasons))


@query
def explain_efficiency(spark, d):
    """What the Shapley values of a week leave of its prediction less the one with nothing known."""
    history = fd.full_history(_nation_panel(spark, d))
    rows = direct_rows(history, 1, FEATURES)
    explained = explain_forest(fit_trees(rows, QUICK, FEATURES, fd.REFIT_FOLD), rows.targets, ("series_id", "t"))
    left = F.sum("shapley") - (F.first("prediction") - F.first("base"))
    sums = explained.groupBy("series_id", "t").agg(F.count(F.lit(1)).alias("n_features"), (F.round(left, 6) + 0.0).alias("left_over"))
    return sums.withColumn("left_over", F.abs("left_over"))


def _accounted_for(predictions: DataFrame) -> DataFrame:
    """Test weeks that a model gave a finite forecast for, or a reason why not.

    Forecasts are joined by name, so a series without one keeps its weeks.
    """
    yhat = F.col("yhat")
    finite = yhat.isNotNull() & ~F.isnan(yhat) & (F.abs(yhat) != float("inf"))
    reason = yhat.isNull() & F.col("error").isNotNull()
    return predictions.where(finite | reason | F.col("series_id").isNull())


@query
def cv_run_customers(spark, d):
    """The forecasters on the customers, some of them without any value: every test week of every model.

    A week that a model neither forecast nor said why is missing here.
    """
    panel = write_table(_customer_panel(spark, d), "panel")
    rows = _accounted_for(tr.cv_run(fd.walk_forward_folds(panel), QUICK_SETTINGS))
    # In another currency, as imputed values may be exact halves of the last digit.
    return rounded(rows.select("series_id", "fold", "h", "ds", "model", (F.col("y_true") * RATE).alias("y_true")))


@query
def train_run_weights(spark, d):
    """Of a stored run of customers: ranks, choices and weights agree with the stored predictions."""
    root = new_table_path(spark, "run")
    tr.train_run(od.customer_sales(spark, d), root, VERSION, NOW, QUICK_SETTINGS)
    stored = rn.read_run(spark, root, "weights", VERSION).drop("version")
    again = sl.weigh_models(sl.score_forecast(rn.read_run(spark, root, "cv_predictions", VERSION)))
    same = stored.join(
        again.select("series_id", "model", F.col("rank").alias("r"), F.col("weight").alias("w")), ["series_id", "model"]
    )
    weight = F.col("weight")
    return same.groupBy("series_id").agg(
        F.count(F.lit(1)).alias("n_models"),
        F.round(F.sum(weight), 6).alias("total"),
        F.count_if((F.col("rank") == F.col("r")) & (F.coalesce(F.abs(weight - F.col("w")), F.lit(0.0)) < 1e-9)).alias("n_same"),
    )
