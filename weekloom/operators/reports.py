"""Forecast, metric and backtest tables read from stored runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weekloom.functions.metrics import METRICS
from weekloom.functions.text import normalized_name
from weekloom.operators.selection import model_ordinal
from weekloom.params import MODEL_ORDER, ForecastParams


def find_series(df: DataFrame, name: str) -> DataFrame:
    """Rows of one series, whatever the case and outer blanks of the request.

    Stored tables carry the normalised name as a column, so that the filter reaches the scan.
    """
    key = F.col("series_key") if "series_key" in df.columns else normalized_name(F.col("series_id"))
    return df.where(key == normalized_name(F.lit(name)))


def _per_model(column: str, models: Sequence[str]) -> list[Column]:
    """Wide columns, one per model: a pivot with a known list is a set of conditional maxima."""
    return [F.max(F.when(F.col("model") == m, F.col(column))).alias(m) for m in models]


def _check_horizon(horizon: int | None, trained: int) -> int:
    if horizon is None:
        return trained
    if not 1 <= horizon <= trained:
        raise ValueError(f"horizon must be between 1 and the trained {trained} weeks, got {horizon}")
    return horizon


def ensemble_forecast(
    forecasts: DataFrame, weights: DataFrame, horizon: int | None = None, trained_horizon: int = 8
) -> DataFrame:
    """Weighted sum of the selected models per week: ``(series_id, h, ds, yhat, sigma)``.

    ``sigma`` is the weighted mean CV RMSE of the selected models. A selected model without a
    forecast drops out and the weights of the others are scaled back to 1.
    """
    steps = _check_horizon(horizon, trained_horizon)
    chosen = weights.where("selected").select("series_id", "model", "mean_rmse", "weight")
    usable = forecasts.where((F.col("h") <= steps) & F.col("yhat").isNotNull())
    total = F.sum("weight")
    return (
        usable.join(chosen, ["series_id", "model"])
        .groupBy("series_id", "h", "ds")
        .agg(
            (F.sum(F.col("weight") * F.col("yhat")) / total).alias("yhat"),
            (F.sum(F.col("weight") * F.col("mean_rmse")) / total).alias("sigma"),
        )
    )


def forecast_bands(ensemble: DataFrame, z: float = 1.96) -> DataFrame:
    """Forecast points with a band of z * sigma * sqrt(h) to each side, 2 decimals."""
    width = F.lit(z) * F.col("sigma") * F.sqrt(F.col("h"))
    return ensemble.select(
        "series_id",
        "h",
        "ds",
        F.round("yhat", 2).alias("yhat"),
        F.round(F.col("yhat") - width, 2).alias("yhat_lower"),
        F.round(F.col("yhat") + width, 2).alias("yhat_upper"),
    )


def bootstrap_bands(
    forecasts: DataFrame,
    weights: DataFrame,
    predictions: DataFrame,
    share: float = 0.9,
    paths: int = 1000,
    seed: int = 42,
) -> DataFrame:
    """Forecast points with bands of the middle ``share`` of ``paths`` paths, 2 decimals.

    On a path each selected model's forecast of a week is moved by one of the residuals it had in
    cross-validation of that series, drawn by a hash of series, model, week, path and seed: the same on every
    run and on every task. Paths are arrays inside the row of a week, bounded by ``paths``, and are never shuffled.
    A selected model without a forecast or without a residual drops out, as in ``ensemble_forecast``.
    """
    chosen = weights.where("selected").select("series_id", "model", "weight")
    missed = predictions.select("series_id", "model", (F.col("y_true") - F.col("yhat")).alias("e")).where("e IS NOT NULL")
    # Sorted, so that the draws do not depend on the order in which the rows came.
    residuals = missed.groupBy("series_id", "model").agg(F.array_sort(F.collect_list("e")).alias("e"))
    usable = forecasts.where(F.col("yhat").isNotNull()).join(chosen, ["series_id", "model"]).join(residuals, ["series_id", "model"])
    parts = F.array_sort(F.collect_list(F.struct("model", "weight", "yhat", "e")))
    weeks = usable.groupBy("series_id", "h", "ds").agg(parts.alias("_m"), F.sum("weight").alias("_w"))

    def path(number: Column) -> Column:
        def moved(total: Column, m: Column) -> Column:
            draw = F.pmod(F.xxhash64("series_id", m["model"], "h", number, F.lit(seed)), F.size(m["e"]))
            return total + m["weight"] * (m["yhat"] + F.get(m["e"], draw.cast("int")))

        return F.aggregate("_m", F.lit(0.0), moved) / F.col("_w")

    drawn = weeks.withColumns(
        {
            "yhat": F.aggregate("_m", F.lit(0.0), lambda total, m: total + m["weight"] * m["yhat"]) / F.col("_w"),
            "_p": F.array_sort(F.transform(F.sequence(F.lit(1), F.lit(paths)), path)),
        }
    )

    def percentile(q: float) -> Column:
        place = q * (paths - 1)
        low = int(place)
        a, b = F.get("_p", F.lit(low)), F.get("_p", F.lit(min(low + 1, paths - 1)))
        return a + (place - low) * (b - a)

    return drawn.select(
        "series_id",
        "h",
        "ds",
        F.round("yhat", 2).alias("yhat"),
        F.round(percentile((1 - share) / 2), 2).alias("yhat_lower"),
        F.round(percentile((1 + share) / 2), 2).alias("yhat_upper"),
    )


def banded_forecast(forecasts: DataFrame, weights: DataFrame, predictions: DataFrame, p: ForecastParams = ForecastParams()) -> DataFrame:
    """The ensemble with the kind of band the settings name."""
    if p.band == "bootstrap":
        return bootstrap_bands(forecasts, weights, predictions, p.band_share, p.paths, p.seed)
    return forecast_bands(ensemble_forecast(forecasts, weights, trained_horizon=p.horizon_weeks), p.z)


def forecast_breakdown(forecasts: DataFrame, weights: DataFrame) -> DataFrame:
    """Forecast of each selected model by week, with its weight."""
    chosen = weights.where("selected").select("series_id", "model", "weight")
    return forecasts.join(chosen, ["series_id", "model"]).select(
        "series_id", "model", "weight", "h", "ds", F.round("yhat", 2).alias("yhat")
    )


def breakdown_table(
    forecasts: DataFrame, weights: DataFrame, models: Sequence[str] = MODEL_ORDER
) -> DataFrame:
    """Week by week: one column per model and the ensemble; one join, one aggregation."""
    chosen = weights.where("selected").select("series_id", "model", "weight")
    share = F.when(F.col("yhat").isNotNull(), F.col("weight"))
    return (
        forecasts.join(chosen, ["series_id", "model"])
        .groupBy("series_id", "h", "ds")
        .agg(
            *_per_model("yhat", models),
            (F.sum(share * F.col("yhat")) / F.sum(share)).alias("ensemble"),
        )
    )


def forecast_kpis(bands: DataFrame, weeks: Sequence[int] = (1, 4, 8)) -> DataFrame:
    """Forecast and band at chosen weeks ahead, and the band width at the last of them."""

    def at(column: str, h: int) -> Column:
        return F.max(F.when(F.col("h") == h, F.col(column)))

    columns = []
    for h in weeks:
        columns += [at(c, h).alias(f"week{h}_{c}") for c in ("yhat", "yhat_lower", "yhat_upper")]
    end = weeks[-1]
    width = at("yhat_upper", end) - at("yhat_lower", end)
    return bands.groupBy("series_id").agg(*columns, width.alias(f"week{end}_width"))


def cv_metrics(scores: DataFrame, weights: DataFrame, series: str | None = None) -> DataFrame:
    """Mean RMSE and the metrics of each fold per model, for one series or all."""
    if series is not None:
        scores, weights = find_series(scores, series), find_series(weights, series)
    means = weights.select("series_id", "model", "mean_rmse")
    return scores.join(means, ["series_id", "model"]).select(
        "series_id", "model", "mean_rmse", "fold", *METRICS
    )


def cv_metrics_summary(weights: DataFrame, models: Sequence[str] = MODEL_ORDER) -> DataFrame:
    """Series by models: mean RMSE, rounded to whole units."""
    rounded = weights.withColumn("mean_rmse", F.round("mean_rmse").cast("bigint"))
    return rounded.groupBy("series_id").agg(*_per_model("mean_rmse", models))


def backtest_table(predictions: DataFrame, models: Sequence[str] = MODEL_ORDER) -> DataFrame:
    """One row per test week of each fold. Test windows overlap, so the key is (series, fold, h)."""
    return predictions.groupBy("series_id", "fold", "h").agg(
        F.max("ds").alias("ds"), F.max("y_true").alias("y_true"), *_per_model("yhat", models)
    )


def backtest_rmse(predictions: DataFrame, models: Sequence[str] = MODEL_ORDER) -> DataFrame:
    """RMSE over all backtest rows pooled, missing forecasts left out, the best model flagged."""
    error = F.col("yhat") - F.col("y_true")
    pooled = predictions.groupBy("series_id", "model").agg(
        F.sqrt(F.avg(error * error)).alias("rmse"), F.count(error).alias("n_rows")
    )
    best_first = Window.partitionBy("series_id").orderBy(
        F.col("rmse").asc_nulls_last(), model_ordinal(models)
    )
    best = (F.row_number().over(best_first) == 1) & F.col("rmse").isNotNull()
    return pooled.withColumn("is_best", best)


def fold_boundaries(predictions: DataFrame) -> DataFrame:
    """First test week of each fold after the first."""
    return (
        predictions.where("fold > 0").groupBy("series_id", "fold").agg(F.min("ds").alias("boundary"))
    )


def metrics_avg(scores: DataFrame) -> DataFrame:
    """Average of each metric over the folds that have it."""
    finite = {m: F.when(F.abs(F.col(m)) < float("inf"), F.col(m)) for m in METRICS}
    return scores.groupBy("series_id", "model").agg(*[F.avg(c).alias(m) for m, c in finite.items()])


def best_per_metric(averages: DataFrame, models: Sequence[str] = MODEL_ORDER) -> DataFrame:
    """The model with the lowest average per metric; the earlier declared one wins a tie."""
    pairs = ", ".join(f"'{m}', {m}" for m in METRICS)
    long = averages.selectExpr(
        "series_id", "model", f"stack({len(METRICS)}, {pairs}) AS (metric, value)"
    )
    best_first = Window.partitionBy("series_id", "metric").orderBy(
        F.col("value").asc_nulls_last(), model_ordinal(models)
    )
    return (
        long.withColumn("_rn", F.row_number().over(best_first))
        .where("_rn = 1")
        .select("series_id", "metric", "model", "value")
    )


def fold_rmse_trend(scores: DataFrame, models: Sequence[str] = MODEL_ORDER) -> DataFrame:
    """Folds by models: RMSE."""
    return scores.groupBy("series_id", "fold").agg(*_per_model("rmse", models))


def metrics_leaderboard(scores: DataFrame, weights: DataFrame) -> DataFrame:
    """Models of a series in rank order with averaged metrics and the in-ensemble flag."""
    averages = metrics_avg(scores)
    ranks = weights.select(
        "series_id", "model", "rank", "mean_rmse", F.col("selected").alias("in_ensemble")
    )
    return ranks.join(averages, ["series_id", "model"], "left")
