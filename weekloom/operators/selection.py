"""Scoring, ranking, choosing and weighting models per series.

Tables: ``predictions(series_id, fold, h, ds, model, y_true, yhat)``,
``scores(series_id, model, fold, rmse, mae, mape, smape)`` and
``weights(series_id, model, mean_rmse, rank, selected, weight)``. A forecast, score or mean that is
not available is NULL, never infinite.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weekloom.functions.metrics import METRICS, all_metrics
from weekloom.params import MODEL_ORDER, EnsembleParams


def model_ordinal(models: Sequence[str], column: str = "model") -> Column:
    """Place of a model in the declared order: the tie-break of every ranking."""
    return F.array_position(F.array(*[F.lit(m) for m in models]), F.col(column))


def complete_predictions(
    folds: DataFrame, forecasts: DataFrame, models: Sequence[str] = MODEL_ORDER
) -> DataFrame:
    """Join forecasts ``(series_id, fold, model, h, yhat)`` to the test weeks of every fold.

    Each test week emits one row per model, so a model that failed shows as NULL ``yhat`` and the
    others go on. Forecasts with an ``error`` column hand its text on.
    """
    test = folds.where(F.col("role") == "test")
    start = F.min("t").over(Window.partitionBy("series_id", "fold"))
    grid = test.select(
        "series_id",
        "fold",
        (F.col("t") - start + 1).cast("int").alias("h"),
        F.col("week_end").alias("ds"),
        F.explode(F.array(*[F.lit(m) for m in models])).alias("model"),
        F.col("y").alias("y_true"),
    )
    reason = [c for c in forecasts.columns if c == "error"]
    found = forecasts.select("series_id", "fold", "h", "model", "yhat", *reason)
    return grid.join(found, ["series_id", "fold", "h", "model"], "left").select(
        "series_id", "fold", "h", "ds", "model", "y_true", "yhat", *reason
    )


def score_forecast(predictions: DataFrame) -> DataFrame:
    """All four metrics per series, model and fold; NULL where any week has no forecast.

    Predictions with an ``error`` column give the reason of a missing score.
    """
    whole = F.count("yhat") == F.count("*")
    metrics = all_metrics(F.col("y_true"), F.col("yhat"))
    reason = [F.max(c).alias("_error") for c in predictions.columns if c == "error"]
    scored = predictions.groupBy("series_id", "model", "fold").agg(whole.alias("_whole"), *metrics, *reason)
    kept = [F.when(F.col("_whole"), F.col(m)).alias(m) for m in METRICS]
    if reason:
        text = F.coalesce("_error", F.lit("too short for the model, or without a finite fit"))
        kept.append(F.when(F.col("rmse").isNull() | ~F.col("_whole"), text).alias("error"))
    return scored.select("series_id", "model", "fold", *kept)


def failed_folds(predictions: DataFrame) -> DataFrame:
    """Folds a model gave no full forecast for."""
    return (
        predictions.groupBy("series_id", "model", "fold")
        .agg(F.count_if(F.col("yhat").isNull()).alias("n_missing"))
        .where("n_missing > 0")
    )


def mean_cv_rmse(scores: DataFrame) -> DataFrame:
    """Mean fold RMSE per model; a single failed fold makes the model unavailable (NULL)."""
    complete = F.count("rmse") == F.count("*")
    return scores.groupBy("series_id", "model").agg(
        F.when(complete, F.avg("rmse")).alias("mean_rmse"), F.count("*").alias("n_folds")
    )


def rank_models(means: DataFrame, models: Sequence[str] = MODEL_ORDER) -> DataFrame:
    best_first = Window.partitionBy("series_id").orderBy(
        F.col("mean_rmse").asc_nulls_last(), model_ordinal(models)
    )
    return means.withColumn("rank", F.row_number().over(best_first))


def select_top_k(ranked: DataFrame, k: int = 2) -> DataFrame:
    """Flag the first k models that have a mean; the rest stay for the reports."""
    chosen = (F.col("rank") <= k) & F.col("mean_rmse").isNotNull()
    return ranked.withColumn("selected", chosen)


def ensemble_weights(selection: DataFrame, weighting: str = "inverse_rmse") -> DataFrame:
    """Weights over the selected models of a series, summing to 1; NULL for the others."""
    raw = F.lit(1.0)
    if weighting == "inverse_rmse":
        raw = 1 / F.greatest(F.col("mean_rmse"), F.lit(1e-10))
    share = F.when(F.col("selected"), raw)
    return selection.withColumn("weight", share / F.sum(share).over(Window.partitionBy("series_id")))


def weigh_models(
    scores: DataFrame, p: EnsembleParams = EnsembleParams(), models: Sequence[str] = MODEL_ORDER
) -> DataFrame:
    """From fold scores to the ``weights`` table."""
    ranked = rank_models(mean_cv_rmse(scores), models)
    return ensemble_weights(select_top_k(ranked, p.top_k), p.weighting)


def unusable_series(weights: DataFrame) -> DataFrame:
    """Series for which every model failed, in the shape of the skipped series."""
    return (
        weights.groupBy("series_id")
        .agg(F.count_if("selected").alias("_n"))
        .where("_n = 0")
        .select("series_id", F.lit("no model gave a forecast for every fold").alias("error"))
    )


def fold0_overfit_check(scores: DataFrame, model: str = "boosted", factor: float = 2.0) -> DataFrame:
    """Series whose first-fold RMSE exceeds ``factor`` times the mean of the other folds."""
    first = F.max(F.when(F.col("fold") == 0, F.col("rmse")))
    others = F.avg(F.when(F.col("fold") > 0, F.col("rmse")))
    return (
        scores.where(F.col("model") == model)
        .groupBy("series_id")
        .agg(first.alias("fold0_rmse"), others.alias("other_mean"))
        .where((F.col("other_mean") > 0) & (F.col("fold0_rmse") > factor * F.col("other_mean")))
    )


def clip_sampling_params(trials: DataFrame, low: float = 0.3, high: float = 1.0) -> DataFrame:
    """Clip tuned row and column sampling shares to a safe range."""
    clipped = {
        c: F.greatest(F.lit(low), F.least(F.lit(high), F.col(c))) for c in ("subsample", "colsample")
    }
    return trials.withColumns(clipped)


def check_series(panel: DataFrame, names: Sequence[str]) -> None:
    """A name that is not in the panel is an error; the filter on the names reaches the scan."""
    found = {r.series_id for r in named_series(panel, names).select("series_id").distinct().collect()}
    missing = sorted(set(names) - found)
    if missing:
        raise ValueError(f"unknown series: {missing}")


def named_series(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Rows of the named series: a literal filter that reaches the scan, before any shuffle."""
    return df.where(F.col("series_id").isin(list(names)))


def train_subset(panel: DataFrame, names: Sequence[str]) -> DataFrame:
    """The named series of a stored panel only; a name that is not in it is an error."""
    check_series(panel, names)
    return named_series(panel, names)


def run_summary(
    weights: DataFrame, skipped: DataFrame, models: Sequence[str] = MODEL_ORDER
) -> DataFrame:
    """One row per series: chosen models, their weights, mean RMSE of each model, or the reason."""
    chosen = F.array_sort(
        F.collect_list(
            F.when(F.col("selected"), F.struct("rank", "model", F.round("weight", 2).alias("w")))
        )
    )
    means = [F.max(F.when(F.col("model") == m, F.col("mean_rmse"))).alias(f"rmse_{m}") for m in models]
    per_series = weights.groupBy("series_id").agg(
        chosen.alias("_c"), *means, F.max("n_folds").cast("int").alias("n_folds")
    )
    weight_text = F.transform("_c", lambda c: F.format_string("%.2f", c["w"]))
    trained = per_series.select(
        "series_id",
        F.array_join("_c.model", "+").alias("selected"),
        F.array_join(weight_text, " / ").alias("weights"),
        *[f"rmse_{m}" for m in models],
        "n_folds",
    )
    left_out = skipped.select("series_id", "n_folds", "error")
    return trained.unionByName(left_out, allowMissingColumns=True)


