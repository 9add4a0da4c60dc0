"""Cross-validate, select, refit and store a run.

Stages that several later steps read (panel, fold predictions, weights) are written tables: a lost
executor costs its own tasks, not the stages before, and each reader gets true sizes.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekloom.forecasters.boosted import best_params, tune_boosted
from weekloom.forecasters.registry import FORECASTERS
from weekloom.operators.features import future_calendar
from weekloom.operators.folds import (
    fold_scoped_cap,
    full_history,
    skipped_series,
    training_rows,
    walk_forward_folds,
)
from weekloom.operators.panel import impute_residual_check, iqr_cap, prepare_panel
from weekloom.operators.selection import (
    check_series,
    complete_predictions,
    fold0_overfit_check,
    named_series,
    run_summary,
    score_forecast,
    unusable_series,
    weigh_models,
)
from weekloom.params import MODEL_ORDER, Settings
from weekloom.session import stage_folder, write_table
from weekloom.sources.runs import append_manifest, run_metadata, write_run

# Forecasters that learn each series on its own; the others pool all series.
LOCAL_MODELS = ("arima", "additive")


def forecast_all(
    train: DataFrame, horizon: int, settings: Settings, models: Sequence[str] = MODEL_ORDER
) -> DataFrame:
    """``(series_id, fold, h, model, yhat, error)`` of all models; a model may leave ``error`` out."""
    whole = None
    for m in models:
        part = FORECASTERS[m](train, horizon, settings).withColumn("model", F.lit(m))
        if "error" not in part.columns:
            part = part.withColumn("error", F.lit(None).cast("string"))
        part = part.select("series_id", "fold", F.col("h").cast("int").alias("h"), "model", "yhat", "error")
        whole = part if whole is None else whole.unionByName(part)
    return whole


def cv_run(
    folds: DataFrame, settings: Settings = Settings(), models: Sequence[str] = MODEL_ORDER
) -> DataFrame:
    """Every model on every fold of every series, next to the actual values."""
    forecasts = forecast_all(training_rows(folds), settings.cv.horizon, settings, models)
    return complete_predictions(folds, forecasts, models)


def refit_full(
    panel: DataFrame,
    weights: DataFrame,
    settings: Settings = Settings(),
    models: Sequence[str] = MODEL_ORDER,
) -> DataFrame:
    """Forecasts ``(series_id, model, h, ds, yhat)`` of the selected models from the full history.

    A model that learns each series on its own is fitted only where it was selected; a pooled one
    learns from all series and forecasts where it was selected. A model that fails gives no rows.
    """
    horizon = settings.cv.horizon
    chosen = weights.where("selected").select("series_id", "model")
    history = full_history(panel)
    parts = []
    for m in models:
        mine = chosen.where(F.col("model") == m).select("series_id")
        if m not in LOCAL_MODELS and not mine.take(1):
            continue  # a pooled model that no series selected is not worth a fit
        train = history.join(mine, "series_id", "left_semi") if m in LOCAL_MODELS else history
        forecast = forecast_all(train, horizon, settings, (m,))
        parts.append(forecast.join(mine, "series_id", "left_semi") if m not in LOCAL_MODELS else forecast)
    if not parts:
        parts = [forecast_all(history.limit(0), horizon, settings, LOCAL_MODELS[:1])]
    whole = parts[0].where("yhat IS NOT NULL")
    for part in parts[1:]:
        whole = whole.unionByName(part.where("yhat IS NOT NULL"))
    weeks = future_calendar(panel, horizon)
    return whole.join(weeks, ["series_id", "h"]).select("series_id", "model", "h", "ds", "yhat")


def train_run(
    sales: DataFrame,
    root: str,
    version: str,
    created_at: datetime,
    settings: Settings = Settings(),
    names: Sequence[str] | None = None,
    models: Sequence[str] = MODEL_ORDER,
    tune: bool = False,
) -> None:
    """Sales to a stored run; ``tune`` searches the boosted trees' parameters on fold 0 first.

    The tables of intermediate stages lie in one folder that is removed at the end.
    """
    with stage_folder(sales.sparkSession):
        _train_run(sales, root, version, created_at, settings, names, models, tune)


def _train_run(sales, root, version, created_at, settings, names, models, tune) -> None:
    sales = named_series(sales, names) if names else sales
    by_fold = settings.preprocessing.fit_scope == "fold"
    panel = write_table(prepare_panel(sales, settings.preprocessing, cap=not by_fold), "panel")
    if names:
        check_series(panel, names)
    unfilled = impute_residual_check(panel)
    folds = walk_forward_folds(panel, settings.cv)
    if by_fold and settings.preprocessing.outlier_strategy == "cap":
        folds = fold_scoped_cap(folds, settings.preprocessing.iqr_multiplier)
        panel = write_table(iqr_cap(panel, settings.preprocessing.iqr_multiplier), "panel-capped")
    tables = {}
    if tune and "boosted" in models:
        boosted = settings.models.boosted
        trials = tune_boosted(folds, settings.cv.horizon, boosted, settings.features)
        tables["tuning"] = trials
        settings = replace(settings, models=replace(settings.models, boosted=best_params(trials, boosted)))
    predictions = write_table(cv_run(folds, settings, models), "cv-predictions")
    scores = write_table(score_forecast(predictions), "cv-scores")
    weights = write_table(weigh_models(scores, settings.ensemble, models), "weights")
    skipped = skipped_series(panel, settings.cv).unionByName(
        unusable_series(weights), allowMissingColumns=True
    )
    forecasts = write_table(refit_full(panel, weights, settings, models), "forecasts")
    tables |= {
        "weights": weights,
        "cv_scores": scores,
        "cv_predictions": predictions,
        "forecasts": forecasts,
        "skipped": skipped,
        "summary": run_summary(weights, skipped, models),
        "metadata": run_metadata(weights.withColumn("version", F.lit(version))).drop("version"),
        "unfilled": unfilled,
    }
    if "boosted" in models:
        tables["overfit"] = fold0_overfit_check(scores)
    write_run(root, version, tables)
    append_manifest(root, version, created_at, panel.agg(F.count_distinct("series_id").alias("n_series")))
