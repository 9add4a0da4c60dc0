"""Walk-forward folds as rows ``(series_id, fold, role, week_end, t, y)``.

Fold membership follows from the position of a week alone, so each row emits the folds it belongs
to: no join with a fold table, and no shuffle beyond the panel's own by series.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weekloom.operators.panel import iqr_cap
from weekloom.params import FoldParams

# The pseudo-fold that trains on the full history.
REFIT_FOLD = -1


def _int_floor(numerator: Column, divisor: int) -> Column:
    return F.floor(numerator / F.lit(divisor)).cast("int")


def fold_count(n_weeks: Column, p: FoldParams) -> Column:
    spare = n_weeks - (p.initial_train_weeks + p.horizon)
    most = _int_floor(spare, p.step) + 1
    return F.when(spare < 0, 0).otherwise(most if p.max_folds is None else F.least(F.lit(p.max_folds), most))


def _first_split(n_weeks: Column, n_folds: Column, p: FoldParams) -> Column:
    if p.anchor == "start":
        return F.lit(p.initial_train_weeks)
    return n_weeks - p.horizon - (n_folds - 1) * p.step


def with_fold_count(panel: DataFrame, p: FoldParams = FoldParams()) -> DataFrame:
    n_weeks = F.count("*").over(Window.partitionBy("series_id")).cast("int")
    counted = panel.withColumn("n_weeks", n_weeks)
    return counted.withColumn("n_folds", fold_count(F.col("n_weeks"), p))


def walk_forward_folds(panel: DataFrame, p: FoldParams = FoldParams()) -> DataFrame:
    """Expanding train rows and the next ``horizon`` test rows of each fold of each series.

    Series with fewer than ``min_folds`` folds and series without any value are absent;
    ``skipped_series`` lists them.
    """
    t, n_folds = F.col("t"), F.col("n_folds")
    base = _first_split(F.col("n_weeks"), n_folds, p)
    # Fold f tests [base + f*step, base + f*step + horizon) and trains on everything before.
    lowest = F.greatest(F.lit(0), _int_floor(t - base - p.horizon, p.step) + 1)
    n_values = F.count("y").over(Window.partitionBy("series_id"))
    counted = with_fold_count(panel, p).withColumn("_n_values", n_values)
    usable = counted.where((n_folds >= p.min_folds) & (F.col("_n_values") > 0))
    member = usable.withColumn("_low", lowest).where(F.col("_low") < n_folds)
    rows = member.withColumn("fold", F.explode(F.sequence("_low", n_folds - 1)))
    role = F.when(t < base + F.col("fold") * p.step, F.lit("train")).otherwise(F.lit("test"))
    return rows.select("series_id", "fold", role.alias("role"), "week_end", "t", "y")


def skipped_series(panel: DataFrame, p: FoldParams = FoldParams()) -> DataFrame:
    """Series too short for ``min_folds`` folds or without any value, with the reason."""
    counts = panel.groupBy("series_id").agg(
        F.count("*").cast("int").alias("n_weeks"), F.count("y").alias("_n_values")
    )
    counted = counts.withColumn("n_folds", fold_count(F.col("n_weeks"), p))
    short = F.col("n_folds") < p.min_folds
    length = F.format_string(
        f"series of %d weeks gives %d folds, {p.min_folds} needed", "n_weeks", "n_folds"
    )
    reason = F.when(short, length).otherwise("series has no values")
    left_out = counted.where(short | (F.col("_n_values") == 0)).withColumn("error", reason)
    return left_out.drop("_n_values")


def leaking_folds(folds: DataFrame) -> DataFrame:
    """Folds whose first test week is not after their last train week; must be empty."""
    spans = folds.groupBy("series_id", "fold").agg(
        F.max(F.when(F.col("role") == "train", F.col("week_end"))).alias("last_train"),
        F.min(F.when(F.col("role") == "test", F.col("week_end"))).alias("first_test"),
    )
    return spans.where(F.col("first_test") <= F.col("last_train"))


def fold_scoped_cap(folds: DataFrame, k: float = 3.0) -> DataFrame:
    """Cap each fold by bounds from its own train rows; test rows keep their true values."""
    train = F.col("role") == "train"
    capped = iqr_cap(folds.withColumn("_y", F.col("y")), k, ("series_id", "fold"), train)
    return capped.withColumn("y", F.when(train, F.col("y")).otherwise(F.col("_y"))).drop("_y")


def training_rows(folds: DataFrame) -> DataFrame:
    return folds.where(F.col("role") == "train").drop("role")


def full_history(panel: DataFrame) -> DataFrame:
    """Training rows of the refit: every week of every series, under ``REFIT_FOLD``."""
    return panel.select("series_id", F.lit(REFIT_FOLD).alias("fold"), "week_end", "t", "y")
