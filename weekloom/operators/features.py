"""The supervised feature matrix and its targets.

All features of a row look only backwards, so they are computed once per series and shared by all
folds: the lags of a test row reach into the training tail by themselves. Lags and rolling statistics
use one window partitioning and order, hence one sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weekloom.functions.calendar import WEEKS_PER_YEAR, fourier_pair, holiday_flag, iso_week
from weekloom.params import FeatureParams, FoldParams

_TIME_FEATURES = {
    "week_of_year": iso_week,
    "month": F.month,
    "quarter": F.quarter,
    "year": F.year,
}


def feature_names(p: FeatureParams = FeatureParams()) -> list[str]:
    names = [f"lag_{k}" for k in p.lags]
    names += [f"rolling_{stat}_{n}" for n in p.rolling_windows for stat in p.rolling_stats]
    names += list(p.time_features)
    names += ["holiday"] if p.holidays else []
    names += [f"fourier_{fn}_{k}" for k in range(1, p.fourier_terms + 1) for fn in ("sin", "cos")]
    return names


def level_feature_names(p: FeatureParams = FeatureParams()) -> list[str]:
    """Features that scale with the target."""
    return [n for n in feature_names(p) if n.startswith(("lag_", "rolling_"))]


def lag_features(p: FeatureParams, keys: tuple[str, ...] = ("series_id",)) -> list[Column]:
    w = Window.partitionBy(*keys).orderBy("week_end")
    return [F.lag("y", k).over(w).alias(f"lag_{k}") for k in p.lags]


def rolling_features(p: FeatureParams, keys: tuple[str, ...] = ("series_id",)) -> list[Column]:
    """Mean and sample deviation of the last n weeks with the current one; NULL until n exist."""
    functions = {"mean": F.avg, "std": F.stddev_samp}
    columns = []
    for n in p.rolling_windows:
        frame = Window.partitionBy(*keys).orderBy("week_end").rowsBetween(-(n - 1), 0)
        full = F.count("y").over(frame) == n
        for stat in p.rolling_stats:
            value = functions[stat]("y").over(frame)
            columns.append(F.when(full, value).alias(f"rolling_{stat}_{n}"))
    return columns


def calendar_features(p: FeatureParams) -> list[Column]:
    return [_TIME_FEATURES[name](F.col("week_end")).alias(name) for name in p.time_features]


def fourier_features(p: FeatureParams) -> list[Column]:
    columns = []
    for k in range(1, p.fourier_terms + 1):
        sine, cosine = fourier_pair(iso_week(F.col("week_end")), k, WEEKS_PER_YEAR)
        columns += [sine.alias(f"fourier_sin_{k}"), cosine.alias(f"fourier_cos_{k}")]
    return columns


def feature_matrix(
    panel: DataFrame, p: FeatureParams = FeatureParams(), keys: tuple[str, ...] = ("series_id",)
) -> DataFrame:
    """The panel's columns and all features, in the order of ``feature_names``."""
    holiday = [holiday_flag(F.col("week_end")).alias("holiday")] if p.holidays else []
    return panel.select(
        *panel.columns,
        *lag_features(p, keys),
        *rolling_features(p, keys),
        *calendar_features(p),
        *holiday,
        *fourier_features(p),
    )


def drop_warmup(features: DataFrame, p: FeatureParams = FeatureParams()) -> DataFrame:
    """Leave out rows that lack a feature; the target stays in the row, so nothing to realign."""
    return features.na.drop(subset=feature_names(p))


def feature_null_audit(features: DataFrame, p: FeatureParams = FeatureParams()) -> DataFrame:
    """Rows ``(feature, n_null)`` over all rows, counted in one pass."""
    names = feature_names(p)
    counts = features.agg(*[F.count_if(F.col(n).isNull()).alias(n) for n in names])
    pairs = ", ".join(f"'{n}', `{n}`" for n in names)
    return counts.selectExpr(f"stack({len(names)}, {pairs}) AS (feature, n_null)")


def tail_transform(
    panel: DataFrame, folds: FoldParams = FoldParams(), p: FeatureParams = FeatureParams()
) -> DataFrame:
    """Features of the test rows of every fold, with the training tail before them."""
    from weekloom.operators.folds import walk_forward_folds

    featured = feature_matrix(panel, p)
    extra = [c for c in featured.columns if c not in panel.columns]
    packed = featured.select("series_id", "week_end", "t", F.struct("y", *extra).alias("y"))
    rows = walk_forward_folds(packed, folds).where(F.col("role") == "test")
    return rows.select("series_id", "fold", "week_end", "t", "y.*")


def direct_targets(
    features: DataFrame, horizon: int, keys: tuple[str, ...] = ("series_id",)
) -> DataFrame:
    """Long rows ``(..., h, target)`` that pair a row with the value h weeks later, h = 1..horizon.

    Rows whose target lies outside the partition are left out. The values ahead come from one frame
    over the series, then each row emits its targets.
    """
    ahead = Window.partitionBy(*keys).orderBy("week_end").rowsBetween(1, horizon)
    packed = features.withColumn("_ahead", F.collect_list("y").over(ahead))
    long = packed.select(*features.columns, F.posexplode("_ahead").alias("_pos", "target"))
    return long.select(*features.columns, (F.col("_pos") + 1).alias("h"), "target")


def last_feature_row(features: DataFrame, keys: tuple[str, ...] = ("series_id",)) -> DataFrame:
    """The newest row per series (and fold); combines on the map side."""
    rest = [c for c in features.columns if c not in keys]
    newest = features.groupBy(*keys).agg(F.max_by(F.struct(*rest), "week_end").alias("_row"))
    return newest.select(*keys, "_row.*")


def future_calendar(
    panel: DataFrame, horizon: int, keys: tuple[str, ...] = ("series_id",)
) -> DataFrame:
    """The next ``horizon`` week ends after the last one: rows ``(keys, h, ds)``."""
    last = panel.groupBy(*keys).agg(F.max("week_end").alias("_last"))
    return last.select(*keys, *future_weeks(F.col("_last"), horizon))


def future_weeks(last: Column, horizon: int) -> list[Column]:
    """Generator for ``h`` and ``ds`` after a last week."""
    weeks = F.transform(
        F.sequence(F.lit(1), F.lit(horizon)),
        lambda h: F.struct(h.alias("h"), F.date_add(last, h * 7).alias("ds")),
    )
    return [F.inline(weeks)]
