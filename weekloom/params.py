"""Every tunable value, as frozen dataclasses with the default run's settings.

``Settings.from_mapping`` accepts a nested mapping with the sections ``data``, ``preprocessing``,
``features``, ``cv``, ``models``, ``ensemble`` and ``forecast``; unknown keys raise, so that a
misspelt setting cannot be silently ignored.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, fields
from typing import Any

MODEL_ORDER = ("arima", "additive", "boosted", "recurrent")


@dataclass(frozen=True)
class SalesColumns:
    """Names of the four columns of a raw sales table."""

    # One column, or several that name a series together.
    group_col: str | tuple[str, ...] = "State"
    date_col: str = "Date"
    target_col: str = "Total"
    category_col: str = "Category"

    @property
    def groups(self) -> tuple[str, ...]:
        return (self.group_col,) if isinstance(self.group_col, str) else tuple(self.group_col)

    @property
    def required(self) -> tuple[str, ...]:
        return (*self.groups, self.date_col, self.target_col, self.category_col)


@dataclass(frozen=True)
class PanelParams:
    imputation: str = "linear"
    outlier_strategy: str = "cap"
    iqr_multiplier: float = 3.0
    # Digits after the point of the target. When set, sums run on whole minor units and so do not
    # depend on the order of rows: a recomputed task gives the same bits. None sums doubles.
    minor_digits: int | None = None
    # "series" takes the capping bounds from all weeks of a series, "fold" from the train weeks of
    # each fold, so that test weeks have no say in them.
    fit_scope: str = "series"

    def __post_init__(self):
        if self.fit_scope not in ("series", "fold"):
            raise ValueError(f"unknown fit scope {self.fit_scope!r}")
        if self.imputation not in ("linear", "ffill", "bfill"):
            raise ValueError(f"unknown imputation {self.imputation!r}")
        if self.outlier_strategy not in ("cap", "none"):
            raise ValueError(f"unknown outlier strategy {self.outlier_strategy!r}")


@dataclass(frozen=True)
class FeatureParams:
    lags: tuple[int, ...] = (1, 7, 30)
    rolling_windows: tuple[int, ...] = (4, 8, 13)
    rolling_stats: tuple[str, ...] = ("mean", "std")
    time_features: tuple[str, ...] = ("week_of_year", "month", "quarter", "year")
    holidays: bool = True
    fourier_terms: int = 3

    @property
    def warmup(self) -> int:
        """Leading weeks of a series that cannot have every feature."""
        return max(max(self.lags, default=0), max(self.rolling_windows, default=1) - 1)


@dataclass(frozen=True)
class FoldParams:
    initial_train_weeks: int = 104
    horizon: int = 8
    step: int = 4
    # None tests every fold the series is long enough for.
    max_folds: int | None = 5
    min_folds: int = 3
    anchor: str = "start"

    def __post_init__(self):
        for name in ("initial_train_weeks", "horizon", "step", "max_folds", "min_folds"):
            value = getattr(self, name)
            if value is None and name == "max_folds":
                continue
            if value <= 0:
                raise ValueError(f"{name} must be positive, got {value}")
        if self.anchor not in ("start", "end"):
            raise ValueError(f"anchor must be 'start' or 'end', got {self.anchor!r}")


@dataclass(frozen=True)
class ArimaParams:
    seasonal: bool = True
    m: int = 52
    max_p: int = 3
    max_q: int = 2
    max_d: int = 2
    max_P: int = 1
    max_Q: int = 1
    long_ar: int = 8
    # Weeks wanted behind the longest lag before seasonal orders are tried.
    seasonal_rows: int = 12
    kpss_critical: float = 0.463
    # Walk from order to neighbouring order instead of trying all up to the bounds, which may then be large.
    stepwise: bool = False
    # Fit the chosen order again by maximum likelihood.
    likelihood: bool = False


@dataclass(frozen=True)
class AdditiveParams:
    yearly_seasonality: bool = True
    yearly_order: int = 10
    holidays: bool = True
    changepoints: int = 25
    changepoint_range: float = 0.8
    trend_penalty: float = 4e-4
    changepoint_penalty: float = 4.0
    # Above zero, changes of slope are penalised by their absolute value times this instead of their square, so
    # that most are exactly zero.
    changepoint_l1: float = 0.0
    seasonality_penalty: float = 1e-4


@dataclass(frozen=True)
class BoostedParams:
    n_estimators: int = 300
    max_depth: int = 6
    learning_rate: float = 0.1
    subsample: float = 0.8
    colsample: float = 0.8
    min_child_weight: int = 3
    # Penalties on the leaf weights: absolute value and square.
    reg_alpha: float = 0.01
    reg_lambda: float = 1.0
    # Cut points per feature are one less; at most 255.
    bins: int = 64
    per_horizon: bool = True
    n_trials: int = 50
    # A trial stops after this many trees without a lower error; at ``first_rung`` trees, and at each doubling,
    # the worse half of the trials of a pass is dropped.
    early_stopping_rounds: int = 50
    first_rung: int = 16
    # Trials that grow side by side.
    trials_at_once: int = 10
    seed: int = 42

    def __post_init__(self):
        if not 2 <= self.bins <= 255:
            raise ValueError(f"bins must be 2 to 255, got {self.bins}")


@dataclass(frozen=True)
class RecurrentParams:
    lookback: int = 52
    hidden: int = 64
    batch_size: int = 16
    spectral_radius: float = 0.9
    leak: float = 0.5
    ridge_grid: tuple[float, ...] = (1e-4, 1e-3, 1e-2, 1e-1, 1.0, 10.0)
    holdout: float = 0.1
    seed: int = 42
    # "reservoir" learns the readout only, "gated" trains a gated network of ``units`` with early stopping.
    kind: str = "reservoir"
    units: int = 32
    epochs: int = 50
    patience: int = 5
    learning_rate: float = 0.005
    clip: float = 1.0

    def __post_init__(self):
        if self.kind not in ("reservoir", "gated"):
            raise ValueError(f"unknown recurrence {self.kind!r}")


@dataclass(frozen=True)
class EnsembleParams:
    top_k: int = 2
    weighting: str = "inverse_rmse"

    def __post_init__(self):
        if self.weighting not in ("inverse_rmse", "uniform"):
            raise ValueError(f"unknown weighting {self.weighting!r}")


@dataclass(frozen=True)
class ForecastParams:
    horizon_weeks: int = 8
    z: float = 1.96
    # "normal" gives bands of z * sigma * sqrt(h), "bootstrap" percentiles over paths of drawn residuals.
    band: str = "normal"
    band_share: float = 0.9
    paths: int = 1000
    seed: int = 42

    def __post_init__(self):
        if self.band not in ("normal", "bootstrap"):
            raise ValueError(f"unknown band {self.band!r}")
        if not 0 < self.band_share < 1 or self.paths < 2:
            raise ValueError("band_share lies between 0 and 1, paths are two or more")


@dataclass(frozen=True)
class ModelParams:
    arima: ArimaParams = field(default_factory=ArimaParams)
    additive: AdditiveParams = field(default_factory=AdditiveParams)
    boosted: BoostedParams = field(default_factory=BoostedParams)
    recurrent: RecurrentParams = field(default_factory=RecurrentParams)


@dataclass(frozen=True)
class Settings:
    data: SalesColumns = field(default_factory=SalesColumns)
    preprocessing: PanelParams = field(default_factory=PanelParams)
    features: FeatureParams = field(default_factory=FeatureParams)
    cv: FoldParams = field(default_factory=FoldParams)
    models: ModelParams = field(default_factory=ModelParams)
    ensemble: EnsembleParams = field(default_factory=EnsembleParams)
    forecast: ForecastParams = field(default_factory=ForecastParams)

    def __post_init__(self):
        if self.cv.horizon != self.forecast.horizon_weeks:
            raise ValueError(
                f"cv.horizon ({self.cv.horizon}) and forecast.horizon_weeks "
                f"({self.forecast.horizon_weeks}) must agree"
            )

    @classmethod
    def from_mapping(cls, config: Mapping[str, Any]) -> Settings:
        return _build(cls, config, "settings")


def _build(cls, values: Mapping[str, Any], where: str):
    known = {f.name: f for f in fields(cls)}
    unknown = set(values) - set(known)
    if unknown:
        raise ValueError(f"unknown keys in {where}: {sorted(unknown)}")
    kwargs = {}
    for name, value in values.items():
        factory = known[name].default_factory
        if isinstance(value, Mapping):
            value = _build(factory, value, f"{where}.{name}")
        elif isinstance(value, list):
            value = tuple(value)
        kwargs[name] = value
    return cls(**kwargs)
