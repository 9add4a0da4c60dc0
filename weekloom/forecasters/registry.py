"""The four forecasters, by name.

Each takes training rows ``(series_id, fold, week_end, t, y)``, a horizon and the settings, and
returns ``(series_id, fold, h, yhat)``. The dict is the extension point: add a function with the same
contract under a new name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from weekloom.forecasters.additive import fc_additive
from weekloom.forecasters.arima import fc_arima
from weekloom.forecasters.boosted import fc_boosted_direct
from weekloom.forecasters.gated import fc_gated
from weekloom.forecasters.recurrent import fc_recurrent
from weekloom.params import RecurrentParams, Settings

Forecaster = Callable[[DataFrame, int, Settings], DataFrame]


def _recurrent(train: DataFrame, horizon: int, p: RecurrentParams) -> DataFrame:
    return (fc_gated if p.kind == "gated" else fc_recurrent)(train, horizon, p)


FORECASTERS: dict[str, Forecaster] = {
    "arima": lambda train, horizon, s: fc_arima(train, horizon, s.models.arima),
    "additive": lambda train, horizon, s: fc_additive(train, horizon, s.models.additive),
    "boosted": lambda train, horizon, s: fc_boosted_direct(
        train, horizon, s.models.boosted, s.features
    ),
    "recurrent": lambda train, horizon, s: _recurrent(train, horizon, s.models.recurrent),
}
