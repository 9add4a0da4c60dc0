"""Accuracy metrics as aggregate expressions over ``(y_true, yhat)`` rows, one pass for all four.

Rows without a forecast are left out; a group with no usable row gives NULL, never infinity.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

METRICS = ("rmse", "mae", "mape", "smape")


def rmse(y: Column, yhat: Column) -> Column:
    return F.sqrt(F.avg((y - yhat) * (y - yhat)))


def mae(y: Column, yhat: Column) -> Column:
    return F.avg(F.abs(y - yhat))


def mape(y: Column, yhat: Column) -> Column:
    """Percent error; weeks with an actual of zero are left out."""
    return F.avg(F.when(y != 0, F.abs((y - yhat) / y))) * 100


def smape(y: Column, yhat: Column) -> Column:
    """Symmetric percent error; both-zero weeks are left out, each term is at most 200."""
    size = F.abs(y) + F.abs(yhat)
    return F.avg(F.when(size > 0, F.least(F.lit(200.0), 200 * F.abs(y - yhat) / size)))


def all_metrics(y: Column, yhat: Column) -> list[Column]:
    return [
        rmse(y, yhat).alias("rmse"),
        mae(y, yhat).alias("mae"),
        mape(y, yhat).alias("mape"),
        smape(y, yhat).alias("smape"),
    ]
