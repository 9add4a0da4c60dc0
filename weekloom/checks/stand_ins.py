"""Four forecasters that SQL can express, so that scoring and reports have exact checks.

They stand in for the real models in the checks only: last value, mean of 8 weeks, the value of 52
weeks ago, and a straight line through the first and last value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STAND_INS = ("last_value", "mean_8", "lag_52", "drift")


def stand_in_forecasts(train: DataFrame, horizon: int = 8) -> DataFrame:
    """``(series_id, fold, model, h, ds, yhat)`` from training rows."""
    n = F.max("t").over(_by_fold()) + 1
    rows = train.withColumn("n", n)
    recent = F.when(F.col("t") >= F.col("n") - 8, F.col("y"))
    year_ago = F.when(
        (F.col("t") >= F.col("n") - 52) & (F.col("t") < F.col("n") - 52 + horizon),
        F.struct("t", "y"),
    )
    per_fold = rows.groupBy("series_id", "fold", "n").agg(
        F.max("week_end").alias("last_week"),
        F.max_by("y", "t").alias("last_y"),
        F.min_by("y", "t").alias("first_y"),
        F.avg(recent).alias("mean_y"),
        F.array_sort(F.collect_list(year_ago)).alias("ago"),
    )
    steps = per_fold.withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    slope = (F.col("last_y") - F.col("first_y")) / (F.col("n") - 1)
    values = {
        "last_value": F.col("last_y"),
        "mean_8": F.col("mean_y"),
        "lag_52": F.get(F.col("ago.y"), F.col("h") - 1),
        "drift": F.col("last_y") + F.col("h") * slope,
    }
    pairs = F.array(*[F.struct(F.lit(m).alias("model"), values[m].alias("yhat")) for m in STAND_INS])
    return steps.select(
        "series_id",
        "fold",
        "h",
        F.date_add("last_week", F.col("h") * 7).alias("ds"),
        F.inline(pairs),
    )


def _by_fold():
    from pyspark.sql import Window

    return Window.partitionBy("series_id", "fold")
