from __future__ import annotations

from datetime import date, timedelta

SUNDAY = date(2020, 1, 5)


def panel(spark, series: dict[str, list[float | None]], start: date = SUNDAY):
    rows = [
        (name, start + timedelta(days=7 * t), t, None if y is None else float(y))
        for name, values in series.items()
        for t, y in enumerate(values)
    ]
    return spark.createDataFrame(rows, "series_id string, week_end date, t int, y double")


def history(spark, series: dict[str, list[float]], fold: int = 0, start: date = SUNDAY):
    from pyspark.sql import functions as F

    rows = panel(spark, series, start)
    return rows.select("series_id", F.lit(fold).alias("fold"), "week_end", "t", "y")


def forecasts(df) -> dict[str, list[float]]:
    out: dict[str, list[tuple[int, float]]] = {}
    for r in df.collect():
        out.setdefault(r.series_id, []).append((r.h, r.yhat))
    return {k: [v for _, v in sorted(vs)] for k, vs in out.items()}
