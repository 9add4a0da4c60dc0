"""From raw sales to a gap-free weekly panel: resample, grid, impute, cap, reports.

Raw rows are summed per series and week before anything is keyed by series alone, with partial sums
on the map side; a series that holds a third of all raw rows is then no longer than any other. From
there a series has one row per calendar week, so one shuffle by ``series_id`` serves the grid,
imputation and capping, and every later window over a series. What imputation needs is found before the
empty weeks are put in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weekloom.functions.calendar import week_ending
from weekloom.params import PanelParams


def _total(value: Column, minor_digits: int | None) -> Column:
    """Sum that is NULL when no row has a value; whole minor units when the scale is known."""
    if minor_digits is None:
        return F.sum(value)
    unit = float(10**minor_digits)
    return F.sum(F.rint(value * unit).cast("bigint")).cast("double") / F.lit(unit)


def weekly_resample(sales: DataFrame, params: PanelParams = PanelParams()) -> DataFrame:
    """Sum per series and Monday-to-Sunday week; a week with NULLs only stays NULL."""
    return sales.groupBy("series_id", week_ending(F.col("ds")).alias("week_end")).agg(
        _total(F.col("value"), params.minor_digits).alias("y")
    )


_NEIGHBOURS = ("y0", "t0", "y1", "t1")


def gap_fill_grid(weekly: DataFrame, neighbours: bool = False) -> DataFrame:
    """Every week from a series' first to its last, with its position ``t``; new weeks are NULL.

    Each observed week emits itself and the empty weeks up to the next observed one, so there is no
    calendar to join with. ``neighbours`` adds what ``impute`` needs, the nearest values before and after
    with their positions: found on the few observed weeks, so that the full grid is not sorted for them.
    """
    by_week = Window.partitionBy("series_id").orderBy("week_end")
    so_far = by_week.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    over = "OVER (PARTITION BY series_id ORDER BY week_end)"
    # A row without a week is no week of the grid, so its value is nobody's neighbour.
    near = {
        f"{name}{side}": F.expr(f"{offset}(CASE WHEN {known} THEN {value} END) IGNORE NULLS {over}")
        for side, offset in enumerate(("lag", "lead"))
        for name, known, value in (("y", "week_end IS NOT NULL", "y"), ("w", "y IS NOT NULL", "week_end"))
    }
    observed = weekly.select(
        "series_id",
        F.col("week_end").alias("seen"),
        "y",
        F.min("week_end").over(so_far).alias("first_week"),
        F.coalesce(F.date_sub(F.lead("week_end").over(by_week), 7), F.col("week_end")).alias("upto"),
        *[c.alias(n) for n, c in near.items() if neighbours],
    )
    weeks = F.sequence("seen", "upto", F.expr("INTERVAL 7 DAYS"))
    grid = observed.select(*[c for c in observed.columns if c != "upto"], F.explode(weeks).alias("week_end"))

    def place(week: str | Column) -> Column:
        return (F.datediff(week, "first_week") / 7).cast("int")

    at_seen = F.col("week_end") == F.col("seen")
    found = {}
    if neighbours:
        # An empty week behind an observed one has that one's value before it.
        own = ~at_seen & F.col("y").isNotNull()
        found = {
            "y0": F.when(own, F.col("y")).otherwise(F.col("y0")),
            "t0": place(F.when(own, F.col("seen")).otherwise(F.col("w0"))),
            "y1": F.col("y1"),
            "t1": place("w1"),
        }
    return grid.select(
        "series_id",
        "week_end",
        place("week_end").alias("t"),
        F.when(at_seen, F.col("y")).alias("y"),
        *[found[n].alias(n) for n in _NEIGHBOURS if found],
    )


def impute(grid: DataFrame, mode: str = "linear") -> DataFrame:
    """Fill NULL weeks: ``linear`` by position, ``ffill`` or ``bfill`` first, then both ends.

    A grid with ``neighbours`` is filled row by row; else ``IGNORE NULLS`` offsets find the neighbours with a
    value in one pass over one sort.
    """
    PanelParams(imputation=mode)
    near = grid
    if not set(_NEIGHBOURS) <= set(grid.columns):
        over = "OVER (PARTITION BY series_id ORDER BY week_end)"
        seen_t = "CASE WHEN y IS NOT NULL THEN t END"
        near = grid.select(
            "*",
            F.expr(f"lag(y) IGNORE NULLS {over}").alias("y0"),
            F.expr(f"lag({seen_t}) IGNORE NULLS {over}").alias("t0"),
            F.expr(f"lead(y) IGNORE NULLS {over}").alias("y1"),
            F.expr(f"lead({seen_t}) IGNORE NULLS {over}").alias("t1"),
        )
    y, y0, y1 = F.col("y"), F.col("y0"), F.col("y1")
    line = y0 + (y1 - y0) * (F.col("t") - F.col("t0")) / (F.col("t1") - F.col("t0"))
    order = {"linear": (y, line, y0, y1), "ffill": (y, y0, y1), "bfill": (y, y1, y0)}[mode]
    return near.withColumn("y", F.coalesce(*order)).drop(*_NEIGHBOURS)


def impute_residual_check(panel: DataFrame) -> DataFrame:
    """Weeks still NULL after imputation, per series that has any."""
    return (
        panel.groupBy("series_id")
        .agg(F.count_if(F.col("y").isNull()).alias("n_null"))
        .where("n_null > 0")
    )


def iqr_bounds(
    panel: DataFrame,
    k: float = 3.0,
    partition_by: tuple[str, ...] = ("series_id",),
    fit_rows: Column | None = None,
) -> DataFrame:
    """Add ``lower`` and ``upper``: exact quartiles of the partition -/+ k interquartile ranges.

    ``fit_rows`` limits the rows the quartiles are taken from, e.g. to the training rows of a fold.
    """
    y = F.col("y") if fit_rows is None else F.when(fit_rows, F.col("y"))
    quartiles = F.percentile(y, F.array(F.lit(0.25), F.lit(0.75)))
    with_q = panel.withColumn("_q", quartiles.over(Window.partitionBy(*partition_by)))
    q1, q3 = F.col("_q")[0], F.col("_q")[1]
    return with_q.select(
        *panel.columns, (q1 - k * (q3 - q1)).alias("lower"), (q3 + k * (q3 - q1)).alias("upper")
    )


def iqr_cap(
    panel: DataFrame,
    k: float = 3.0,
    partition_by: tuple[str, ...] = ("series_id",),
    fit_rows: Column | None = None,
) -> DataFrame:
    bounded = iqr_bounds(panel, k, partition_by, fit_rows)
    capped = F.when(
        F.col("y").isNotNull(), F.greatest(F.col("lower"), F.least(F.col("upper"), F.col("y")))
    )
    return bounded.withColumn("y", capped).drop("lower", "upper")


def iqr_cap_report(panel: DataFrame, k: float = 3.0) -> DataFrame:
    """Bounds and number of capped weeks per series."""
    outside = (F.col("y") < F.col("lower")) | (F.col("y") > F.col("upper"))
    return (
        iqr_bounds(panel, k)
        .groupBy("series_id")
        .agg(
            F.first("lower").alias("lower"),
            F.first("upper").alias("upper"),
            F.count_if(outside).alias("n_capped"),
        )
    )


def prepare_panel(sales: DataFrame, params: PanelParams = PanelParams(), cap: bool = True) -> DataFrame:
    """The whole chain: ``(series_id, week_end, t, y)`` without gaps or NULLs, outliers capped.

    ``cap=False`` leaves capping to the folds (see ``fold_scoped_cap``).
    """
    panel = impute(gap_fill_grid(weekly_resample(sales, params), neighbours=True), params.imputation)
    if cap and params.outlier_strategy == "cap":
        panel = iqr_cap(panel, params.iqr_multiplier)
    return panel


def preprocess_report(sales: DataFrame, params: PanelParams = PanelParams()) -> DataFrame:
    """Raw rows, weekly rows and gaps per series.

    ``gap_pct`` is (weeks - distinct raw dates) / weeks; it turns negative when dates are denser
    than weeks. ``gap_weeks`` counts the weeks that really have no row.
    """
    daily = sales.groupBy("series_id", "ds").agg(F.count("*").alias("n_raw"))
    weekly = daily.groupBy("series_id", week_ending(F.col("ds")).alias("week_end")).agg(
        F.sum("n_raw").alias("n_raw"), F.count("*").alias("n_dates")
    )
    n_weeks = (F.datediff(F.max("week_end"), F.min("week_end")) / 7).cast("bigint") + 1
    return (
        weekly.groupBy("series_id")
        .agg(
            F.sum("n_raw").alias("n_raw"),
            n_weeks.alias("n_weeks"),
            F.sum("n_dates").alias("n_dates"),
            F.count("*").alias("n_seen"),
        )
        .select(
            "series_id",
            "n_raw",
            "n_weeks",
            (F.col("n_weeks") - F.col("n_seen")).alias("gap_weeks"),
            ((F.col("n_weeks") - F.col("n_dates")) / F.col("n_weeks") * 100).alias("gap_pct"),
        )
    )


def panel_span(report: DataFrame) -> DataFrame:
    """Number of series and the shortest and longest of them, from ``preprocess_report``."""
    return report.agg(
        F.count("*").alias("n_series"),
        F.min("n_weeks").alias("min_weeks"),
        F.max("n_weeks").alias("max_weeks"),
    )
