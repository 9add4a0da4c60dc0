"""DuckDB SQL for the registered queries, written from the operators' definitions.

The text is assembled from named steps; ``sql`` puts the steps a query needs, in order, before its
body. Keys match ``queries.py``.
"""

from __future__ import annotations

STEPS: dict[str, str] = {}


def step(name: str, body: str) -> None:
    STEPS[name] = body.strip()


def sql(body: str, *names: str) -> str:
    """``body`` after the given steps and everything they need."""
    needed: list[str] = []

    def visit(name: str) -> None:
        if name in needed:
            return
        for other in STEPS:
            if other != name and f"{{{other}}}" in STEPS[name]:
                visit(other)
        needed.append(name)

    for other in STEPS:
        if f"{{{other}}}" in body:
            visit(other)
    plain = {n: n for n in STEPS}
    steps = ",\n".join(f"{n} AS ({STEPS[n].format_map(plain)})" for n in needed)
    text = body.strip().format_map(plain)
    return f"WITH {steps}\n{text}" if needed else text


# -- sales tables -----------------------------------------------------------------------------

_ORDERS = """
SELECT {key} AS series_id, CAST(o_orderdate AS DATE) AS ds, o_totalprice AS value,
       c_mktsegment AS category
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
"""
step("nation_sales", _ORDERS.format(key="n_name"))
step("segment_sales", _ORDERS.format(key="n_name || '|' || c_mktsegment"))
step(
    "customer_sales",
    """
SELECT CAST(o_custkey AS VARCHAR) AS series_id, CAST(o_orderdate AS DATE) AS ds,
       CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS value, o_orderpriority AS category
FROM orders
""",
)
step(
    "event_sales",
    "SELECT event_type AS series_id, CAST(ts AS DATE) AS ds, value, event_type AS category FROM events",
)


# -- panel ------------------------------------------------------------------------------------


def _quantile(p: float, alias: str) -> str:
    """Linear between the two neighbours of position p * (n - 1), from the sorted list ``ys``."""
    at = f"{p}::DOUBLE * top"
    return (
        f"CASE WHEN ceil({at}) = floor({at}) THEN ys[CAST(floor({at}) AS INTEGER) + 1] ELSE "
        f"(ceil({at}) - {at}) * ys[CAST(floor({at}) AS INTEGER) + 1] + "
        f"({at} - floor({at})) * ys[CAST(ceil({at}) AS INTEGER) + 1] END AS {alias}"
    )


_QUARTILES = f"{_quantile(0.25, 'q1')}, {_quantile(0.75, 'q3')}"


def _panel_steps(name: str) -> None:
    step(
        f"{name}_weekly",
        f"""
SELECT series_id, CAST(date_trunc('week', ds) AS DATE) + 6 AS week_end,
       CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) / 100.0 AS y
FROM {{{name}_sales}} GROUP BY 1, 2
""",
    )
    step(
        f"{name}_grid",
        f"""
SELECT b.series_id, b.week_end, CAST((b.week_end - b.lo) // 7 AS INTEGER) AS t, w.y
FROM (SELECT series_id, lo, CAST(unnest(generate_series(lo, hi, INTERVAL 7 DAY)) AS DATE) AS week_end
      FROM (SELECT series_id, min(week_end) AS lo, max(week_end) AS hi
            FROM {{{name}_weekly}} GROUP BY 1)) b
LEFT JOIN {{{name}_weekly}} w ON w.series_id = b.series_id AND w.week_end = b.week_end
""",
    )
    step(
        f"{name}_near",
        f"""
SELECT series_id, week_end, t, y,
       last_value(y IGNORE NULLS) OVER past AS y0,
       last_value(CASE WHEN y IS NOT NULL THEN t END IGNORE NULLS) OVER past AS t0,
       first_value(y IGNORE NULLS) OVER future AS y1,
       first_value(CASE WHEN y IS NOT NULL THEN t END IGNORE NULLS) OVER future AS t1
FROM {{{name}_grid}}
WINDOW past AS (PARTITION BY series_id ORDER BY week_end
                ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
       future AS (PARTITION BY series_id ORDER BY week_end
                  ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
""",
    )
    step(
        f"{name}_full",
        f"""
SELECT series_id, week_end, t,
       coalesce(y, CASE WHEN t1 > t0 THEN y0 + (y1 - y0) * (t - t0) / (t1 - t0) END, y0, y1) AS y
FROM {{{name}_near}}
""",
    )
    step(
        f"{name}_quartiles",
        f"""
SELECT series_id, {_QUARTILES} FROM (SELECT series_id, list_sort(list(y)) AS ys, (count(y) - 1) AS top
      FROM {{{name}_full}} WHERE y IS NOT NULL GROUP BY 1)
""",
    )
    step(
        f"{name}_panel",
        f"""
SELECT series_id, week_end, t,
       greatest(q1 - 3.0 * (q3 - q1), least(q3 + 3.0 * (q3 - q1), y)) AS y
FROM {{{name}_full}} JOIN {{{name}_quartiles}} USING (series_id)
""",
    )


for _name in ("nation", "segment", "customer", "event"):
    _panel_steps(_name)


# -- folds ------------------------------------------------------------------------------------

step(
    "fold_table",
    """
SELECT series_id, n, f AS fold, 104 + 4 * f AS cut, n - 8 - 4 * (n_folds - 1 - f) AS end_cut
FROM (SELECT series_id, n, f, count(*) OVER (PARTITION BY series_id) AS n_folds
      FROM (SELECT series_id, count(*) AS n FROM {nation_panel} GROUP BY 1),
           (SELECT unnest([0, 1, 2, 3, 4]) AS f)
      WHERE 104 + 4 * f + 8 <= n)
WHERE n_folds >= 3
""",
)
step(
    "folds",
    """
SELECT p.series_id, CAST(fold AS INTEGER) AS fold, CASE WHEN t < cut THEN 'train' ELSE 'test' END AS role,
       week_end, t, y
FROM {nation_panel} p JOIN {fold_table} f ON f.series_id = p.series_id AND p.t < f.cut + 8
""",
)
step(
    "end_folds",
    """
SELECT p.series_id, CAST(fold AS INTEGER) AS fold, CASE WHEN t < end_cut THEN 'train' ELSE 'test' END AS role,
       week_end, t, y
FROM {nation_panel} p JOIN {fold_table} f ON f.series_id = p.series_id AND p.t < f.end_cut + 8
""",
)
step(
    "raw_folds",
    """
SELECT p.series_id, CAST(fold AS INTEGER) AS fold, CASE WHEN t < cut THEN 'train' ELSE 'test' END AS role,
       week_end, t, y
FROM {nation_full} p JOIN {fold_table} f ON f.series_id = p.series_id AND p.t < f.cut + 8
""",
)


def _folds(panel: str, first: int, horizon: int, step_: int, most: int | None, least: int) -> str:
    """Fold rows of a panel; series without values are not in ``panel``'s capped steps."""
    limit = f"least({most}, (n - {first + horizon}) // {step_} + 1)" if most else f"(n - {first + horizon}) // {step_} + 1"
    return f"""
SELECT p.series_id, CAST(f AS INTEGER) AS fold,
       CASE WHEN t < {first} + {step_} * f THEN 'train' ELSE 'test' END AS role, week_end, t, y
FROM {{{panel}}} p
JOIN (SELECT series_id, unnest(generate_series(0, n_folds - 1)) AS f
      FROM (SELECT series_id, CASE WHEN n < {first + horizon} THEN 0 ELSE {limit} END AS n_folds
            FROM (SELECT series_id, count(*) AS n FROM {{{panel}}} GROUP BY 1)) WHERE n_folds >= {least}) c
  ON c.series_id = p.series_id AND p.t < {first} + {step_} * f + {horizon}
"""


step("short_folds", _folds("nation_panel", 60, 4, 2, 8, 2))
step("all_folds", _folds("nation_panel", 60, 4, 26, None, 2))
step("customer_folds", _folds("customer_panel", 104, 8, 4, 5, 3))
step("train", "SELECT series_id, fold, week_end, t, y FROM {folds} WHERE role = 'train'")


# -- features ---------------------------------------------------------------------------------

_W = "OVER (PARTITION BY {keys} ORDER BY week_end)"


def _lag(k: int, keys: str) -> str:
    return f"lag(y, {k}) {_W.format(keys=keys)}" if k else "y"


def _lags(keys: str, ks: tuple[int, ...] = (1, 7, 30)) -> str:
    return ", ".join(f"{_lag(k, keys)} AS lag_{k}" for k in ks)


def _means(keys: str) -> str:
    parts = []
    for n in (4, 8, 13):
        total = " + ".join(_lag(k, keys) for k in range(n - 1, -1, -1))
        parts.append(f"({total}) / {n} AS rolling_mean_{n}")
    return ", ".join(parts)


def _stds(keys: str) -> str:
    parts = []
    for n in (4, 8, 13):
        frame = f"OVER (PARTITION BY {keys} ORDER BY week_end ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
        parts.append(
            f"round(CASE WHEN count(y) {frame} = {n} THEN stddev_samp(y) {frame} END, 2) "
            f"AS rolling_std_{n}"
        )
    return ", ".join(parts)


_CALENDAR = (
    "CAST(week(week_end) AS INTEGER) AS week_of_year, CAST(month(week_end) AS INTEGER) AS month, "
    "CAST(quarter(week_end) AS INTEGER) AS quarter, CAST(year(week_end) AS INTEGER) AS year"
)
_FOURIER = ", ".join(
    f"round({fn}(2 * pi() * {k} * week(week_end) / 52.1775::DOUBLE), {{digits}}) AS fourier_{fn}_{k}"
    for k in (1, 2, 3)
    for fn in ("sin", "cos")
)

# US federal holidays by rule, with the day on which a fixed date is observed.
step(
    "years",
    "SELECT unnest(generate_series(1990, 2030)) AS yr",
)
step(
    "months",
    """
SELECT yr, m, make_date(yr, m, 1) AS first_day,
       CAST(make_date(yr, m, 1) + INTERVAL 1 MONTH AS DATE) - 1 AS last_day
FROM {years}, (SELECT unnest(generate_series(1, 12)) AS m)
""",
)
step(
    "fixed_days",
    """
SELECT make_date(yr, m, d) AS day
FROM {years}, (VALUES (1, 1, 1900), (6, 19, 2021), (7, 4, 1900), (11, 11, 1900), (12, 25, 1900))
     v(m, d, since)
WHERE yr >= since
""",
)
step(
    "nth_days",
    """
SELECT first_day + CAST((wd - isodow(first_day) + 7) % 7 AS INTEGER) + 7 * (nth - 1) AS day
FROM {months}
JOIN (VALUES (1, 1, 3), (2, 1, 3), (9, 1, 1), (10, 1, 2), (11, 4, 4)) v(vm, wd, nth) ON m = vm
UNION ALL
SELECT last_day - CAST((isodow(last_day) - 1) AS INTEGER) FROM {months} WHERE m = 5
""",
)
step(
    "holidays",
    """
SELECT DISTINCT CAST(date_trunc('week', day) AS DATE) + 6 AS week_end FROM (
  SELECT day FROM {fixed_days}
  UNION ALL
  SELECT day + CASE isodow(day) WHEN 6 THEN -1 WHEN 7 THEN 1 ELSE 0 END FROM {fixed_days}
  UNION ALL
  SELECT day FROM {nth_days})
""",
)
_HOLIDAY = "CASE WHEN week_end IN (SELECT h.week_end FROM {holidays} h) THEN 1 ELSE 0 END"

_ALL_FEATURES = (
    f"{_lags('KEYS')}, {_means('KEYS')}, {_stds('KEYS')}, {_CALENDAR}, {_HOLIDAY} AS holiday, "
    + _FOURIER.replace("{digits}", "6")
)


def _features(keys: str) -> str:
    return _ALL_FEATURES.replace("KEYS", keys)


_FEATURE_NAMES = (
    [f"lag_{k}" for k in (1, 7, 30)]
    + [f"rolling_{s}_{n}" for n in (4, 8, 13) for s in ("mean", "std")]
    + ["week_of_year", "month", "quarter", "year", "holiday"]
    + [f"fourier_{fn}_{k}" for k in (1, 2, 3) for fn in ("sin", "cos")]
)

step(
    "nation_features",
    f"SELECT series_id, week_end, t, y, {_features('series_id')} FROM {{nation_panel}}",
)
step(
    "segment_features",
    f"SELECT series_id, week_end, t, y, {_features('series_id')} FROM {{segment_panel}}",
)
# The last 30 train weeks and the test weeks of each fold, each fold on its own.
step(
    "tails",
    """
SELECT series_id, fold, role, week_end, t, y FROM (
  SELECT *, row_number() OVER (PARTITION BY series_id, fold, role ORDER BY week_end DESC) AS back
  FROM {folds})
WHERE role = 'test' OR back <= 30
""",
)


# -- scaling and windows ----------------------------------------------------------------------

step(
    "scaled",
    """
SELECT f.*, lo AS y_min, coalesce(nullif(hi - lo, 0.0), 1.0) AS y_range,
       (y - lo) / coalesce(nullif(hi - lo, 0.0), 1.0) AS y_scaled, y_lo, y_hi
FROM {folds} f JOIN (
  SELECT series_id, fold, min(y) AS lo, max(y) AS hi, min(year(week_end)) AS y_lo,
         max(year(week_end)) AS y_hi
  FROM {train} GROUP BY 1, 2) USING (series_id, fold)
""",
)
step(
    "windows",
    """
SELECT series_id, fold, week_end, t, first_value, y_scaled AS last_value, first_target, last_target,
       week(week_end) / 52.0::DOUBLE AS last_week
FROM (SELECT *, lag(y_scaled, 51) OVER w AS first_value, lead(y_scaled, 1) OVER w AS first_target,
             lead(y_scaled, 8) OVER w AS last_target
      FROM {scaled} WHERE role = 'train'
      WINDOW w AS (PARTITION BY series_id, fold ORDER BY week_end))
WHERE first_value IS NOT NULL AND last_target IS NOT NULL
""",
)


# -- stand-in forecasts, scores, weights ------------------------------------------------------


def _stand_ins(rows: str) -> str:
    return f"""
SELECT s.series_id, s.fold, CAST(h AS INTEGER) AS h, s.last_week + CAST(7 * h AS INTEGER) AS ds, m.model,
       CASE m.model WHEN 'last_value' THEN last_y WHEN 'mean_8' THEN mean_y
            WHEN 'lag_52' THEN a.y ELSE last_y + h * ((last_y - first_y) / (n - 1)) END AS yhat
FROM (SELECT series_id, fold, max(t) + 1 AS n, max(week_end) AS last_week, max_by(y, t) AS last_y,
             min_by(y, t) AS first_y FROM {{{rows}}} GROUP BY 1, 2) s
JOIN (SELECT r.series_id, r.fold, avg(r.y) AS mean_y
      FROM {{{rows}}} r
      JOIN (SELECT series_id, fold, max(t) AS mt FROM {{{rows}}} GROUP BY 1, 2) e USING (series_id, fold)
      WHERE r.t > mt - 8 GROUP BY 1, 2) m8 USING (series_id, fold)
CROSS JOIN (SELECT unnest(generate_series(1, 8)) AS h)
CROSS JOIN (VALUES ('last_value'), ('mean_8'), ('lag_52'), ('drift')) m(model)
LEFT JOIN {{{rows}}} a ON a.series_id = s.series_id AND a.fold = s.fold AND a.t = n - 52 + h - 1
"""


# Amounts converted at a fixed rate, see queries.py.
_RATE = "y * 0.9137254901::DOUBLE AS y"
step("converted", f"SELECT * REPLACE ({_RATE}) FROM {{train}}")
step("history", f"SELECT series_id, -1 AS fold, week_end, t, {_RATE} FROM {{nation_panel}}")
step("cv_forecasts", _stand_ins("converted"))
step("forecasts", _stand_ins("history"))
step(
    "predictions",
    """
SELECT f.series_id, f.fold, c.h, f.week_end AS ds, c.model, f.y * 0.9137254901::DOUBLE AS y_true, c.yhat
FROM {folds} f JOIN {cv_forecasts} c
  ON c.series_id = f.series_id AND c.fold = f.fold AND c.ds = f.week_end
WHERE f.role = 'test'
""",
)
_METRIC_SQL = {
    "rmse": "sqrt(avg((y_true - yhat) * (y_true - yhat)))",
    "mae": "avg(abs(y_true - yhat))",
    "mape": "avg(CASE WHEN y_true <> 0 THEN abs((y_true - yhat) / y_true) END) * 100",
    "smape": "avg(CASE WHEN abs(y_true) + abs(yhat) > 0 THEN "
    "least(200.0, 200 * abs(y_true - yhat) / (abs(y_true) + abs(yhat))) END)",
}
step(
    "scores",
    "SELECT series_id, model, fold, "
    + ", ".join(f"{e} AS {m}" for m, e in _METRIC_SQL.items())
    + " FROM {predictions} GROUP BY 1, 2, 3",
)
step("broken_scores", "SELECT * REPLACE (CASE WHEN model = 'drift' AND fold = 2 THEN NULL ELSE rmse END AS rmse) FROM {scores}")
_ORDINAL = "CASE model WHEN 'last_value' THEN 1 WHEN 'mean_8' THEN 2 WHEN 'lag_52' THEN 3 ELSE 4 END"


def _weight_steps(prefix: str, scores: str) -> None:
    step(
        f"{prefix}ranked",
        f"""
SELECT *, CAST(row_number() OVER (PARTITION BY series_id
          ORDER BY mean_rmse ASC NULLS LAST, {_ORDINAL}) AS INTEGER) AS rank
FROM (SELECT series_id, model, CASE WHEN count(rmse) = count(*) THEN avg(rmse) END AS mean_rmse,
             count(*) AS n_folds FROM {{{scores}}} GROUP BY 1, 2)
""",
    )
    step(
        f"{prefix}weights",
        f"""
SELECT series_id, model, mean_rmse, n_folds, rank, selected,
       raw / sum(raw) OVER (PARTITION BY series_id) AS weight
FROM (SELECT *, rank <= 2 AND mean_rmse IS NOT NULL AS selected,
             CASE WHEN rank <= 2 THEN 1 / greatest(mean_rmse, 1e-10) END AS raw
      FROM {{{prefix}ranked}})
""",
    )


_weight_steps("", "scores")
_weight_steps("broken_", "broken_scores")

step(
    "ensemble",
    """
SELECT series_id, h, ds, sum(weight * yhat) AS yhat, sum(weight * mean_rmse) AS sigma
FROM {forecasts} JOIN {weights} USING (series_id, model) WHERE selected GROUP BY 1, 2, 3
""",
)
step(
    "bands",
    """
SELECT series_id, h, ds, round(yhat, 2) AS yhat,
       round(yhat - 1.96::DOUBLE * sigma * sqrt(h), 2) AS yhat_lower,
       round(yhat + 1.96::DOUBLE * sigma * sqrt(h), 2) AS yhat_upper
FROM {ensemble}
""",
)
step(
    "moved",
    """
SELECT series_id, h, ds, sum(weight * yhat) / sum(weight) AS yhat, sum(weight * (yhat + e)) / sum(weight) AS band
FROM {forecasts} JOIN {weights} USING (series_id, model)
JOIN (SELECT series_id, model, avg(y_true - yhat) AS e FROM {predictions} GROUP BY 1, 2) USING (series_id, model)
WHERE selected AND yhat IS NOT NULL GROUP BY 1, 2, 3
""",
)
step(
    "averages",
    "SELECT series_id, model, avg(rmse) AS rmse, avg(mae) AS mae, avg(mape) AS mape, "
    "avg(smape) AS smape FROM {scores} GROUP BY 1, 2",
)
step(
    "event_runs",
    """
SELECT 'v' || strftime(ts, '%Y%m%d_%H%M%S') AS version, max(ts) AS created_at,
       count(DISTINCT user_id) AS n_series FROM events GROUP BY 1
""",
)
_MODELS = ("last_value", "mean_8", "lag_52", "drift")


def _wide(column: str, suffix: str = "", digits: int | None = 4) -> str:
    value = f"max(CASE WHEN model = '{{m}}' THEN {column} END)"
    if digits is not None:
        value = f"round({value}, {digits})"
    return ", ".join(f"{value} AS {suffix}{{m}}".replace("{m}", m) for m in _MODELS)


def _label(value: str, digits: int) -> str:
    def fixed(v: str, d: int) -> str:
        step_, twice = float(10**d), float(2 ** (d + 1))
        half = (
            f"{v} * {twice}::DOUBLE = floor({v} * {twice}::DOUBLE) "
            f"AND {v} * {step_}::DOUBLE - floor({v} * {step_}::DOUBLE) = 0.5"
        )
        moved = f"(floor({v} * {step_}::DOUBLE) + 1) / {step_}::DOUBLE"
        return f"printf('%.{d}f', CASE WHEN {half} THEN {moved} ELSE {v} END)"

    return (
        f"CASE WHEN {value} IS NULL THEN '—' "
        f"WHEN {value} >= 1e9 THEN {fixed(f'({value} / 1e9)', 2)} || 'B' "
        f"WHEN {value} >= 1e6 THEN {fixed(f'({value} / 1e6)', 1)} || 'M' "
        f"WHEN {value} >= 1e3 THEN {fixed(f'({value} / 1e3)', 0)} || 'K' "
        f"ELSE {fixed(f'({value})', digits)} END"
    )




def _kpss(x: str) -> str:
    """Level KPSS statistic of ``x`` per series and fold, with a Bartlett window."""
    lags = ", ".join(
        f"greatest(0.0, 1 - {j} / (lim + 1)) * 2 * e * coalesce(lag(e, {j}) OVER w, 0) AS c{j}"
        for j in range(1, 13)
    )
    total = " + ".join(f"c{j}" for j in range(1, 13))
    return f"""
SELECT series_id, fold, sum(s * s) / nullif(count(e) * sum(e * e + {total}), 0) AS k
FROM (SELECT *, sum(e) OVER (w ROWS UNBOUNDED PRECEDING) AS s, {lags}
      FROM (SELECT series_id, fold, t, {x} - avg({x}) OVER f AS e,
                   floor(4 * pow(count({x}) OVER f / 100, 0.25)) AS lim
            FROM {{differences}} WINDOW f AS (PARTITION BY series_id, fold))
      WHERE e IS NOT NULL
      WINDOW w AS (PARTITION BY series_id, fold ORDER BY t))
GROUP BY 1, 2
"""


step(
    "differences",
    "SELECT *, y - lag(y) OVER (PARTITION BY series_id, fold ORDER BY t) AS dy FROM {train}",
)
step("kpss_level", _kpss("y"))
step("kpss_change", _kpss("dy"))

step("eight", "SELECT unnest(generate_series(1, 8)) AS h")
step(
    "unit_scaled",
    """
SELECT series_id, fold, t, count(*) OVER f AS n, min(y) OVER f AS lo, max(y) OVER f - min(y) OVER f AS width,
       (y - min(y) OVER f) / (max(y) OVER f - min(y) OVER f) AS s
FROM {train} WINDOW f AS (PARTITION BY series_id, fold)
""",
)
step(
    "mean_scaled",
    """
SELECT series_id, fold, t, avg(abs(y)) OVER f AS scale, y / avg(abs(y)) OVER f AS s
FROM {train} WINDOW f AS (PARTITION BY series_id, fold)
""",
)

# One split of the months, by gradients g = mean - y with unit curvatures: alpha 0.5, lambda 2, 3 rows a leaf.
_SOFT = "(sign({0}) * greatest(abs({0}) - 0.5, 0))"
step(
    "month_targets",
    """
SELECT a.fold, h, month(a.week_end) AS m, b.s AS y, avg(b.s) OVER (PARTITION BY a.fold, h) AS base
FROM (SELECT s.*, week_end FROM {mean_scaled} s JOIN {train} USING (series_id, fold, t)) a CROSS JOIN {eight}
JOIN {mean_scaled} b ON b.series_id = a.series_id AND b.fold = a.fold AND b.t = a.t + h
""",
)
step(
    "month_cuts",
    f"""
SELECT fold, h, base, cut, -{_SOFT.format("gl")} / (hl + 2) AS low, -{_SOFT.format("gr")} / (hr + 2) AS high,
       pow({_SOFT.format("gl")}, 2) / (hl + 2) + pow({_SOFT.format("gr")}, 2) / (hr + 2)
       - pow({_SOFT.format("(gl + gr)")}, 2) / (hl + hr + 2) AS gain
FROM (SELECT fold, h, base, cut, sum(base - y) FILTER (m <= cut) AS gl, sum(base - y) FILTER (m > cut) AS gr,
             count(*) FILTER (m <= cut) AS hl, count(*) FILTER (m > cut) AS hr
      FROM {{month_targets}} CROSS JOIN (SELECT unnest(generate_series(1, 11)) AS cut) GROUP BY ALL)
WHERE hl >= 3 AND hr >= 3
""",
)

_GRAM_TERMS = ("1.0::DOUBLE", "lag_1", "lag_7", "lag_30", "y")
step(
    "millions",
    f"SELECT * FROM (SELECT series_id, fold, y, {_lags('series_id, fold')} FROM "
    "(SELECT * REPLACE (y / 1e6 AS y) FROM {converted})) WHERE lag_30 IS NOT NULL",
)

_FOLD_COLUMNS = "series_id, fold, role, week_end, t, y"
_PANEL_COLUMNS = "series_id, week_end, t, y"
_SCORE_COLUMNS = "round(rmse, 4) AS rmse, round(mae, 4) AS mae, round(mape, 4) AS mape, round(smape, 4) AS smape"
_WEIGHT_COLUMNS = "series_id, model, round(mean_rmse, 4) AS mean_rmse, n_folds, rank, selected, round(weight, 8) AS weight"


def _fill(order: str) -> str:
    return f"SELECT series_id, week_end, t, coalesce({order}) AS y FROM {{customer_near}}"


_LINE = "y, CASE WHEN t1 > t0 THEN y0 + (y1 - y0) * (t - t0) / (t1 - t0) END, y0, y1"

BODIES: dict[str, str] = {
    "fc_recurrent_mean": """
SELECT series_id, fold, CAST(h AS INTEGER) AS h, round((lo + width * mean) / 1e6, 3) AS yhat
FROM (SELECT DISTINCT series_id, fold, lo, width FROM {unit_scaled})
JOIN (SELECT fold, h, avg(s) AS mean FROM {unit_scaled} CROSS JOIN {eight}
      WHERE t >= 51 + h AND t <= n - 9 + h GROUP BY 1, 2) USING (fold)
""",
    "recurrent_epochs": """
SELECT fold, epoch, CAST(CASE WHEN epoch < 2 THEN sum(m - held) ELSE 0 END AS BIGINT) AS windows,
       CAST(sum(held) AS BIGINT) AS held_out, TRUE AS sound
FROM (SELECT fold, m, greatest(1, floor(0.1::DOUBLE * m)) AS held
      FROM (SELECT series_id, fold, count(*) - 59 AS m FROM {train} GROUP BY 1, 2) WHERE m >= 17)
CROSS JOIN (SELECT CAST(unnest([0, 1, 2]) AS INTEGER) AS epoch) GROUP BY 1, 2
""",
    "fc_boosted_mean": """
SELECT series_id, fold, CAST(h AS INTEGER) AS h, round(mean * scale / 1e6, 3) AS yhat
FROM (SELECT DISTINCT series_id, fold, scale FROM {mean_scaled})
JOIN (SELECT fold, avg(s) AS mean FROM {mean_scaled} CROSS JOIN {eight} WHERE t >= 30 + h GROUP BY 1) USING (fold)
CROSS JOIN {eight}
""",
    "arima_likelihood": """
SELECT series_id, fold, CAST(n AS INTEGER) AS n_rows,
       round(-n / 2.0::DOUBLE * (ln(2 * pi() * s / n) + 1) + 0.5::DOUBLE * ln(0.64::DOUBLE), 5) AS loglik
FROM (SELECT series_id, fold, count(*) AS n,
             sum(CASE WHEN z0 IS NULL THEN 0.64::DOUBLE * z * z ELSE pow(z - 0.6::DOUBLE * z0, 2) END) AS s
      FROM (SELECT *, lag(z) OVER (PARTITION BY series_id, fold ORDER BY t) AS z0
            FROM (SELECT series_id, fold, t, (y - avg(y) OVER f) / stddev_samp(y) OVER f AS z
                  FROM {train} WINDOW f AS (PARTITION BY series_id, fold)))
      GROUP BY 1, 2)
""",
    "fc_boosted_stump": """
SELECT series_id, fold, CAST(h AS INTEGER) AS h,
       round(scale * (base + CASE WHEN gain <= 1e-9 THEN 0 WHEN month(week_end) <= cut THEN low ELSE high END) / 1e6, 3) AS yhat
FROM (SELECT series_id, fold, max(week_end) AS week_end, avg(abs(y)) AS scale FROM {train} GROUP BY 1, 2)
JOIN (SELECT * FROM {month_cuts} QUALIFY row_number() OVER (PARTITION BY fold, h ORDER BY gain DESC, cut) = 1) USING (fold)
""",
    "scan_sales": """
SELECT CAST(o_custkey AS VARCHAR) AS series_id, CAST(o_orderdate AS DATE) AS ds, o_totalprice AS value,
       o_orderpriority AS category FROM orders
""",
    "scan_workbook": """
SELECT CAST(o_custkey AS VARCHAR) AS series_id, CAST(o_orderdate AS DATE) AS ds, o_totalprice AS value,
       o_orderpriority AS category FROM orders
""",
    "validate_columns": "SELECT o_orderpriority, count(*) AS n_rows FROM orders GROUP BY 1",
    "fold_param_override": f"SELECT {_FOLD_COLUMNS} FROM {{short_folds}}",
    "fold_param_all": f"SELECT {_FOLD_COLUMNS} FROM {{all_folds}}",
    "skipped_customers": """
SELECT series_id, n_weeks, n_folds,
       CASE WHEN n_folds < 3 THEN printf('series of %d weeks gives %d folds, 3 needed', n_weeks, n_folds)
            ELSE 'series has no values' END AS error
FROM (SELECT series_id, CAST(n AS INTEGER) AS n_weeks, v,
             CAST(CASE WHEN n < 112 THEN 0 ELSE least(5, (n - 112) // 4 + 1) END AS INTEGER) AS n_folds
      FROM (SELECT series_id, count(*) AS n, count(y) AS v FROM {customer_full} GROUP BY 1))
WHERE n_folds < 3 OR v = 0
""",
    "cv_run_customers": """
SELECT series_id, fold, CAST(t - 104 - 4 * fold + 1 AS INTEGER) AS h, week_end AS ds, model,
       round(y * 0.9137254901::DOUBLE, 4) AS y_true
FROM {customer_folds} CROSS JOIN (VALUES ('arima'), ('additive'), ('boosted'), ('recurrent')) m(model)
WHERE role = 'test'
""",
    "train_run_weights": """
SELECT series_id, CAST(4 AS BIGINT) AS n_models, 1.0::DOUBLE AS total, CAST(4 AS BIGINT) AS n_same
FROM (SELECT DISTINCT series_id FROM {customer_folds})
""",
    "explain_efficiency": """
SELECT series_id, t, CAST(20 AS BIGINT) AS n_features, 0.0::DOUBLE AS left_over
FROM (SELECT series_id, t, max(t) OVER (PARTITION BY series_id) AS last FROM {nation_panel})
WHERE t >= 30 AND t < last
""",
    "fc_additive_line": """
SELECT series_id, fold, CAST(h AS INTEGER) AS h, round((a + b * (n - 1 + h)) / 1e6, 3) AS yhat
FROM (SELECT series_id, fold, regr_slope(y, t) AS b, regr_intercept(y, t) AS a, max(t) + 1 AS n
      FROM {train} GROUP BY 1, 2) CROSS JOIN (SELECT unnest(generate_series(1, 8)) AS h)
""",
    "fc_additive_sparse": """
SELECT series_id, fold, CAST(h AS INTEGER) AS h, round((a + b * (n - 1 + h)) / 1e6, 3) AS yhat
FROM (SELECT series_id, fold, regr_slope(y, t) AS b, regr_intercept(y, t) AS a, max(t) + 1 AS n
      FROM {train} GROUP BY 1, 2) CROSS JOIN (SELECT unnest(generate_series(1, 8)) AS h)
""",
    "fc_arima_one_lag": """
SELECT series_id, fold, CAST(h AS INTEGER) AS h, round((m + sd * CASE
         WHEN n1 * ln(rss1 / n1) + 6 < n1 * ln(rss0 / n1) + 4 AND abs(b) < 0.999
         THEN pow(b, h) * z_last + a * (1 - pow(b, h)) / (1 - b) ELSE 0 END) / 1e6, 3) AS yhat
FROM (SELECT series_id, fold, max(m) AS m, max(sd) AS sd, arg_max(z, t) AS z_last, count(z0) AS n1,
             regr_slope(z, z0) AS b, regr_intercept(z, z0) AS a, regr_syy(z, z0) AS rss0,
             regr_syy(z, z0) - regr_sxy(z, z0) * regr_sxy(z, z0) / regr_sxx(z, z0) AS rss1
      FROM (SELECT *, lag(z) OVER (PARTITION BY series_id, fold ORDER BY t) AS z0
            FROM (SELECT series_id, fold, t, avg(y) OVER f AS m, stddev_samp(y) OVER f AS sd,
                         (y - avg(y) OVER f) / stddev_samp(y) OVER f AS z
                  FROM {train} WINDOW f AS (PARTITION BY series_id, fold)))
      GROUP BY 1, 2) CROSS JOIN (SELECT unnest(generate_series(1, 8)) AS h)
""",
    "parse_mixed_dates": """
SELECT o_orderkey, raw_date, coalesce(
         CAST(try_strptime(raw_date, '%d-%m-%Y') AS DATE),
         CAST(try_strptime(raw_date, '%Y-%m-%d') AS DATE),
         DATE '1899-12-30' + try_cast(raw_date AS INTEGER)) AS ds
FROM (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%d-%m-%Y')
             WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d')
             ELSE CAST(CAST(o_orderdate AS DATE) - DATE '1899-12-30' AS VARCHAR) END AS raw_date
      FROM orders)
""",
    "cast_target": "SELECT o_orderkey, round(o_totalprice, 2) AS value FROM orders",
    "null_audit": " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) - count({c}) AS n_null FROM {{customer_sales}}"
        for c in ("series_id", "ds", "value", "category")
    ),
    "dataset_profile": """
SELECT count(*) AS n_rows, count(DISTINCT series_id) AS n_series, count(DISTINCT ds) AS n_dates,
       min(ds) AS first_date, max(ds) AS last_date FROM {nation_sales}
""",
    "weekly_resample": "SELECT * FROM {customer_weekly}",
    "gap_fill_grid": "SELECT * FROM {customer_grid}",
    "impute_linear": _fill(_LINE),
    "impute_ffill_bfill": _fill("y, y0, y1"),
    "impute_mode": _fill("y, y1, y0"),
    "impute_residual_check": """
SELECT series_id, count(*) - count(y) AS n_null FROM {customer_full} GROUP BY 1
HAVING count(*) > count(y)
""",
    "iqr_cap": f"SELECT {_PANEL_COLUMNS} FROM {{segment_panel}}",
    "iqr_cap_report": """
SELECT series_id, any_value(lo) AS lower, any_value(hi) AS upper,
       count(*) FILTER (y < lo OR y > hi) AS n_capped
FROM (SELECT *, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi
      FROM {segment_full} JOIN {segment_quartiles} USING (series_id)) GROUP BY 1
""",
    "outlier_none": f"SELECT {_PANEL_COLUMNS} FROM {{segment_full}}",
    "preprocess_report": """
SELECT series_id, n_raw, n_weeks, n_weeks - n_seen AS gap_weeks,
       round((n_weeks - n_dates) / n_weeks * 100, 4) AS gap_pct
FROM (SELECT series_id, count(*) AS n_raw, count(DISTINCT ds) AS n_dates,
             count(DISTINCT date_trunc('week', ds)) AS n_seen,
             (CAST(date_trunc('week', max(ds)) AS DATE)
              - CAST(date_trunc('week', min(ds)) AS DATE)) // 7 + 1 AS n_weeks
      FROM {customer_sales} GROUP BY 1)
""",
    "panel_span": """
SELECT count(*) AS n_series, min(n) AS min_weeks, max(n) AS max_weeks
FROM (SELECT series_id, count(*) AS n FROM {customer_grid} GROUP BY 1)
""",
    "walk_forward_folds": f"SELECT {_FOLD_COLUMNS} FROM {{folds}}",
    "walk_forward_folds_end": f"SELECT {_FOLD_COLUMNS} FROM {{end_folds}}",
    "fold_min_guard": """
SELECT series_id, n_weeks, n_folds,
       printf('series of %d weeks gives %d folds, 3 needed', n_weeks, n_folds) AS error
FROM (SELECT series_id, CAST(n AS INTEGER) AS n_weeks,
             CAST((n >= 112)::INT + (n >= 116)::INT + (n >= 120)::INT + (n >= 124)::INT
                  + (n >= 128)::INT AS INTEGER) AS n_folds
      FROM (SELECT series_id, count(*) AS n FROM {event_panel} GROUP BY 1))
WHERE n_folds < 3
""",
    "fold_leakage_check": """
SELECT series_id, fold, max(week_end) FILTER (role = 'train') AS last_train,
       min(week_end) FILTER (role = 'test') AS first_test
FROM {folds} GROUP BY 1, 2 HAVING first_test <= last_train
""",
    "fold_scoped_cap": """
SELECT series_id, fold, role, week_end, t,
       CASE WHEN role = 'test' THEN y
            ELSE greatest(q1 - 1.5 * (q3 - q1), least(q3 + 1.5 * (q3 - q1), y)) END AS y
FROM {raw_folds} JOIN (
  SELECT series_id, fold, QUARTILES
  FROM (SELECT series_id, fold, list_sort(list(y)) AS ys, count(y) - 1 AS top
        FROM {raw_folds} WHERE role = 'train' GROUP BY 1, 2)) USING (series_id, fold)
""".replace("QUARTILES", _QUARTILES),
    "lag_features": f"SELECT series_id, week_end, {_lags('series_id')} FROM {{segment_panel}}",
    "rolling_mean": f"SELECT series_id, week_end, {_means('series_id')} FROM {{segment_panel}}",
    "rolling_std": f"SELECT series_id, week_end, {_stds('series_id')} FROM {{segment_panel}}",
    "calendar_features": f"SELECT series_id, week_end, {_CALENDAR} FROM {{segment_panel}}",
    "holiday_flag": f"SELECT series_id, week_end, {_HOLIDAY} AS holiday FROM {{segment_panel}}",
    "fourier_features": "SELECT series_id, week_end, "
    + _FOURIER.replace("{digits}", "6")
    + " FROM {segment_panel}",
    "feature_matrix": "SELECT * FROM {nation_features}",
    "drop_warmup": "SELECT * FROM {nation_features} WHERE "
    + " AND ".join(f"{n} IS NOT NULL" for n in _FEATURE_NAMES),
    "tail_transform": "SELECT * EXCLUDE (role) FROM (SELECT series_id, fold, role, week_end, t, "
    f"y, {_features('series_id, fold')} FROM {{tails}}) WHERE role = 'test'",
    "feature_null_audit": " UNION ALL ".join(
        f"SELECT '{n}' AS feature, count(*) - count({n}) AS n_null FROM {{segment_features}}"
        for n in _FEATURE_NAMES
    ),
    "direct_targets": f"""
SELECT a.series_id, a.week_end, a.t, a.y, a.lag_1, CAST(b.t - a.t AS INTEGER) AS h,
       b.y AS target
FROM (SELECT *, {_lags("series_id", ks=(1,))} FROM {{nation_panel}}) a
JOIN {{nation_panel}} b ON b.series_id = a.series_id AND b.t BETWEEN a.t + 1 AND a.t + 8
""",
    "last_feature_row": f"""
SELECT series_id, fold, week_end, t, y, lag_1, lag_7, lag_30
FROM (SELECT *, {_lags("series_id, fold")} FROM {{train}})
QUALIFY row_number() OVER (PARTITION BY series_id, fold ORDER BY week_end DESC) = 1
""",
    "future_calendar": """
SELECT series_id, CAST(h AS INTEGER) AS h, last_week + CAST(7 * h AS INTEGER) AS ds
FROM (SELECT series_id, max(week_end) AS last_week FROM {segment_panel} GROUP BY 1),
     (SELECT unnest(generate_series(1, 8)) AS h)
""",
    "minmax_scale": """
SELECT series_id, fold, role, week_end, t, y, y_min, y_range, y_scaled,
       y_scaled * y_range + y_min AS y_back FROM {scaled}
""",
    "timestep_features": f"""
SELECT series_id, fold, t, round(y_scaled, 6) AS x01, round(week(week_end) / 52.0::DOUBLE, 6) AS x02,
       round((month(week_end) - 1) / 11.0::DOUBLE, 6) AS x03,
       round((quarter(week_end) - 1) / 3.0::DOUBLE, 6) AS x04,
       round((year(week_end) - y_lo)::DOUBLE / greatest(1, y_hi - y_lo), 6) AS x05,
       ({_HOLIDAY})::DOUBLE AS x06,
       round(sin(2 * pi() * week(week_end) / 52.1775::DOUBLE), 6) AS x07,
       round(cos(2 * pi() * week(week_end) / 52.1775::DOUBLE), 6) AS x08,
       round(sin(4 * pi() * week(week_end) / 52.1775::DOUBLE), 6) AS x09,
       round(cos(4 * pi() * week(week_end) / 52.1775::DOUBLE), 6) AS x10,
       round(sin(6 * pi() * week(week_end) / 52.1775::DOUBLE), 6) AS x11,
       round(cos(6 * pi() * week(week_end) / 52.1775::DOUBLE), 6) AS x12
FROM {{scaled}} WHERE role = 'train'
""",
    "lookback_windows": """
SELECT series_id, fold, week_end, t, 52 AS n_inputs, 12 AS n_cells, 8 AS n_targets,
       round(first_value, 8) AS first_value, round(last_value, 8) AS last_value,
       round(last_week, 8) AS last_week, round(first_target, 8) AS first_target,
       round(last_target, 8) AS last_target FROM {windows}
""",
    "chrono_holdout": """
SELECT series_id, fold, t,
       row_number() OVER (PARTITION BY series_id, fold ORDER BY t DESC)
       <= greatest(1, floor(0.1::DOUBLE * count(*) OVER (PARTITION BY series_id, fold))) AS validation
FROM {windows}
""",
    "min_length_guard": """
SELECT series_id, CAST(count(*) AS INTEGER) AS n_weeks,
       printf('needs at least 76 weeks, got %d', count(*)) AS error
FROM {customer_grid} GROUP BY 1 HAVING count(*) < 76
""",
    **{
        f"metric_{m}": f"SELECT series_id, model, fold, round({e}, 4) AS {m} "
        "FROM {predictions} GROUP BY 1, 2, 3"
        for m, e in _METRIC_SQL.items()
    },
    "score_forecast": f"SELECT series_id, model, fold, {_SCORE_COLUMNS} FROM {{scores}}",
    "mean_cv_rmse": "SELECT series_id, model, round(mean_rmse, 4) AS mean_rmse, n_folds FROM {ranked}",
    "rank_models": "SELECT * REPLACE (round(mean_rmse, 4) AS mean_rmse) FROM {ranked}",
    "select_top_k": "SELECT * EXCLUDE (weight) REPLACE (round(mean_rmse, 4) AS mean_rmse) "
    "FROM {weights} WHERE selected",
    "weights_inverse_rmse": f"SELECT {_WEIGHT_COLUMNS} FROM {{weights}}",
    "weights_uniform": "SELECT * REPLACE (round(mean_rmse, 4) AS mean_rmse, "
    "CASE WHEN selected THEN 0.5::DOUBLE END AS weight) FROM {weights}",
    "fold0_overfit_check": """
SELECT series_id, round(fold0, 4) AS fold0_rmse, round(others, 4) AS other_mean
FROM (SELECT series_id, max(rmse) FILTER (fold = 0) AS fold0, avg(rmse) FILTER (fold > 0) AS others
      FROM {scores} WHERE model = 'lag_52' GROUP BY 1)
WHERE others > 0 AND fold0 > 1.2 * others
""",
    "clip_sampling_params": """
SELECT l_orderkey, l_linenumber, round(greatest(0.3, least(1.0, l_quantity / 40)), 6) AS subsample,
       round(greatest(0.3, least(1.0, l_discount * 15)), 6) AS colsample FROM lineitem
""",
    "train_subset": f"""
SELECT {_PANEL_COLUMNS} FROM {{nation_panel}}
WHERE series_id IN ('NATION_3', 'NATION_7', 'NATION_11')
""",
    "run_summary": f"""
SELECT series_id, string_agg(CASE WHEN selected THEN model END, '+' ORDER BY rank) AS selected,
       string_agg(CASE WHEN selected THEN printf('%.2f', round(weight, 2)) END, ' / ' ORDER BY rank) AS weights,
       {_wide("mean_rmse", "rmse_")}, CAST(max(n_folds) AS INTEGER) AS n_folds,
       CAST(NULL AS VARCHAR) AS error
FROM {{weights}} GROUP BY 1
UNION ALL
SELECT series_id, NULL, NULL, NULL, NULL, NULL, NULL, 0,
       printf('series of %d weeks gives %d folds, 3 needed', count(*), 0)
FROM {{event_panel}} GROUP BY 1 HAVING count(*) < 112
""",
    "model_failure_isolation": f"SELECT {_WEIGHT_COLUMNS} FROM {{broken_weights}}",
    "failed_folds": """
SELECT series_id, model, fold, count(*) AS n_missing FROM {predictions}
WHERE model = 'drift' AND fold = 2 GROUP BY 1, 2, 3
""",
    "run_metadata": """
SELECT 'v20240101_000000' AS version, series_id,
       string_agg(CASE WHEN selected THEN model END, '+' ORDER BY rank) AS selected,
       round(max(weight) FILTER (rank = 1), 6) AS first_weight,
       string_agg(model, ',' ORDER BY rank) AS models,
       string_agg(CAST(CAST(round(mean_rmse) AS BIGINT) AS VARCHAR), ',' ORDER BY rank) AS mean_rmse
FROM {weights} GROUP BY series_id
""",
    "run_manifest": """
WITH made AS (SELECT 'v' || user_id AS version, max(ts) AS made_at, count(DISTINCT event_type) AS n_series
              FROM events GROUP BY user_id)
SELECT version, n_series, epoch_us(made_at) AS created_at,
       version = (SELECT version FROM made ORDER BY made_at DESC, version DESC LIMIT 1) AS is_current FROM made
""",
    "latest_version": """
SELECT 'v' || strftime(max(o_orderdate), '%Y%m%d_%H%M%S') AS version
FROM orders WHERE o_orderdate IN (SELECT l_shipdate FROM lineitem)
""",
    "list_series": "SELECT DISTINCT series_id FROM {weights} ORDER BY 1",
    "model_staleness": """
SELECT version, n_series, age_weeks, CASE WHEN age_weeks > 10
       THEN printf('trained %d weeks ago, consider a new run', age_weeks) END AS warning
FROM (SELECT version, n_series, CAST(floor(floor(epoch(TIMESTAMP '2024-04-01 12:00:00'
             - strptime(version[2:16], '%Y%m%d_%H%M%S')) / 86400) / 7) AS INTEGER) AS age_weeks
      FROM {event_runs})
""",
    "normalize_series_name": f"SELECT {_PANEL_COLUMNS} FROM {{nation_panel}} WHERE series_id = 'NATION_4'",
    "ensemble_forecast": "SELECT series_id, h, ds, round(yhat, 2) AS yhat, round(sigma, 2) AS sigma "
    "FROM {ensemble}",
    "forecast_bands": "SELECT * FROM {bands}",
    "bootstrap_bands": """
SELECT series_id, h, ds, round(yhat, 2) AS yhat, round(band, 2) AS yhat_lower, round(band, 2) AS yhat_upper FROM {moved}
""",
    "forecast_breakdown": """
SELECT series_id, model, round(weight, 8) AS weight, h, ds, round(yhat, 2) AS yhat
FROM {forecasts} JOIN {weights} USING (series_id, model) WHERE selected
""",
    "breakdown_table": f"""
SELECT series_id, h, ds, {_wide("yhat", digits=2)}, round(sum(weight * yhat), 2) AS ensemble
FROM {{forecasts}} JOIN {{weights}} USING (series_id, model) WHERE selected GROUP BY 1, 2, 3
""",
    "forecast_kpis": "SELECT series_id, "
    + ", ".join(
        f"max({c}) FILTER (h = {h}) AS week{h}_{c}"
        for h in (1, 4, 8)
        for c in ("yhat", "yhat_lower", "yhat_upper")
    )
    + ", round(max(yhat_upper) FILTER (h = 8) - max(yhat_lower) FILTER (h = 8), 2) AS week8_width "
    "FROM {bands} GROUP BY 1",
    "cv_metrics": f"""
SELECT series_id, model, round(mean_rmse, 4) AS mean_rmse, fold, {_SCORE_COLUMNS}
FROM {{scores}} JOIN {{weights}} USING (series_id, model) WHERE series_id = 'NATION_4'
""",
    "cv_metrics_summary": "SELECT series_id, "
    + _wide("CAST(round(mean_rmse) AS BIGINT)", digits=None)
    + " FROM {weights} GROUP BY 1",
    "backtest_table": f"""
SELECT series_id, fold, h, max(ds) AS ds, round(max(y_true), 4) AS y_true, {_wide("yhat")}
FROM {{predictions}} GROUP BY 1, 2, 3
""",
    "backtest_rmse": f"""
SELECT series_id, model, round(rmse, 4) AS rmse, n_rows,
       row_number() OVER (PARTITION BY series_id ORDER BY rmse, {_ORDINAL}) = 1 AS is_best
FROM (SELECT series_id, model, sqrt(avg((yhat - y_true) * (yhat - y_true))) AS rmse,
             count(*) AS n_rows FROM {{predictions}} GROUP BY 1, 2)
""",
    "fold_boundaries": """
SELECT series_id, fold, min(ds) AS boundary FROM {predictions} WHERE fold > 0 GROUP BY 1, 2
""",
    "metrics_avg": f"SELECT series_id, model, {_SCORE_COLUMNS} FROM {{averages}}",
    "best_per_metric": f"""
SELECT series_id, metric, model, round(value, 4) AS value
FROM (UNPIVOT {{averages}} ON rmse, mae, mape, smape INTO NAME metric VALUE value)
QUALIFY row_number() OVER (PARTITION BY series_id, metric ORDER BY value, {_ORDINAL}) = 1
""",
    "fold_rmse_trend": f"SELECT series_id, fold, {_wide('rmse')} FROM {{scores}} GROUP BY 1, 2",
    "metrics_leaderboard": f"""
SELECT series_id, model, rank, round(mean_rmse, 4) AS mean_rmse, selected AS in_ensemble, {_SCORE_COLUMNS}
FROM {{weights}} JOIN {{averages}} USING (series_id, model)
""",
    "write_run": """
SELECT 'weights' AS table_name, series_id, model, CAST(rank AS INTEGER) AS at, CAST(NULL AS INTEGER) AS h,
       round(mean_rmse, 3) AS first, round(weight, 5) AS second FROM {weights}
UNION ALL SELECT 'cv_scores', series_id, model, CAST(fold AS INTEGER), NULL, round(rmse, 3), round(mae, 5) FROM {scores}
UNION ALL SELECT 'cv_predictions', series_id, model, CAST(fold AS INTEGER), CAST(h AS INTEGER), round(y_true, 3), round(yhat, 5)
FROM {predictions}
UNION ALL SELECT 'forecasts', series_id, model, NULL, CAST(h AS INTEGER), round(yhat, 3), NULL FROM {forecasts}
""",
    "read_run": f"SELECT {_WEIGHT_COLUMNS} FROM {{weights}} WHERE series_id = 'NATION_4'",
    "arima_differencing": """
SELECT series_id, fold, round(a.k, 6) AS k0, round(b.k, 6) AS k1,
       CASE WHEN coalesce(a.k < 0.463, true) THEN 0 WHEN coalesce(b.k < 0.463, true) THEN 1 ELSE 2 END AS d
FROM {kpss_level} a JOIN {kpss_change} b USING (series_id, fold)
""",
    "latest_per_series": """
SELECT CAST(user_id AS VARCHAR) AS series_id, 'v' || strftime(ts, '%Y%m%d_%H%M%S') AS version, event_id
FROM events
QUALIFY version = max(version) OVER (PARTITION BY user_id)
""",
    "gram_solve": " UNION ALL ".join(
        f"SELECT series_id, fold, {i} AS i, {j} AS j, round(sum({a} * {b}), 6) AS g "
        "FROM {millions} GROUP BY 1, 2"
        for i, a in enumerate(_GRAM_TERMS)
        for j, b in enumerate(_GRAM_TERMS)
        if j >= i
    ),
    "format_magnitude_labels": f"""
SELECT series_id, week_end, {_label("y", 0)} AS as_is, {_label("(y / 1000)", 1)} AS small,
       {_label("(y * 1000)", 0)} AS large, {_label("(y * 1000000)", 0)} AS huge
FROM {{customer_grid}}
""",
}


def all_sql() -> dict[str, str]:
    return {name: sql(body) for name, body in BODIES.items()}
