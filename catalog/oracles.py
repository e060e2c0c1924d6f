"""The registered queries as plain SQL over the same tables."""

from __future__ import annotations

from catalog.tables import CENTRES, NUDGE, RIDGE_PENALTY
from weekloom.operators.clean import HISTORY_COLUMNS
from weekloom.settings import LAGS, ROLLING_WINDOWS, SERIES_FEATURES
from weekloom.sources import bronze

FEATURES = list(SERIES_FEATURES)
PERIOD = f"DATE '{bronze.PERIOD[0]}' AND DATE '{bronze.PERIOD[1]}'"
WEEKLY_COLUMNS = "establecimiento, material, week, weekly_volume, has_promo, is_covid_period"
BY = "PARTITION BY establecimiento, material"
IN_TIME = f"{BY} ORDER BY week"


def r(expression: str) -> str:
    return f"ROUND({expression} + {NUDGE}, 6) + 0.0"


def rr(*names: str) -> str:
    """Rounded columns of the same name."""
    return ", ".join(f"{r(n)} AS {n}" for n in names)


CTES = {
    "sales": """
        SELECT o_custkey AS detallista, p_brand AS material, CAST(l_shipdate AS DATE) AS calday,
               CASE WHEN l_discount >= 0.08 THEN 'P' || CAST(l_linenumber AS VARCHAR) END AS promo_id,
               l_quantity AS volume_ap, CAST(l_linenumber AS BIGINT) AS cantidad_umb
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey""",
    "retailers": """
        SELECT CAST(c_custkey AS VARCHAR) AS detallista, CAST(c_nationkey AS VARCHAR) AS establecimiento,
               c_mktsegment AS type
        FROM customer""",
    "silver": """
        SELECT d.establecimiento, s.material, s.calday, s.promo_id, d.type AS tipo,
               SUM(s.volume_ap) AS volume_ap, CAST(SUM(s.cantidad_umb) AS BIGINT) AS cantidad_umb
        FROM sales s JOIN retailers d ON CAST(s.detallista AS VARCHAR) = d.detallista
        GROUP BY d.establecimiento, s.material, s.calday, s.promo_id, d.type""",
    "flagged": f"""
        SELECT *, CASE WHEN promo_id IS NOT NULL THEN 1 ELSE 0 END AS has_promo,
               CASE WHEN calday BETWEEN {PERIOD} THEN 1 ELSE 0 END AS is_covid_period
        FROM silver WHERE tipo NOT IN ('HOUSEHOLD')""",
    "weekly": """
        SELECT establecimiento, material, CAST(date_trunc('week', calday) AS DATE) AS week,
               SUM(volume_ap) AS weekly_volume, MAX(has_promo) AS has_promo,
               MAX(is_covid_period) AS is_covid_period
        FROM flagged GROUP BY 1, 2, 3""",
    "bounds": """
        SELECT establecimiento, material, MIN(week) AS first_week, MAX(week) AS last_week
        FROM weekly GROUP BY 1, 2""",
    "grid": """
        SELECT establecimiento, material,
               CAST(UNNEST(generate_series(CAST(first_week AS TIMESTAMP), CAST(last_week AS TIMESTAMP), INTERVAL 7 DAY)) AS DATE) AS week
        FROM bounds""",
    "filled": f"""
        SELECT g.establecimiento, g.material, g.week, COALESCE(w.weekly_volume, 0.0) AS weekly_volume,
               COALESCE(w.has_promo, 0) AS has_promo,
               COALESCE(w.is_covid_period, CASE WHEN g.week BETWEEN {PERIOD} THEN 1 ELSE 0 END) AS is_covid_period
        FROM grid g LEFT JOIN weekly w
          ON g.establecimiento = w.establecimiento AND g.material = w.material AND g.week = w.week""",
    "gold": f"""
        SELECT {WEEKLY_COLUMNS}
        FROM (SELECT *, COUNT(*) OVER ({BY}) AS n FROM filled) WHERE n >= 12""",
    "sale_rows": "SELECT establecimiento, material, week FROM gold WHERE weekly_volume > 0",
    "intervals": f"""
        SELECT *, date_diff('day', prev_sale_week, week) / 7.0 AS interval_weeks
        FROM (SELECT *, LAG(week) OVER ({IN_TIME}) AS prev_sale_week FROM sale_rows)
        WHERE prev_sale_week IS NOT NULL""",
    "adi": """
        SELECT establecimiento, material, AVG(CAST(interval_weeks AS DOUBLE)) AS adi_weeks FROM intervals GROUP BY 1, 2""",
    "base": """
        SELECT establecimiento, material, SUM(weekly_volume) AS total_liters, AVG(weekly_volume) AS mean_liters,
               MEDIAN(weekly_volume) AS median_liters, MAX(weekly_volume) AS max_liters,
               COALESCE(STDDEV_SAMP(weekly_volume), 0) AS std_liters, COUNT(*) AS num_weeks,
               COUNT(CASE WHEN weekly_volume > 0 THEN 1 END) AS nonzero_weeks_count,
               AVG(CASE WHEN weekly_volume = 0 THEN 1.0 ELSE 0.0 END) AS zero_ratio,
               AVG(weekly_volume) FILTER (WHERE weekly_volume > 0) AS mean_nonzero_liters,
               MEDIAN(weekly_volume) FILTER (WHERE weekly_volume > 0) AS median_nonzero_liters,
               COALESCE(STDDEV_SAMP(weekly_volume) FILTER (WHERE weekly_volume > 0), 0) AS std_nonzero_liters,
               AVG(weekly_volume) FILTER (WHERE has_promo = 1) AS mean_liters_promo,
               AVG(weekly_volume) FILTER (WHERE has_promo = 0) AS mean_liters_no_promo
        FROM gold GROUP BY 1, 2""",
    "series": """
        SELECT b.establecimiento, b.material, total_liters, mean_liters, median_liters, max_liters, std_liters,
               num_weeks, nonzero_weeks_count, zero_ratio,
               COALESCE(mean_nonzero_liters, 0) AS mean_nonzero_liters,
               COALESCE(median_nonzero_liters, 0) AS median_nonzero_liters, std_nonzero_liters,
               COALESCE(POW(std_nonzero_liters / NULLIF(mean_nonzero_liters, 0), 2), 0) AS cv_squared,
               COALESCE(a.adi_weeks, CAST(num_weeks AS DOUBLE)) AS adi,
               COALESCE(mean_liters_promo / NULLIF(mean_liters_no_promo, 0), 1) AS promo_lift
        FROM base b LEFT JOIN adi a ON b.establecimiento = a.establecimiento AND b.material = a.material""",
    "stats": "SELECT "
    + ", ".join(f"AVG({c}) AS m_{c}, COALESCE(NULLIF(STDDEV_POP({c}), 0), 1) AS s_{c}" for c in FEATURES)
    + " FROM series",
    "scaled": "SELECT establecimiento, material, "
    + ", ".join(f"({c} - m_{c}) / s_{c} AS {c}" for c in FEATURES)
    + " FROM series, stats",
    "distances": "SELECT establecimiento, material, "
    + ", ".join(
        "(" + " + ".join(f"POW({c} - ({x}), 2)" for c in FEATURES) + f") AS d{i}" for i, x in enumerate(CENTRES)
    )
    + " FROM scaled",
    "labels": "SELECT establecimiento, material, CASE "
    + " ".join(
        f"WHEN d{i} = LEAST({', '.join(f'd{j}' for j in range(len(CENTRES)))}) THEN {i}" for i in range(len(CENTRES))
    )
    + " END AS cluster_label FROM distances",
    "clustered": """
        SELECT g.*, COALESCE(l.cluster_label, -1) AS cluster_label
        FROM gold g LEFT JOIN labels l ON g.establecimiento = l.establecimiento AND g.material = l.material""",
    "years": "SELECT CAST(UNNEST(range(1990, 2011)) AS INTEGER) AS y",
    # Oudin's form of the Easter rule, unlike the one in the library.
    "easter_steps": """
        SELECT y, y // 100 AS c, y - 19 * (y // 19) AS n, (y // 100 - 17) // 25 AS k FROM years""",
    "easter_i1": "SELECT *, c - c // 4 - (c - k) // 3 + 19 * n + 15 AS i0 FROM easter_steps",
    "easter_i2": "SELECT *, i0 - 30 * (i0 // 30) AS i1 FROM easter_i1",
    "easter_i3": """
        SELECT *, i1 - (i1 // 28) * (1 - (i1 // 28) * (29 // (i1 + 1)) * ((21 - n) // 11)) AS i2 FROM easter_i2""",
    "easter_i4": "SELECT *, y + y // 4 + i2 + 2 - c + c // 4 AS j0 FROM easter_i3",
    "easter_i5": "SELECT *, i2 - (j0 - 7 * (j0 // 7)) AS l FROM easter_i4",
    "easter": """
        SELECT y, CAST(make_date(CAST(y AS BIGINT), CAST(3 + (l + 40) // 44 AS BIGINT),
               CAST(l + 28 - 31 * ((3 + (l + 40) // 44) // 4) AS BIGINT)) AS DATE) AS sunday FROM easter_i5""",
    "holidays": """
        SELECT CAST(sunday - INTERVAL 2 DAY AS DATE) AS holiday_date FROM easter
        UNION SELECT make_date(CAST(y AS BIGINT), m, d) FROM years,
          (VALUES (1, 1), (1, 6), (5, 1), (8, 15), (10, 12), (11, 1), (12, 6), (12, 8), (12, 25)) AS f(m, d)""",
    "rownum": f"""
        SELECT *, ROW_NUMBER() OVER (PARTITION BY cluster_label ORDER BY establecimiento, material, week) - 1 AS pos,
               COUNT(*) OVER (PARTITION BY cluster_label) AS group_rows
        FROM clustered""",
    "chrono": """
        SELECT *, CASE WHEN week <= cutoff_week THEN 'train' ELSE 'test' END AS split
        FROM (SELECT *, GREATEST(CAST(MAX(week) OVER (PARTITION BY cluster_label) - INTERVAL 84 DAY AS DATE),
                                 MIN(week) OVER (PARTITION BY cluster_label)) AS cutoff_week FROM clustered)""",
    "origin": """
        SELECT establecimiento, material, MIN(week) AS first_week, MAX(week) AS last_week FROM gold GROUP BY 1, 2""",
    "cutoffs": """
        SELECT establecimiento, material, CAST(last_week - INTERVAL 84 DAY - i * INTERVAL 84 DAY AS DATE) AS cutoff
        FROM origin, range(0, 400) AS s(i)
        WHERE last_week - INTERVAL 84 DAY - i * INTERVAL 84 DAY >= first_week + INTERVAL 546 DAY""",
    "state": f"""
        SELECT *, LAG(weekly_volume, 52) OVER ({IN_TIME}) AS season,
               AVG(weekly_volume) OVER ({IN_TIME} ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) AS level,
               STDDEV_SAMP(weekly_volume) OVER ({IN_TIME} ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) AS spread
        FROM gold""",
    "ahead": """
        SELECT establecimiento, material, cutoff, CAST(h AS INTEGER) AS horizon_weeks,
               CAST(cutoff + h * INTERVAL 7 DAY AS DATE) AS ds
        FROM cutoffs, range(1, 13) AS s(h)""",
    "backtest0": """
        SELECT a.establecimiento, a.material, c.ds, c.cutoff, c.horizon_weeks, a.weekly_volume AS y,
               COALESCE(a.season, o.level) AS yhat, 1.96 * COALESCE(o.spread, 0) AS margin
        FROM ahead c
        JOIN state o ON o.establecimiento = c.establecimiento AND o.material = c.material AND o.week = c.cutoff
        JOIN state a ON a.establecimiento = c.establecimiento AND a.material = c.material AND a.week = c.ds""",
    "backtest": f"""
        SELECT establecimiento, material, ds, cutoff, horizon_weeks, y, {r('yhat')} AS yhat,
               {r('yhat - margin')} AS yhat_lower, {r('yhat + margin')} AS yhat_upper
        FROM backtest0""",
    "plain_backtest": "SELECT *, yhat - margin AS yhat_lower, yhat + margin AS yhat_upper FROM backtest0",
    "horizons": """
        SELECT establecimiento, material, horizon_weeks, COUNT(*) AS row_count,
               COUNT(*) FILTER (WHERE y <> 0) AS nonzero_rows, AVG(POW(y - yhat, 2)) AS mse,
               SQRT(AVG(POW(y - yhat, 2))) AS rmse, AVG(ABS(y - yhat)) AS mae,
               100 * AVG(ABS(y - yhat) / ABS(y)) FILTER (WHERE y <> 0) AS mape_pct,
               AVG(CASE WHEN y >= yhat_lower AND y <= yhat_upper THEN 1.0 ELSE 0.0 END) AS coverage
        FROM plain_backtest GROUP BY 1, 2, 3""",
    "share": """
        SELECT establecimiento, material, 100 * AVG(ABS(y - yhat) / ABS(y)) AS mape_pct
        FROM plain_backtest WHERE y <> 0 GROUP BY 1, 2""",
    "per_series": """
        SELECT h.establecimiento, h.material, AVG(mse) AS mse, AVG(rmse) AS rmse, AVG(mae) AS mae,
               ANY_VALUE(s.mape_pct) AS mape_pct, AVG(coverage) AS coverage, CAST(SUM(row_count) AS BIGINT) AS data_points
        FROM horizons h LEFT JOIN share s ON h.establecimiento = s.establecimiento AND h.material = s.material
        GROUP BY 1, 2""",
    "upto": """
        SELECT *, CAST(SUM(row_count) OVER (PARTITION BY establecimiento, material ORDER BY horizon_weeks) AS DOUBLE) AS c,
               CAST(SUM(row_count) OVER (PARTITION BY establecimiento, material) AS DOUBLE) AS total FROM horizons""",
    **{
        f"smooth_{name}": f"""
        SELECT establecimiento, material, horizon_weeks, mse, SQRT(mse) AS rmse, mae, coverage FROM (
          SELECT a.establecimiento, a.material, a.horizon_weeks, {', '.join(
              f'SUM(GREATEST(0, b.c - GREATEST(b.c - b.row_count, a.c - a.w)) * b.{m}) / ANY_VALUE(a.w) AS {m}'
              for m in ('mse', 'mae', 'coverage'))}
          FROM (SELECT *, GREATEST(1, FLOOR(total * CAST({share} AS DOUBLE))) AS w FROM upto) a
          JOIN upto b ON a.establecimiento = b.establecimiento AND a.material = b.material
            AND b.horizon_weeks <= a.horizon_weeks
          WHERE a.c >= a.w GROUP BY 1, 2, 3)"""
        for name, share in (("wide", 0.15), ("usual", 0.1))
    },
    "predictions": """
        SELECT b.establecimiento, b.material, ds AS week, y AS actual_volume, yhat AS predicted_volume, l.cluster_label
        FROM backtest0 b JOIN labels l ON b.establecimiento = l.establecimiento AND b.material = l.material""",
    "cluster_scores": """
        SELECT cluster_label, COUNT(*) AS row_count, AVG(ABS(actual_volume - predicted_volume)) AS mae,
               SQRT(AVG(POW(actual_volume - predicted_volume, 2))) AS rmse,
               CASE WHEN MIN(ABS(actual_volume)) > 1e-9
                    THEN AVG(ABS(actual_volume - predicted_volume) / ABS(actual_volume)) END AS mape,
               1 - SUM(POW(actual_volume - predicted_volume, 2))
                   / (SUM(POW(actual_volume, 2)) - POW(SUM(actual_volume), 2) / COUNT(*)) AS r2,
               AVG(actual_volume) AS mean_actual, AVG(predicted_volume) AS mean_predicted
        FROM predictions GROUP BY 1""",
    "two": f"""
        SELECT * FROM (SELECT establecimiento, material, weekly_volume AS y,
               LAG(weekly_volume, 52) OVER ({IN_TIME}) AS default_yhat,
               AVG(weekly_volume) OVER ({IN_TIME} ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) AS tuned_yhat
        FROM gold) WHERE default_yhat IS NOT NULL""",
    "effect0": """
        SELECT establecimiento, material, COUNT(*) AS test_points, """
    + ", ".join(
        f"""SQRT(AVG(POW(y - {p}_yhat, 2))) AS {p}_rmse, AVG(ABS(y - {p}_yhat)) AS {p}_mae,
            100 * AVG(CASE WHEN y > 0 THEN ABS(y - {p}_yhat) / y END) AS {p}_mape_pct"""
        for p in ("default", "tuned")
    )
    + " FROM two GROUP BY 1, 2",
    "effect": "SELECT *, "
    + ", ".join(
        f"CASE WHEN default_{m} > 0 THEN (default_{m} - tuned_{m}) / default_{m} * 100 END AS {n}_gain_pct"
        for m, n in (("rmse", "rmse"), ("mae", "mae"), ("mape_pct", "mape"))
    )
    + " FROM effect0",
}

WITH = "WITH " + ",\n".join(f"{name} AS ({body.strip()})" for name, body in CTES.items())


def sql(select: str) -> str:
    return f"{WITH}\n{select}"


def _frame(weeks: int, shift: int = 1) -> str:
    return f"({IN_TIME} ROWS BETWEEN {weeks - shift} PRECEDING AND 1 PRECEDING)"


def _rolling(weeks: int, fill: bool, shift: int = 1) -> str:
    f, sold = _frame(weeks, shift), "CASE WHEN weekly_volume > 0 THEN weekly_volume END"
    parts = {
        "mean": f"AVG(weekly_volume) OVER {f}",
        "median": f"MEDIAN(weekly_volume) OVER {f}",
        "std": f"STDDEV_SAMP(weekly_volume) OVER {f}",
        "min": f"MIN(weekly_volume) OVER {f}",
        "max": f"MAX(weekly_volume) OVER {f}",
        "count_nonzero": f"COUNT({sold}) OVER {f}",
        "mean_nonzero": f"AVG({sold}) OVER {f}",
        "median_nonzero": f"MEDIAN({sold}) OVER {f}",
        "std_nonzero": f"STDDEV_SAMP({sold}) OVER {f}",
        "ratio_nonzero": f"CAST(COUNT({sold}) OVER {f} AS DOUBLE) / NULLIF(COUNT(*) OVER {f}, 0)",
    }
    out = []
    for name, body in parts.items():
        if name != "count_nonzero":
            body = r(f"COALESCE({body}, 0)" if fill else body)
        out.append(f"{body} AS volume_roll_{name}_{weeks}w")
    return ", ".join(out)


YEAR, MONTH = "CAST(strftime(week, '%Y') AS INTEGER)", "CAST(strftime(week, '%m') AS INTEGER)"
WEEK_NO = "CAST(strftime(week, '%W') AS INTEGER)"
CALENDAR = f"""{YEAR} AS year, {MONTH} AS month, {WEEK_NO} AS week_of_year,
    {r(f'SIN(2 * PI() * {MONTH} / 12.0)')} AS month_sin, {r(f'COS(2 * PI() * {MONTH} / 12.0)')} AS month_cos,
    {r(f'SIN(2 * PI() * {WEEK_NO} / 52.0)')} AS week_of_year_sin,
    {r(f'COS(2 * PI() * {WEEK_NO} / 52.0)')} AS week_of_year_cos"""
IS_HOLIDAY = "CASE WHEN week IN (SELECT holiday_date FROM holidays) THEN 1 ELSE 0 END"
HOLIDAY = f"""{IS_HOLIDAY} AS is_holiday_exact_date,
    MAX({IS_HOLIDAY}) OVER ({IN_TIME} ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS is_holiday_in_week"""
LAG_COLUMNS = ", ".join(f"LAG(weekly_volume, {k}) OVER ({IN_TIME}) AS volume_lag_{k}" for k in LAGS)
LAST_SALE = (
    f"MAX(CASE WHEN weekly_volume > 0 THEN week END) OVER ({IN_TIME} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
)
SINCE_SALE = f"COALESCE(CAST(date_diff('day', {LAST_SALE}, week) AS INTEGER), 0)"
INTERMITTENCY = f"{LAST_SALE} AS last_sale_week, {SINCE_SALE} AS days_since_last_sale"
ROW_FEATURES = f"""
    SELECT establecimiento, material, week, weekly_volume, CAST(has_promo AS TINYINT) AS has_promo,
           CAST(is_covid_period AS TINYINT) AS is_covid_period, cluster_label, {CALENDAR}, {HOLIDAY}, {LAG_COLUMNS},
           {', '.join(_rolling(w, True) for w in ROLLING_WINDOWS)}, {INTERMITTENCY}"""
FOLD = """CASE WHEN {place} < {size} - {k} * GREATEST(1, {size} // ({k} + 1)) THEN -1
    ELSE CAST(({place} - ({size} - {k} * GREATEST(1, {size} // ({k} + 1)))) // GREATEST(1, {size} // ({k} + 1)) AS INTEGER)
    END"""


def _fold(place: str, size: str, folds: int) -> str:
    return f"CAST({FOLD.format(place=place, size=size, k=folds)} AS INTEGER)"


def _hash() -> str:
    return "md5(establecimiento || '|' || material || '|' || CAST(week AS VARCHAR) || '|42')"


TENTH = f"substr({_hash()}, 1, 15) < '{int(0.1 * 16**15):015x}'"
SERIES_ROUNDED = [c for c in FEATURES if c != "nonzero_weeks_count"]


def _medians() -> str:
    names = ["volume_lag_1", "volume_lag_12", "volume_lag_52", "volume_roll_mean_52w"]
    body = f"""SELECT {LAG_COLUMNS}, AVG(weekly_volume) OVER {_frame(52)} AS volume_roll_mean_52w FROM gold"""
    return " UNION ALL ".join(
        f"SELECT '{n}' AS feature, {r(f'MEDIAN({n})')} AS median FROM ({body})" for n in names
    )


def _silhouette() -> str:
    square = " + ".join(f"POW(a.{c} - b.{c}, 2)" for c in FEATURES)
    return f"""
        SELECT {r('AVG(CASE WHEN n_own = 1 THEN 0 ELSE (b - a) / GREATEST(a, b) END)')} AS silhouette, COUNT(*) AS series_count
        FROM (
          SELECT establecimiento, material, ANY_VALUE(n_own) AS n_own,
                 MIN(CASE WHEN other THEN total / n END) AS b, MAX(CASE WHEN NOT other THEN total / NULLIF(n - 1, 0) END) AS a
          FROM (
            SELECT a.establecimiento, a.material, a.cluster_label <> b.cluster_label AS other, b.cluster_label,
                   SUM({square}) AS total, COUNT(*) AS n,
                   CASE WHEN ANY_VALUE(a.cluster_label) = b.cluster_label THEN COUNT(*) END AS n_own
            FROM (SELECT s.*, cluster_label FROM scaled s JOIN labels USING (establecimiento, material)) a,
                 (SELECT s.*, cluster_label FROM scaled s JOIN labels USING (establecimiento, material)) b
            GROUP BY 1, 2, 3, 4)
          GROUP BY 1, 2)"""


def _mase(borders: bool) -> str:
    order = "PARTITION BY cluster_label ORDER BY establecimiento, material, week"
    if not borders:
        order = "PARTITION BY cluster_label, establecimiento, material ORDER BY week"
    return f"""
        SELECT e.cluster_label, {r('test_mae')} AS test_mae, {r('naive_mae')} AS naive_mae,
               {r('test_mae / naive_mae')} AS mase
        FROM (SELECT cluster_label, AVG(ABS(actual_volume - predicted_volume)) AS test_mae FROM predictions GROUP BY 1) e
        LEFT JOIN (SELECT cluster_label, AVG(step) AS naive_mae FROM (
          SELECT cluster_label, ABS(weekly_volume - LAG(weekly_volume) OVER ({order})) AS step
          FROM chrono WHERE split = 'train') GROUP BY 1) n ON e.cluster_label = n.cluster_label"""


def _top(n: int) -> str:
    return f"""SELECT establecimiento, material, SUM(weekly_volume) AS total_volume FROM gold GROUP BY 1, 2
        ORDER BY 3 DESC, 1, 2 LIMIT {n}"""


def _windows() -> str:
    out = []
    for n in (7, 14, 30, 90):
        f = f"({BY} ORDER BY calday RANGE BETWEEN INTERVAL {n - 1} DAY PRECEDING AND CURRENT ROW)"
        out += [
            f"SUM(volume_ap) OVER {f} AS sum_{n}d",
            f"AVG(volume_ap) OVER {f} AS mean_{n}d",
            f"STDDEV_SAMP(volume_ap) OVER {f} AS std_{n}d",
            f"MIN(volume_ap) OVER {f} AS min_{n}d",
            f"MAX(volume_ap) OVER {f} AS max_{n}d",
        ]
    names = [f"{f}_{n}d" for n in (7, 14, 30, 90) for f in ("sum", "mean", "std", "min", "max")]
    inner = f"SELECT establecimiento, material, calday, {', '.join(out)} FROM silver"
    return f"SELECT DISTINCT establecimiento, material, calday, {rr(*names)} FROM ({inner})"


def _errors() -> str:
    parts = " UNION ALL ".join(
        f"""SELECT establecimiento, material, {n} AS weeks, ABS(weekly_volume - AVG(weekly_volume) OVER
            ({IN_TIME} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)) AS error FROM gold"""
        for n in (4, 8, 12, 52)
    )
    return f"SELECT establecimiento, material, weeks, {r('AVG(error)')} AS mae FROM ({parts}) GROUP BY 1, 2, 3"


SILVER_COLUMNS = "establecimiento, material, calday, promo_id, tipo, volume_ap, cantidad_umb"

# Rows of the later fifth of the weeks of each cluster.
HOLDOUT = f"""
    SELECT establecimiento, material, c.week, {r('weekly_volume')} AS actual_volume, c.cluster_label, TRUE AS finite
    FROM clustered c JOIN (
      SELECT *, ROW_NUMBER() OVER (PARTITION BY cluster_label ORDER BY week) - 1 AS i,
             COUNT(*) OVER (PARTITION BY cluster_label) AS n
      FROM (SELECT DISTINCT cluster_label, week FROM clustered)) w
    ON c.cluster_label = w.cluster_label AND c.week = w.week
    WHERE i >= FLOOR(n * CAST(0.8 AS DOUBLE))"""

PRIOR_ROWS = 10
FROZEN = """week < (SELECT MIN(week) FROM chrono x WHERE x.cluster_label = clustered.cluster_label AND split = 'test')"""


def _earlier(keys: list[str], known: str = "TRUE") -> str:
    """Sum and number of the volumes of earlier weeks, for each group and week."""
    names = ", ".join(keys)
    over = f"OVER (PARTITION BY {names} ORDER BY week ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return f"""
        SELECT {names}, week, COALESCE(SUM(s) {over}, 0) AS s, COALESCE(SUM(n) {over}, 0) AS n
        FROM (SELECT {names}, week, SUM(CASE WHEN {known} THEN weekly_volume END) AS s,
                     COUNT(CASE WHEN {known} THEN weekly_volume END) AS n FROM clustered GROUP BY ALL)"""


def _shrunk(total: str, rows: str) -> str:
    prior = "CASE WHEN p.n > 0 THEN p.s / p.n ELSE 0 END"
    return r(f"({total} + {PRIOR_ROWS} * {prior}) / ({rows} + {PRIOR_ROWS})")


FRAME = f"""
    SELECT g.establecimiento, g.material, g.week AS ds, c.cutoff,
           CAST(date_diff('day', c.cutoff, g.week) // 7 AS INTEGER) AS horizon_weeks, {r('g.weekly_volume')} AS y
    FROM gold g JOIN (
      SELECT establecimiento, material, CAST(last_week - INTERVAL 84 DAY - i * INTERVAL 182 DAY AS DATE) AS cutoff
      FROM origin, range(0, 400) AS s(i)
      WHERE last_week - INTERVAL 84 DAY - i * INTERVAL 182 DAY >= first_week + INTERVAL 728 DAY) c
    ON g.establecimiento = c.establecimiento AND g.material = c.material AND g.week > c.cutoff AND g.week <= c.cutoff + INTERVAL 84 DAY"""


ORACLES: dict[str, str] = {
    "silver_rollup": sql(f"SELECT {SILVER_COLUMNS} FROM silver"),
    "exclude_types": sql("SELECT * FROM silver WHERE tipo NOT IN ('HOUSEHOLD')"),
    "date_range_filter": sql(
        f"SELECT * FROM weekly WHERE week BETWEEN DATE '{bronze.DATE_RANGE[0]}' AND DATE '{bronze.DATE_RANGE[1]}'"
    ),
    "promo_flag": sql("SELECT *, CASE WHEN promo_id IS NULL THEN 0 ELSE 1 END AS has_promo FROM silver"),
    "period_flag": sql(
        f"SELECT *, CASE WHEN calday BETWEEN {PERIOD} THEN 1 ELSE 0 END AS is_covid_period FROM silver"
    ),
    "substring_filter": sql("SELECT * FROM silver WHERE establecimiento LIKE '%1%'"),
    "pattern_filter": sql("SELECT * FROM silver WHERE material LIKE '%#_4%'"),
    "materials_semi_join": sql(
        "SELECT * FROM silver WHERE material IN (SELECT p_brand FROM part GROUP BY 1 HAVING AVG(p_size) >= 25.5)"
    ),
    "drop_columns": sql("SELECT establecimiento, material, calday, volume_ap, cantidad_umb FROM silver"),
    "fill_nulls": sql("SELECT * REPLACE (COALESCE(promo_id, 'NONE') AS promo_id) FROM silver"),
    "fill_category": sql("SELECT * REPLACE (COALESCE(promo_id, 'Missing') AS promo_id) FROM silver"),
    "cast_weekly": sql(
        "SELECT * REPLACE (TRY_CAST(has_promo AS TINYINT) AS has_promo, "
        "TRY_CAST(is_covid_period AS TINYINT) AS is_covid_period) FROM clustered"
    ),
    "weekly_rollup": sql("SELECT * FROM weekly"),
    "gap_fill": sql("SELECT * FROM filled"),
    "min_weeks": sql(f"SELECT {WEEKLY_COLUMNS} FROM (SELECT *, COUNT(*) OVER ({BY}) AS n FROM weekly) WHERE n >= 56"),
    "weekly_gold": sql("SELECT * FROM gold"),
    "training_gold": sql(f"SELECT {WEEKLY_COLUMNS} FROM (SELECT *, COUNT(*) OVER ({BY}) AS n FROM gold) WHERE n >= 56"),
    "sort_by_volume": sql(
        f"SELECT {WEEKLY_COLUMNS} FROM (SELECT *, SUM(weekly_volume) OVER ({BY}) AS s FROM gold) "
        "ORDER BY s DESC, establecimiento, material, week"
    ),
    "model_input": sql(
        "SELECT establecimiento, material, week AS ds, weekly_volume AS y, has_promo, is_covid_period FROM gold"
    ),
    "dataset_profile": sql(f"""
        SELECT COUNT(*) AS row_count, COUNT(DISTINCT establecimiento) AS unique_sites,
               COUNT(DISTINCT material) AS unique_items, MIN(week) AS first_date, MAX(week) AS last_date,
               COUNT(*) FILTER (WHERE has_promo = 1) AS promo_rows,
               COUNT(*) FILTER (WHERE has_promo <> 1) AS no_promo_rows,
               {r('100 * CAST(COUNT(*) FILTER (WHERE has_promo = 1) AS DOUBLE) / COUNT(*)')} AS promo_pct,
               {r('SUM(weekly_volume)')} AS total_volume, {r('AVG(weekly_volume)')} AS avg_volume FROM gold"""),
    "dataset_profile_silver": sql("""
        SELECT COUNT(*) AS row_count, COUNT(DISTINCT establecimiento) AS unique_sites,
               COUNT(DISTINCT material) AS unique_items, COUNT(DISTINCT promo_id) AS unique_promos,
               MIN(calday) AS first_date, MAX(calday) AS last_date FROM silver"""),
    "distinct_series": sql("SELECT DISTINCT establecimiento, material FROM gold"),
    "distinct_items": sql("SELECT DISTINCT material FROM gold"),
    "distinct_labels": sql("SELECT DISTINCT cluster_label FROM clustered"),
    "top_n_series": sql(_top(20)),
    "series_ids": sql(
        "SELECT DISTINCT establecimiento || '_' || material AS series_id, establecimiento, material FROM gold"
    ),
    "last_rows": sql(
        f"SELECT {WEEKLY_COLUMNS} FROM (SELECT *, ROW_NUMBER() OVER ({BY} ORDER BY week DESC) AS i FROM gold) WHERE i = 1"
    ),
    "sale_intervals": sql(
        f"SELECT establecimiento, material, week, prev_sale_week, {r('CAST(interval_weeks AS DOUBLE)')} AS interval_weeks FROM intervals"
    ),
    "adi": sql(f"SELECT establecimiento, material, {rr('adi_weeks')} FROM adi"),
    "base_features": sql(f"""
        SELECT establecimiento, material, num_weeks, nonzero_weeks_count,
               {rr('total_liters', 'mean_liters', 'median_liters', 'max_liters', 'std_liters', 'zero_ratio',
                   'mean_nonzero_liters', 'median_nonzero_liters', 'std_nonzero_liters', 'mean_liters_promo',
                   'mean_liters_no_promo')} FROM base"""),
    "cv_squared_promo_lift": sql(f"SELECT establecimiento, material, {rr('cv_squared', 'promo_lift')} FROM series"),
    "series_features": sql(
        f"SELECT establecimiento, material, num_weeks, nonzero_weeks_count, {rr(*SERIES_ROUNDED)} FROM series"
    ),
    "scaled_features": sql(f"SELECT establecimiento, material, {rr(*FEATURES)} FROM scaled"),
    "inverse_scale": sql(
        "SELECT establecimiento, material, " + ", ".join(f"{r(f'CAST({c} AS DOUBLE)')} AS {c}" for c in FEATURES) + " FROM series"
    ),
    "feature_audit": sql(
        "SELECT " + ", ".join(f"BOOL_OR(isnan({c}) OR isinf({c})) AS {c}" for c in FEATURES) + " FROM scaled"
    ),
    "calendar_features": sql(f"SELECT *, {CALENDAR} FROM gold"),
    "holiday_features": sql(f"SELECT *, {HOLIDAY} FROM gold"),
    "holiday_table_join": sql(f"SELECT *, {HOLIDAY} FROM gold"),
    "holiday_in_week_days": sql("""
        SELECT *, CASE WHEN week IN (SELECT CAST(date_trunc('week', holiday_date) AS DATE) FROM holidays)
                       THEN 1 ELSE 0 END AS holiday_in_week_days FROM gold"""),
    "lag_features": sql(f"SELECT *, {LAG_COLUMNS} FROM gold"),
    **{
        f"rolling_{w}w": sql(f"SELECT establecimiento, material, week, weekly_volume, {_rolling(w, False)} FROM gold")
        for w in ROLLING_WINDOWS
    },
    "rolling_full_frame": sql(
        f"SELECT establecimiento, material, week, weekly_volume, {_rolling(8, False, 0)} FROM gold"
    ),
    "intermittency": sql(f"SELECT *, {INTERMITTENCY} FROM gold"),
    "row_features": sql(f"{ROW_FEATURES} FROM clustered"),
    "next_week_features": sql(f"""
        SELECT * EXCLUDE (is_next) FROM (
          {ROW_FEATURES}, is_next FROM (
            SELECT *, FALSE AS is_next FROM clustered
            UNION ALL
            SELECT establecimiento, material, CAST(MAX(week) + INTERVAL 7 DAY AS DATE), CAST(NULL AS DOUBLE), 1, 0,
                   MAX(cluster_label), TRUE FROM clustered GROUP BY 1, 2))
        WHERE is_next"""),
    "drop_incomplete": sql(f"""
        SELECT * FROM (SELECT establecimiento, material, week, LAG(weekly_volume, 52) OVER ({IN_TIME}) AS volume_lag_52
        FROM gold) WHERE volume_lag_52 IS NOT NULL"""),
    "recent_rows": sql(f"""
        SELECT {WEEKLY_COLUMNS}, cluster_label FROM (
          SELECT *, RANK() OVER (PARTITION BY cluster_label ORDER BY week DESC) AS i FROM clustered) WHERE i <= 10000"""),
    "positional_split": sql("""
        SELECT establecimiento, material, week, cluster_label, pos,
               CASE WHEN pos < FLOOR(group_rows * CAST(0.8 AS DOUBLE)) THEN 'train' ELSE 'test' END AS split FROM rownum"""),
    "chronological_split": sql("SELECT establecimiento, material, week, cluster_label, cutoff_week, split FROM chrono"),
    "per_series_split": sql(f"""
        SELECT establecimiento, material, week, CASE WHEN i <= FLOOR(n * CAST(0.8 AS DOUBLE)) THEN 'train' ELSE 'test' END AS split
        FROM (SELECT *, ROW_NUMBER() OVER ({IN_TIME}) AS i, COUNT(*) OVER ({BY}) AS n FROM gold)"""),
    "cv_folds": sql(f"""
        SELECT establecimiento, material, c.week, c.cluster_label, {_fold('i', 'n', 5)} AS fold
        FROM clustered c JOIN (
          SELECT *, ROW_NUMBER() OVER (PARTITION BY cluster_label ORDER BY week) - 1 AS i,
                 COUNT(*) OVER (PARTITION BY cluster_label) AS n
          FROM (SELECT DISTINCT cluster_label, week FROM clustered)) w
        ON c.cluster_label = w.cluster_label AND c.week = w.week"""),
    "cv_folds_positional": sql(
        f"SELECT establecimiento, material, week, cluster_label, {_fold('pos', 'group_rows', 5)} AS fold FROM rownum"
    ),
    "rolling_origin_cutoffs": sql("SELECT * FROM cutoffs"),
    "overlapping_horizons": sql("""
        SELECT g.establecimiento, g.material, g.week, c.cutoff,
               CAST(date_diff('day', c.cutoff, g.week) // 7 AS INTEGER) AS horizon_weeks, g.weekly_volume
        FROM gold g JOIN (
          SELECT establecimiento, material, CAST(last_week - INTERVAL 140 DAY - i * INTERVAL 56 DAY AS DATE) AS cutoff
          FROM origin, range(0, 400) AS s(i)
          WHERE last_week - INTERVAL 140 DAY - i * INTERVAL 56 DAY >= first_week + INTERVAL 728 DAY) c
        ON g.establecimiento = c.establecimiento AND g.material = c.material
          AND g.week > c.cutoff AND g.week <= c.cutoff + INTERVAL 140 DAY"""),
    "group_status": sql("""
        SELECT cluster_label, row_count, train_rows,
               CASE WHEN row_count < 14 THEN 'skipped: too few rows'
                    WHEN train_rows < 6 THEN 'skipped: too few training rows'
                    WHEN row_count - train_rows < 1 THEN 'skipped: empty test' ELSE 'ok' END AS status
        FROM (SELECT cluster_label, COUNT(*) AS row_count, COUNT(*) FILTER (WHERE split = 'train') AS train_rows
              FROM chrono GROUP BY 1)"""),
    "adaptive_fold_count": sql("""
        SELECT cluster_label, COUNT(*) AS row_count, CAST(LEAST(5, GREATEST(2, COUNT(*) // 100)) AS INTEGER) AS folds
        FROM clustered GROUP BY 1"""),
    "naive_backtest": sql("SELECT * FROM backtest"),
    "horizon_metrics": sql(f"""
        SELECT establecimiento, material, horizon_weeks, row_count, nonzero_rows,
               {rr('mse', 'rmse', 'mae', 'mape_pct', 'coverage')} FROM horizons"""),
    "series_metrics": sql(f"""
        SELECT establecimiento, material, {rr('mse', 'rmse', 'mae', 'mape_pct', 'coverage')}, data_points FROM per_series"""),
    "smoothed_horizons": sql(
        f"SELECT establecimiento, material, horizon_weeks, {rr('mse', 'rmse', 'mae', 'coverage')} FROM smooth_wide"
    ),
    "smoothed_series_metrics": sql(f"""
        SELECT p.establecimiento, p.material, {', '.join(f"{r(f's.{m}')} AS {m}" for m in ('mse', 'rmse', 'mae', 'coverage'))},
               {r('p.mape_pct')} AS mape_pct, p.data_points
        FROM per_series p JOIN (
          SELECT establecimiento, material, AVG(mse) AS mse, AVG(rmse) AS rmse, AVG(mae) AS mae, AVG(coverage) AS coverage
          FROM smooth_usual GROUP BY 1, 2) s ON p.establecimiento = s.establecimiento AND p.material = s.material"""),
    "global_metrics": sql(f"""
        SELECT {r('SQRT(AVG(POW(y - yhat, 2)))')} AS global_rmse, {r('AVG(ABS(y - yhat))')} AS global_mae,
               {r('100 * AVG(ABS(y - yhat) / ABS(y)) FILTER (WHERE y <> 0)')} AS global_mape_pct,
               (SELECT COUNT(*) FROM (SELECT DISTINCT establecimiento, material FROM backtest0)) AS included_series,
               COUNT(*) AS total_periods, {r('SUM(y)')} AS total_actual_volume, {r('SUM(yhat)')} AS total_predicted_volume,
               {r('100 * (1 - ABS(SUM(y) - SUM(yhat)) / NULLIF(SUM(y), 0))')} AS volume_accuracy
        FROM (SELECT ds, SUM(y) AS y, SUM(yhat) AS yhat FROM backtest0 GROUP BY 1)"""),
    "cluster_metrics": sql(f"""
        SELECT cluster_label, row_count, {rr('mae', 'rmse', 'mape', 'r2', 'mean_actual', 'mean_predicted')}
        FROM cluster_scores"""),
    "mase": sql(_mase(False)),
    "mase_continuous": sql(_mase(True)),
    "metric_summary": sql(
        "SELECT "
        + ", ".join(
            f"{r(f'{f}({c})')} AS {f.lower()}_{n}"
            for c, n in (("mape_pct", "mape"), ("rmse", "rmse"), ("mae", "mae"))
            for f in ("AVG", "MIN", "MAX")
        )
        + ", COUNT(COALESCE(mape_pct, rmse, mae)) AS successful_models, COUNT(*) AS total_models FROM per_series"
    ),
    "rank_results": sql(f"""
        SELECT establecimiento, material, {rr('mse', 'rmse', 'mae', 'mape_pct', 'coverage')}, data_points,
               CASE WHEN mape_pct IS NOT NULL THEN 0 WHEN rmse IS NOT NULL THEN 1 WHEN mae IS NOT NULL THEN 2 ELSE 3 END AS rank_tier
        FROM per_series"""),
    "mean_cluster_metrics": sql(f"SELECT {r('AVG(mae)')} AS mean_mae, {r('AVG(rmse)')} AS mean_rmse FROM cluster_scores"),
    "tuned_vs_default": sql(f"""
        SELECT establecimiento, material, test_points, {rr(*[f'{p}_{m}' for p in ('default', 'tuned') for m in ('rmse', 'mae', 'mape_pct')],
        'rmse_gain_pct', 'mae_gain_pct', 'mape_gain_pct')} FROM effect"""),
    "tuning_summary": sql(f"""
        SELECT {r('AVG(rmse_gain_pct)')} AS avg_rmse_gain_pct, {r('AVG(mae_gain_pct)')} AS avg_mae_gain_pct,
               {r('AVG(mape_gain_pct)')} AS avg_mape_gain_pct, COUNT(*) AS series_tested,
               COUNT(*) FILTER (WHERE rmse_gain_pct > 0) AS series_improved FROM effect"""),
    "best_params": sql(f"""
        SELECT establecimiento, material, CAST(weeks AS INTEGER) AS weeks, mae FROM (
          SELECT *, ROW_NUMBER() OVER ({BY} ORDER BY mae, weeks) AS i FROM ({_errors()})) WHERE i = 1"""),
    "assign_nearest_centroid": sql("SELECT * FROM labels"),
    "label_join": sql(
        "SELECT gold.*, COALESCE(labels.cluster_label, -1) AS cluster_label FROM gold LEFT JOIN labels USING (establecimiento, material)"
    ),
    "label_distribution": sql(f"""
        SELECT cluster_label, row_count, {r('100 * CAST(row_count AS DOUBLE) / SUM(row_count) OVER ()')} AS pct
        FROM (SELECT cluster_label, COUNT(*) AS row_count FROM clustered GROUP BY 1)"""),
    "cluster_means": sql(
        "SELECT cluster_label, COUNT(*) AS series_count, "
        + ", ".join(f"{r(f'AVG({c})')} AS {c}" for c in FEATURES)
        + " FROM series JOIN labels USING (establecimiento, material) GROUP BY 1"
    ),
    "centroid_pivot": sql(
        " UNION ALL ".join(
            f"SELECT CAST({i} AS INTEGER) AS place, '{c}' AS feature, "
            + ", ".join(f"{r(f'AVG({c}) FILTER (WHERE cluster_label = {k})')} AS cluster_{k}" for k in range(len(CENTRES)))
            + " FROM series JOIN labels USING (establecimiento, material)"
            for i, c in enumerate(FEATURES)
        )
    ),
    "silhouette": sql(_silhouette()),
    "median_impute": sql(_medians()),
    "oof_mean_fill": sql(f"""
        SELECT establecimiento, material, week, cluster_label,
               {r('COALESCE(p, AVG(p) OVER (PARTITION BY cluster_label))')} AS oof_pred
        FROM (SELECT *, LAG(weekly_volume, 12) OVER ({IN_TIME}) AS p FROM clustered)"""),
    "align_columns": sql(
        "SELECT material, establecimiento, week, weekly_volume, CAST(0 AS INTEGER) AS price, cluster_label FROM clustered"
    ),
    "clamp_predictions": sql(f"""
        SELECT establecimiento, material, week, actual_volume, {r('GREATEST(0, predicted_volume - 20)')} AS predicted_volume,
               cluster_label FROM predictions"""),
    "route_models": sql("""
        SELECT *, CASE WHEN cluster_label = 2 THEN 'RandomForest' WHEN cluster_label IN (0, 4, 6) THEN 'LightGBM'
                       WHEN cluster_label IN (1, 3, 5) THEN 'LightGBM (Low Confidence)'
                       ELSE 'LightGBM (Default)' END AS model_type FROM labels"""),
    "future_frame": sql("""
        SELECT establecimiento, material, week AS ds, 0 AS has_promo, 0 AS is_covid_period FROM gold
        UNION ALL
        SELECT establecimiento, material, CAST(last_week + i * INTERVAL 7 DAY AS DATE), 0, 0
        FROM origin, range(1, 13) AS s(i)"""),
    "gbt_holdout_rows": sql(HOLDOUT),
    "rf_holdout_rows": sql(HOLDOUT),
    "stacking_holdout_rows": sql(f"""
        SELECT establecimiento, material, week, {r('weekly_volume')} AS actual_volume, cluster_label,
               TRUE AS finite, TRUE AS not_negative
        FROM (SELECT *, MAX(week) OVER () AS last_week FROM ({ROW_FEATURES} FROM clustered)
              WHERE COLUMNS('.*({'|'.join(HISTORY_COLUMNS)}).*') IS NOT NULL)
        WHERE week > last_week - INTERVAL 84 DAY"""),
    "additive_forecast_rows": sql("""
        SELECT establecimiento, material, week AS ds, FALSE AS is_future, TRUE AS finite, TRUE AS ordered, 'ok' AS status
        FROM gold
        UNION ALL
        SELECT establecimiento, material, CAST(last_week + i * INTERVAL 7 DAY AS DATE), TRUE, TRUE, TRUE, 'ok'
        FROM origin, range(1, 13) AS s(i)"""),
    "additive_backtest_rows": sql(f"""
        SELECT establecimiento, material, ds, cutoff, horizon_weeks, {r('y')} AS y, TRUE AS finite, TRUE AS ordered,
               'ok' AS status FROM backtest0
        UNION ALL
        SELECT establecimiento, material, NULL, NULL, NULL, NULL, FALSE, FALSE, 'skipped'
        FROM origin ANTI JOIN cutoffs USING (establecimiento, material)"""),
    "additive_grid_rows": sql("""
        SELECT establecimiento, material, 32 * COUNT(cutoff) // GREATEST(COUNT(cutoff), 1) AS combinations,
               CASE WHEN COUNT(cutoff) > 0 THEN 'ok' ELSE 'skipped' END AS status
        FROM origin LEFT JOIN cutoffs USING (establecimiento, material) GROUP BY 1, 2"""),
    "resume_anti_join": sql(
        f"SELECT DISTINCT establecimiento, material FROM gold EXCEPT SELECT establecimiento, material FROM ({_top(100)})"
    ),
    "carried_over": sql(f"""
        SELECT p.establecimiento, p.material, {r('rmse')} AS rmse FROM per_series p
        JOIN ({_top(100)}) t ON p.establecimiento = t.establecimiento AND p.material = t.material"""),
    "union_results": sql(f"""
        SELECT COALESCE(t.establecimiento, p.establecimiento) AS establecimiento, COALESCE(t.material, p.material) AS material,
               {r('CASE WHEN t.material IS NULL THEN rmse ELSE total_volume END')} AS rmse,
               {r('CASE WHEN t.material IS NULL THEN mae END')} AS mae
        FROM per_series p FULL JOIN ({_top(100)}) t ON p.establecimiento = t.establecimiento AND p.material = t.material"""),
    "date_parts": """
        SELECT o_orderkey, CAST(o_orderdate AS DATE) AS o_orderdate,
               CAST(EXTRACT(YEAR FROM o_orderdate) AS INTEGER) AS o_orderdate_year,
               CAST(EXTRACT(MONTH FROM o_orderdate) AS INTEGER) AS o_orderdate_month,
               CAST(EXTRACT(DAY FROM o_orderdate) AS INTEGER) AS o_orderdate_day,
               CAST(EXTRACT(ISODOW FROM o_orderdate) - 1 AS INTEGER) AS o_orderdate_dayofweek FROM orders""",
    "top_category_onehot": """
        SELECT p_partkey, CASE WHEN i = 1 THEN 1 ELSE 0 END AS top_1, CASE WHEN i = 2 THEN 1 ELSE 0 END AS top_2,
               CASE WHEN i = 3 THEN 1 ELSE 0 END AS top_3, CASE WHEN i > 3 THEN 1 ELSE 0 END AS other
        FROM part JOIN (SELECT p_brand, ROW_NUMBER() OVER (ORDER BY COUNT(*) DESC, p_brand) AS i
                        FROM part GROUP BY 1) t ON part.p_brand = t.p_brand""",
    "range_windows": sql(_windows()),
    "normalize_columns": f"""
        SELECT o_orderkey, {r('(o_totalprice - AVG(o_totalprice) OVER ()) / STDDEV_POP(o_totalprice) OVER ()')} AS o_totalprice
        FROM orders""",
    "hash_sample": sql(f"SELECT * FROM gold WHERE {TENTH}"),
    "sample_rows": sql(f"""
        SELECT {WEEKLY_COLUMNS}, cluster_label FROM (
          SELECT *, ROW_NUMBER() OVER (PARTITION BY cluster_label ORDER BY {_hash()}) AS i FROM clustered) WHERE i <= 5000"""),
    "sample_large_groups": sql(f"""
        SELECT {WEEKLY_COLUMNS}, cluster_label FROM (
          SELECT *, COUNT(*) OVER (PARTITION BY cluster_label) AS n FROM clustered)
        WHERE n * CAST(0.1 AS DOUBLE) <= 5000 OR {TENTH}"""),
    "sample_rows_ungrouped": sql(f"""
        SELECT {WEEKLY_COLUMNS} FROM (SELECT *, ROW_NUMBER() OVER (ORDER BY {_hash()}) AS i FROM gold) WHERE i <= 5000"""),
    "ordered_target_statistics": sql(f"""
        SELECT c.establecimiento, c.material, c.week, c.cluster_label,
               {_shrunk('e.s', 'e.n')} AS ts_establecimiento, {_shrunk('m.s', 'm.n')} AS ts_material
        FROM clustered c
        JOIN ({_earlier(['cluster_label'])}) p USING (cluster_label, week)
        JOIN ({_earlier(['cluster_label', 'establecimiento'])}) e USING (cluster_label, establecimiento, week)
        JOIN ({_earlier(['cluster_label', 'material'])}) m USING (cluster_label, material, week)"""),
    "frozen_target_statistics": sql(f"""
        SELECT c.establecimiento, c.material, c.week, c.cluster_label, {_shrunk('m.s', 'm.n')} AS ts_material
        FROM clustered c
        JOIN ({_earlier(['cluster_label'], FROZEN)}) p USING (cluster_label, week)
        JOIN ({_earlier(['cluster_label', 'material'], FROZEN)}) m USING (cluster_label, material, week)"""),
    "category_codes": """
        SELECT CAST(l_partkey AS VARCHAR) AS category, COUNT(*) AS rows,
               ROW_NUMBER() OVER (ORDER BY COUNT(*) DESC, CAST(l_partkey AS VARCHAR)) - 1 AS code
        FROM lineitem GROUP BY l_partkey""",
    "coded_lines": """
        SELECT l_orderkey, l_linenumber, l_partkey, COALESCE(code, -1) AS code
        FROM lineitem LEFT JOIN (
          SELECT l_partkey, ROW_NUMBER() OVER (ORDER BY COUNT(*) DESC, CAST(l_partkey AS VARCHAR)) - 1 AS code
          FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_partkey) USING (l_partkey)""",
    "fold_medians": sql(f"""
        SELECT cluster_label, feature, f AS fold, {r('MEDIAN(v)')} AS median
        FROM (
          SELECT cluster_label, fold, UNNEST(['weekly_volume', 'volume_lag_4', 'volume_lag_52']) AS feature,
                 UNNEST([weekly_volume, l4, l52]) AS v
          FROM (SELECT *, LAG(weekly_volume, 4) OVER ({IN_TIME}) AS l4, LAG(weekly_volume, 52) OVER ({IN_TIME}) AS l52
                FROM clustered) c
          JOIN (SELECT cluster_label, week, {_fold('i', 'n', 5)} AS fold FROM (
                  SELECT *, ROW_NUMBER() OVER (PARTITION BY cluster_label ORDER BY week) - 1 AS i,
                         COUNT(*) OVER (PARTITION BY cluster_label) AS n
                  FROM (SELECT DISTINCT cluster_label, week FROM clustered))) w USING (cluster_label, week)),
          (SELECT UNNEST(range(6))::INTEGER AS f)
        WHERE fold < f AND v IS NOT NULL GROUP BY 1, 2, 3"""),
    "planned_regressors": sql(f"""
        SELECT f.establecimiento, f.material, ds, cutoff, COALESCE(g.has_promo, 0) AS has_promo,
               COALESCE(g.is_covid_period, 0) AS is_covid_period, g.week IS NOT NULL AS is_known
        FROM ({FRAME}) f LEFT JOIN gold g
          ON g.establecimiento = f.establecimiento AND g.material = f.material AND g.week = f.ds
             AND g.week - 28 <= f.cutoff"""),
    "last_known_actuals": sql(f"""
        SELECT f.*, {r('g.weekly_volume')} AS last_weekly_volume, g.has_promo AS last_has_promo, g.week AS last_date
        FROM ({FRAME}) f ASOF LEFT JOIN gold g
          ON g.establecimiento = f.establecimiento AND g.material = f.material AND least(f.ds, f.cutoff) >= g.week"""),
    "rolled_forward": f"""{WITH},
        g AS (SELECT *, ROW_NUMBER() OVER ({IN_TIME}) AS i, COUNT(*) OVER ({BY}) AS n FROM gold),
        v AS (
          SELECT establecimiento, material, MAX(week) AS last, MAX(CASE WHEN i = n THEN weekly_volume END) AS y0,
                 {', '.join(f'COALESCE(MAX(CASE WHEN i = n + {k} - 52 THEN weekly_volume END), 0) AS a{k}' for k in range(1, 5))}
          FROM g GROUP BY 1, 2),
        p AS (SELECT *, 0.5 * y0 + 0.5 * a1 AS p1, 0.5 * p1 + 0.5 * a2 AS p2, 0.5 * p2 + 0.5 * a3 AS p3, 0.5 * p3 + 0.5 * a4 AS p4 FROM v),
        s AS (SELECT establecimiento, material, last, UNNEST([1, 2, 3, 4]) AS step, UNNEST([p1, p2, p3, p4]) AS y FROM p)
        SELECT establecimiento, material, CAST(last + step * 7 AS DATE) AS week, step, cluster_label,
               {r('y')} AS predicted_volume, 'ok' AS status
        FROM s JOIN labels USING (establecimiento, material)""",
    "batch_manifest": f"""{WITH},
        sizes AS (
          SELECT establecimiento, material, COUNT(*) + 12 AS weeks, one IS NOT NULL AS largest
          FROM gold LEFT JOIN (SELECT establecimiento, material, 1 AS one FROM ({_top(20)})) t USING (establecimiento, material)
          GROUP BY ALL)
        SELECT 'complete' AS state, COUNT(*) AS series, CAST(SUM(weeks) AS BIGINT) AS forecasts, COUNT(*) AS results
        FROM sizes GROUP BY largest
        UNION ALL SELECT 'unfinished', NULL, NULL, NULL""",
}

# Tables that come back as they were written, and what is read of them.
ORACLES |= {
    "cluster_folders": sql(f"SELECT {WEEKLY_COLUMNS}, cluster_label FROM clustered"),
    "replaced_clusters": sql("""
        SELECT * REPLACE (weekly_volume * CASE WHEN cluster_label IN (0, 2) THEN 2 ELSE 1 END AS weekly_volume)
        FROM clustered"""),
    "compressed_parquet": sql("""
        SELECT establecimiento, COUNT(*) AS rows, SUM(volume_ap) AS volume FROM silver GROUP BY establecimiento"""),
    "csv_in_two_parts": ORACLES["weekly_gold"],
    "json_table": ORACLES["series_features"],
    "named_table": sql("""
        SELECT establecimiento, material, COUNT(*) AS weeks, SUM(weekly_volume) AS volume, MAX(week) AS last_week
        FROM gold GROUP BY 1, 2"""),
    "forecast_table": f"SELECT establecimiento, material, ds, yhat FROM ({ORACLES['naive_backtest']})",
    "stack_rows": sql(f"""
        SELECT c.establecimiento, c.material, c.week, cluster_label, cutoff_week,
               CASE WHEN c.week <= cutoff_week THEN 'train' ELSE 'test' END AS split
        FROM (SELECT * FROM (SELECT *, ROW_NUMBER() OVER ({IN_TIME}) AS i FROM clustered) WHERE i > 52) c
        JOIN (
          SELECT cluster_label, GREATEST(MAX(week) - 84, MIN(week)) AS cutoff_week
          FROM (SELECT *, ROW_NUMBER() OVER ({IN_TIME}) AS i FROM clustered) WHERE i > 52 GROUP BY 1)
        USING (cluster_label)"""),
    "stack_series_status": sql("""
        SELECT establecimiento, material, COUNT(*) AS weeks, GREATEST(COUNT(*) - 52, 0) AS usable_weeks,
               CASE WHEN COUNT(*) > 52 THEN 'ok' ELSE 'short history' END AS status
        FROM gold GROUP BY 1, 2"""),
    "ridge_predictions": f"""{WITH},
        x AS (
          SELECT * FROM (
            SELECT establecimiento, material, week, weekly_volume AS y,
                   LAG(weekly_volume, 1) OVER ({IN_TIME}) AS a, LAG(weekly_volume, 2) OVER ({IN_TIME}) AS b
            FROM gold) WHERE b IS NOT NULL),
        s AS (
          SELECT COUNT(*) * VAR_POP(a) + {RIDGE_PENALTY} AS aa, COUNT(*) * VAR_POP(b) + {RIDGE_PENALTY} AS bb,
                 COUNT(*) * COVAR_POP(a, b) AS ab, COUNT(*) * COVAR_POP(a, y) AS ay, COUNT(*) * COVAR_POP(b, y) AS yb,
                 AVG(a) AS ma, AVG(b) AS mb, AVG(y) AS my
          FROM x),
        c AS (
          SELECT *, (ay * bb - yb * ab) / (aa * bb - ab * ab) AS ca, (yb * aa - ay * ab) / (aa * bb - ab * ab) AS cb FROM s)
        SELECT establecimiento, material, week, ROUND(my + ca * (a - ma) + cb * (b - mb) + {NUDGE}, 3) AS prediction
        FROM x, c""",
    "additive_model_metadata": sql("""
        SELECT establecimiento, material, establecimiento || '_' || material AS series_id, 'ok' AS status,
               CAST(COUNT(*) AS INTEGER) AS data_points, STRFTIME(MIN(week), '%Y-%m-%d') AS start_date,
               STRFTIME(MAX(week), '%Y-%m-%d') AS end_date
        FROM gold GROUP BY establecimiento, material"""),
}
