"""SQL for the demand series, the plain forecasts and their scores, per category."""

from oracle.views import with_views as q

SPLIT = """
    WITH d AS (
      SELECT category AS series, date, CAST(sum(quantity_fulfilled) AS BIGINT) AS demand,
             CAST(sum(revenue_cents) AS BIGINT) / 100e0 AS revenue
      FROM sales GROUP BY 1, 2),
    s AS (SELECT *, date > max(date) OVER (PARTITION BY series) - 90 AS is_test FROM d)"""

LONG = SPLIT + """,
    tr AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY date DESC) AS age FROM s WHERE NOT is_test),
    f AS (
      SELECT series, 'Naive' AS model, CAST(max(demand) FILTER (age = 1) AS DOUBLE) AS forecast FROM tr GROUP BY 1
      UNION ALL SELECT series, 'MA_7day', avg(demand) FILTER (age <= 7) FROM tr GROUP BY 1
      UNION ALL SELECT series, 'MA_30day', avg(demand) FILTER (age <= 30) FROM tr GROUP BY 1),
    long AS (SELECT s.series, date, model, demand AS actual, forecast, 'ok' AS status FROM s JOIN f ON s.series = f.series WHERE is_test)"""

SCORE = LONG + """,
    m AS (
      SELECT model, half_up(avg(abs(forecast - actual)), 2) AS mae,
             half_up(sqrt(avg((forecast - actual) * (forecast - actual))), 2) AS rmse,
             half_up(avg(abs(forecast - actual) / nullif(actual, 0) * 100), 2) AS mape,
             half_up(avg(forecast - actual), 2) AS bias,
             half_up(100 - avg(abs(forecast - actual) / nullif(actual, 0) * 100), 2) AS forecast_accuracy,
             count(*) AS points, count(*) FILTER (actual = 0) AS zero_actuals
      FROM long GROUP BY 1)"""

RANKED = SCORE + """,
    r AS (
      SELECT *, CAST(row_number() OVER (ORDER BY mape, model) AS INT) AS rank,
             half_up((SELECT mape FROM m WHERE model = 'Naive') - mape, 2) AS gain_over_naive,
             forecast_accuracy >= 75 AS target_met
      FROM m)"""

SQL = {
    "daily_demand": q(SPLIT + " SELECT * FROM d", "sales"),
    "daily_demand_filled": q(SPLIT + """,
        c AS (SELECT series, CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date
              FROM d GROUP BY 1)
        SELECT c.series, c.date, coalesce(demand, 0) AS demand, coalesce(revenue, 0) AS revenue
        FROM c LEFT JOIN d ON c.series = d.series AND c.date = d.date""", "sales"),
    "holdout_split": q(SPLIT + " SELECT * FROM s", "sales"),
    "forecast_naive": q(LONG + " SELECT * FROM long WHERE model = 'Naive'", "sales"),
    "forecast_moving_average": q(LONG + " SELECT * FROM long WHERE model <> 'Naive'", "sales"),
    "forecast_metrics": q(SCORE + " SELECT * FROM m", "sales"),
    "forecast_ranking": q(RANKED + " SELECT * FROM r", "sales"),
    "forecast_summary": q(RANKED + """,
        b AS (SELECT * FROM r WHERE rank = 1)
        SELECT 'Analysis Date' AS metric, '2001-11-05' AS value
        UNION ALL SELECT 'Forecast Horizon', format('{} days', count(DISTINCT date)) FROM long
        UNION ALL SELECT 'Models Evaluated', CAST(count(*) AS VARCHAR) FROM r
        UNION ALL SELECT 'Best Model', model FROM b
        UNION ALL SELECT 'Best Model MAPE', format('{:.2f}%', mape) FROM b
        UNION ALL SELECT 'Best Model Accuracy', format('{:.2f}%', forecast_accuracy) FROM b
        UNION ALL SELECT 'Target Accuracy', '75%'
        UNION ALL SELECT 'Target Met', CASE WHEN target_met THEN 'Yes' ELSE 'No' END FROM b
        UNION ALL SELECT 'Baseline (Naive) MAPE', format('{:.2f}%', mape) FROM r WHERE model = 'Naive'
        UNION ALL SELECT 'Improvement vs Baseline', format('{:.2f} pp', gain_over_naive) FROM b""", "sales"),
    "forecast_wide": q(LONG + """
        SELECT series, date, actual, max(forecast) FILTER (model = 'Naive') AS forecast_Naive,
               max(forecast) FILTER (model = 'MA_7day') AS forecast_MA_7day,
               max(forecast) FILTER (model = 'MA_30day') AS forecast_MA_30day,
               actual - max(forecast) FILTER (model = 'Naive') AS error_Naive,
               actual - max(forecast) FILTER (model = 'MA_7day') AS error_MA_7day,
               actual - max(forecast) FILTER (model = 'MA_30day') AS error_MA_30day
        FROM long GROUP BY 1, 2, 3""", "sales"),
    "error_histogram": q(LONG + """,
        e AS (SELECT actual - forecast AS x FROM long WHERE model = 'MA_7day'),
        w AS (SELECT min(x) AS low, (max(x) - min(x)) / 30e0 AS width FROM e),
        b AS (SELECT least(CAST(floor((x - low) / width) AS INT), 29) + 1 AS bin FROM e, w)
        SELECT CAST(i AS INT) AS bin, half_up(low + (i - 1) * width, 4) AS bin_start, half_up(low + i * width, 4) AS bin_end,
               (SELECT count(*) FROM b WHERE b.bin = i) AS n
        FROM generate_series(1, 30) g(i), w""", "sales"),
}



def _solved(name: str, rows: str, n: int) -> str:
    """Least squares of y on the list x of n values, by series: sums of products, then elimination row by row."""
    return f"""
    {name}_sums AS (SELECT series, r, c, sum(x[r] * z[c]) AS v FROM (SELECT *, list_append(x, y) AS z FROM {rows}),
                    (SELECT unnest(range(1, {n + 1})) AS r), (SELECT unnest(range(1, {n + 2})) AS c) GROUP BY 1, 2, 3),
    {name}_rows AS (SELECT series, r, list(v ORDER BY c) AS v FROM {name}_sums GROUP BY 1, 2),
    {name}_steps AS (
      SELECT series, 1 AS k, list(v ORDER BY r) AS m FROM {name}_rows GROUP BY 1
      UNION ALL
      SELECT series, k + 1, list_transform(range(1, {n + 1}), lambda r: list_transform(range(1, {n + 2}), lambda c:
        CASE WHEN r = k THEN m[k][c] / m[k][k] ELSE m[r][c] - m[r][k] * m[k][c] / m[k][k] END))
      FROM {name}_steps WHERE k <= {n}),
    {name} AS (SELECT series, list_transform(m, lambda v: v[{n + 1}]) AS b FROM {name}_steps WHERE k = {n + 1})"""


# Seasonal autoregression with moving-average terms: a long autoregression, then one on three lags and two residuals, then a step at a time.
AR = SPLIT + f""",
    n AS (SELECT series, date, demand, row_number() OVER (PARTITION BY series ORDER BY date) AS i FROM s WHERE NOT is_test),
    w AS (SELECT a.series, a.i, CAST(a.demand - b.demand - c.demand + e.demand AS DOUBLE) AS w
          FROM n a JOIN n b ON b.series = a.series AND b.i = a.i - 1 JOIN n c ON c.series = a.series AND c.i = a.i - 7
          JOIN n e ON e.series = a.series AND e.i = a.i - 8),
    x1 AS (SELECT series, i, w AS y, [{", ".join(f"lag(w, {k}) OVER o" for k in range(1, 15))}] AS x FROM w
           WINDOW o AS (PARTITION BY series ORDER BY i) QUALIFY lag(w, 14) OVER o IS NOT NULL),
    {_solved("long_ar", "x1", 14)},
    e AS (SELECT x1.series, i, y, x, y - list_sum(list_transform(range(1, 15), lambda j: x[j] * b[j])) AS e FROM x1 JOIN long_ar USING (series)),
    x2 AS (SELECT series, i, y, [x[1], x[7], x[8], lag(e, 1) OVER o, lag(e, 7) OVER o] AS x FROM e
           WINDOW o AS (PARTITION BY series ORDER BY i) QUALIFY lag(e, 7) OVER o IS NOT NULL),
    {_solved("coef", "x2", 5)},
    last AS (SELECT series, list(e ORDER BY i DESC)[1:7] AS e FROM e GROUP BY 1),
    step AS (
      SELECT series, 0 AS h, list(CAST(demand AS DOUBLE) ORDER BY i DESC)[1:17] AS y, any_value(last.e) AS e FROM n JOIN last USING (series) GROUP BY 1
      UNION ALL
      SELECT s.series, h + 1, list_prepend(b[1] * (y[1] - y[2] - y[8] + y[9]) + b[2] * (y[7] - y[8] - y[14] + y[15])
        + b[3] * (y[8] - y[9] - y[15] + y[16]) + b[4] * e[1] + b[5] * e[7] + y[1] + y[7] - y[8], y)[1:17], list_prepend(0e0, e)[1:7]
      FROM step s JOIN coef c ON c.series = s.series WHERE h < (SELECT max(k) FROM (SELECT count(*) AS k FROM s WHERE is_test GROUP BY series))),
    t AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY date) AS h FROM s WHERE is_test)
    SELECT t.series, t.date, 'Seasonal_AR' AS model, t.demand AS actual, half_up(y[1], 2) AS forecast, 'ok' AS status
    FROM t JOIN step ON step.series = t.series AND step.h = t.h"""
SQL["forecast_seasonal_ar"] = q(AR.replace("WITH d AS", "WITH RECURSIVE d AS"), "sales")

# Holt-Winters with the weights 0.2, 0.1, 0.3; the seasonal values stand as a queue, the next day's first.
SMOOTHED = SPLIT + """,
    n AS (SELECT series, CAST(demand AS DOUBLE) AS y, row_number() OVER (PARTITION BY series ORDER BY date) AS i FROM s WHERE NOT is_test),
    first AS (SELECT series, avg(y) FILTER (i <= 7) AS m1, avg(y) FILTER (i > 7) AS m2, list(y ORDER BY i)[1:7] AS y7, any_value(k) AS k
              FROM (SELECT *, count(*) OVER (PARTITION BY series) AS k FROM n) WHERE i <= 14 GROUP BY 1),
    run AS (
      SELECT series, 7 AS i, m1 AS level, (m2 - m1) / 7 AS trend, [v - m1 for v in y7] AS q FROM first
      UNION ALL
      SELECT r.series, r.i + 1, 0.2e0 * (y - q[1]) + 0.8e0 * (level + trend),
             0.1e0 * (0.2e0 * (y - q[1]) + 0.8e0 * (level + trend) - level) + 0.9e0 * trend,
             list_append(q[2:], 0.3e0 * (y - level - trend) + 0.7e0 * q[1])
      FROM run r JOIN n ON n.series = r.series AND n.i = r.i + 1),
    last AS (SELECT run.* FROM run JOIN first ON first.series = run.series AND first.k = run.i),
    t AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY date) AS h FROM s WHERE is_test)
    SELECT t.series, t.date, 'Exp_Smoothing' AS model, t.demand AS actual,
           half_up(level + h * trend + q[CAST((h - 1) % 7 AS INT) + 1], 2) AS forecast, 'ok' AS status
    FROM t JOIN last ON last.series = t.series"""
SQL["forecast_holt_winters_stated"] = q(SMOOTHED.replace("WITH d AS", "WITH RECURSIVE d AS"), "sales")

# Holt-Winters with searched weights: a fold over the series for each candidate. The state is the error, level and trend, the
# seasonal values as a queue, and the three weights.
_FOLD = """list_reduce(y, lambda s, x: [
        s[1] + (x[1] - (s[2] + s[3]) - s[4]) * (x[1] - (s[2] + s[3]) - s[4]),
        s[11] * (x[1] - s[4]) + (1 - s[11]) * (s[2] + s[3]),
        s[12] * (s[11] * (x[1] - s[4]) + (1 - s[11]) * (s[2] + s[3]) - s[2]) + (1 - s[12]) * s[3],
        s[5], s[6], s[7], s[8], s[9], s[10], s[13] * (x[1] - (s[2] + s[3])) + (1 - s[13]) * s[4], s[11], s[12], s[13]],
        list_concat(start, [a, b, g]))"""


def _round(k: int, values: str) -> str:
    """The best state of each series over the weights that ``values`` gives for each of a, b and g."""
    grid = ", ".join(f"(SELECT series, unnest({values.format(w)}) AS {n} FROM best{k - 1}) {n}{k}" for n, w in zip("abg", (11, 12, 13)))
    return f"""
    best{k} AS (
      SELECT series, arg_min(st, st[1]) AS st FROM (
        SELECT f.series, {_FOLD} AS st FROM first f, {grid} WHERE f.series = a{k}.series AND f.series = b{k}.series AND f.series = g{k}.series)
      GROUP BY 1)"""


def _near(width: float) -> str:
    return f"list_transform([-1e0, -0.5e0, 0e0, 0.5e0, 1e0], lambda u: least(greatest(st[{{}}] + {width!r}::DOUBLE * u, 0.001e0), 0.999e0))"


SEARCHED = SPLIT + """,
    n AS (SELECT series, CAST(demand AS DOUBLE) AS y, row_number() OVER (PARTITION BY series ORDER BY date) AS i FROM s WHERE NOT is_test),
    first AS (SELECT series, list_concat([0e0, m1, (m2 - m1) / 7], [v - m1 for v in y7]) AS start, y
              FROM (SELECT series, avg(y) FILTER (i <= 7) AS m1, avg(y) FILTER (i BETWEEN 8 AND 14) AS m2, list(y ORDER BY i)[1:7] AS y7,
                           list([y] ORDER BY i)[8:] AS y FROM n GROUP BY 1)),
    best0 AS (SELECT series, NULL AS st FROM first),""" + ",".join([
    _round(1, "[0.01e0, 0.05e0, 0.1e0, 0.2e0, 0.4e0, 0.7e0]"),
    *(_round(k, _near(w)) for k, w in ((2, 0.1 / 3), (3, 0.1 / 3 / 3), (4, 0.1 / 3 / 3 / 3)))]) + """,
    t AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY date) AS h FROM s WHERE is_test)
    SELECT t.series, t.date, 'Exp_Smoothing' AS model, t.demand AS actual, st[2] + h * st[3] + st[CAST((h - 1) % 7 AS INT) + 4] AS forecast, 'ok' AS status
    FROM t JOIN best4 ON best4.series = t.series"""
SQL["forecast_holt_winters"] = q(SEARCHED, "sales")


def _company(name: str) -> str:
    return SQL[name].replace("SELECT category AS series", "SELECT 'ALL' AS series")


SQL |= {f"{name}_company": _company(name) for name in ("daily_demand", "forecast_metrics", "forecast_ranking")}
# Every SKU, with its empty days as zero.
FILLED = """
    WITH raw AS (SELECT CAST(sku_id AS VARCHAR) AS series, date, sum(quantity_fulfilled) AS demand, sum(revenue_cents) AS cents FROM sales GROUP BY 1, 2),
    days AS (SELECT series, CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM raw GROUP BY 1),
    d AS (SELECT days.series, days.date, CAST(coalesce(demand, 0) AS BIGINT) AS demand, CAST(coalesce(cents, 0) AS BIGINT) / 100e0 AS revenue
          FROM days LEFT JOIN raw ON raw.series = days.series AND raw.date = days.date),"""
_HEAD = SPLIT[:SPLIT.index("    s AS (")]
SQL["daily_demand_sku_filled"] = q(FILLED.rstrip(",") + " SELECT * FROM d", "sales")
SQL["forecast_metrics_sku"] = q(SCORE.replace(_HEAD, FILLED + "\n") + " SELECT * FROM m", "sales")
