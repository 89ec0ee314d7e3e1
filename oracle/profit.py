"""SQL for monthly profit and the features, per SKU."""

from oracle.views import with_views as q

MONTHLY = """
    WITH raw AS (
      SELECT CAST(s.sku_id AS VARCHAR) AS entity, CAST(date_trunc('month', date) AS DATE) AS year_month,
             CAST(sum(revenue_cents) AS BIGINT) AS rev, CAST(sum(quantity_fulfilled) AS BIGINT) AS quantity_fulfilled,
             CAST(sum(quantity_ordered) AS BIGINT) AS quantity_ordered,
             CAST(sum(backorder_quantity) AS BIGINT) AS backorder_quantity,
             half_up(avg(unit_cost_cents) / 100, 6) AS unit_cost, half_up(avg(s.unit_price_cents) / 100, 6) AS unit_price,
             CAST(sum(quantity_fulfilled * unit_cost_cents) AS BIGINT) AS cogs_c,
             CAST(sum(backorder_quantity * s.unit_price_cents) AS BIGINT) AS out_c,
             money(sum(quantity_fulfilled * unit_cost_cents * carrying_cost_rate / 12) / 100) AS carrying_cost
      FROM sales s LEFT JOIN sku_master m ON s.sku_id = m.sku_id GROUP BY 1, 2),
    amounts AS (
      SELECT entity, year_month, rev / 100e0 AS revenue, quantity_fulfilled, quantity_ordered, backorder_quantity,
             unit_cost, unit_price, cogs_c / 100e0 AS cogs, (rev - cogs_c) / 100e0 AS gross_profit,
             out_c / 100e0 AS stockout_cost, carrying_cost FROM raw),
    shares AS (
      SELECT *, half_even(gross_profit / nullif(revenue, 0) * 100) AS gross_margin_pct,
             half_even(CAST(quantity_fulfilled AS DOUBLE) / nullif(quantity_ordered, 0) * 100) AS fill_rate,
             money(gross_profit - carrying_cost - stockout_cost) AS operating_profit
      FROM amounts),
    monthly AS (
      SELECT *, half_even(operating_profit / nullif(revenue, 0) * 100) AS operating_margin_pct,
             CAST(operating_profit > 0 AS INT) AS is_profitable
      FROM shares)"""

def _away(c: str, k: int) -> str:
    """The value so many calendar months away, by a lookup of the month itself."""
    return f"(SELECT o.{c} FROM monthly o WHERE o.entity = m.entity AND o.year_month = CAST(m.year_month + INTERVAL ({k}) MONTH AS DATE))"


LAGS = ", ".join(
    f"{_away(c, -k)} AS {n}_lag_{k}" for k in (1, 2, 3)
    for c, n in (("revenue", "revenue"), ("gross_margin_pct", "gross_margin"), ("fill_rate", "fill_rate"),
                 ("stockout_cost", "stockout_cost")))
ROLLING = ", ".join(
    f"half_up((SELECT avg(o.{c}) FROM monthly o WHERE o.entity = m.entity AND o.year_month BETWEEN CAST(m.year_month - INTERVAL 2 MONTH AS DATE) AND m.year_month), 6) AS {n}_rolling_3m"
    for c, n in (("revenue", "revenue"), ("operating_profit", "profit"), ("operating_margin_pct", "margin")))
CHANGES = ", ".join(
    f"half_up(({c} - {_away(c, -1)}) / nullif({_away(c, -1)}, 0) * 100, 6) AS {n}_mom_change"
    for c, n in (("revenue", "revenue"), ("operating_profit", "profit"), ("fill_rate", "fill_rate")))
CALENDAR = """CAST(month(year_month) AS INT) AS month, CAST(quarter(year_month) AS INT) AS quarter,
              CAST(quarter(year_month) = 4 AS INT) AS is_q4"""
RATIOS = ", ".join(
    f"half_even({c} / nullif(revenue, 0) * 100) AS {n}_to_revenue_ratio"
    for c, n in (("cogs", "cogs"), ("stockout_cost", "stockout"), ("carrying_cost", "carrying")))
FLAGS = """CAST(coalesce(fill_rate < 90, false) AS INT) AS low_fill_rate_flag,
           CAST(stockout_cost > median(stockout_cost) OVER (PARTITION BY entity) AS INT) AS high_stockout_flag,
           CAST(coalesce(revenue_mom_change < -5, false) AS INT) AS declining_revenue_flag"""
FEATURES = MONTHLY + f""",
    wide AS (SELECT *, {LAGS}, {ROLLING}, {CHANGES}, {CALENDAR}, {RATIOS} FROM monthly m),
    flagged AS (SELECT *, {FLAGS} FROM wide),
    features AS (SELECT * FROM flagged WHERE revenue_lag_3 IS NOT NULL AND gross_margin_lag_3 IS NOT NULL
      AND gross_margin_lag_2 IS NOT NULL AND gross_margin_lag_1 IS NOT NULL AND gross_margin_pct IS NOT NULL
      AND revenue_mom_change IS NOT NULL AND profit_mom_change IS NOT NULL AND fill_rate_mom_change IS NOT NULL
      AND operating_margin_pct IS NOT NULL AND margin_rolling_3m IS NOT NULL AND cogs_to_revenue_ratio IS NOT NULL)"""

TARGET = FEATURES + """,
    target AS (SELECT f.*, o.operating_profit AS target_profit, o.is_profitable AS target_is_profitable
               FROM features f JOIN monthly o ON o.entity = f.entity
                 AND o.year_month = CAST(f.year_month + INTERVAL 3 MONTH AS DATE))"""


def _of(body: str) -> str:
    return q(body, "sku_master", "sales")



SQL = {
    "monthly_profitability": _of(MONTHLY + " SELECT * FROM monthly"),
    "lag_features": _of(MONTHLY + f" SELECT entity, year_month, {LAGS} FROM monthly m"),
    "rolling_features": _of(MONTHLY + f" SELECT entity, year_month, {ROLLING} FROM monthly m"),
    "mom_change": _of(MONTHLY + f" SELECT entity, year_month, {CHANGES} FROM monthly m"),
    "calendar_features": _of(MONTHLY + f" SELECT entity, year_month, {CALENDAR} FROM monthly"),
    "cost_ratios": _of(MONTHLY + f" SELECT entity, year_month, {RATIOS} FROM monthly"),
    "risk_flags": _of(MONTHLY + f", c AS (SELECT *, {CHANGES} FROM monthly m) SELECT entity, year_month, {FLAGS} FROM c"),
    "drop_incomplete": _of(FEATURES + " SELECT * FROM features"),
    "horizon_target": _of(TARGET + " SELECT entity, year_month, target_profit, target_is_profitable FROM target"),
    "train_test_sample": _of(TARGET + """
        SELECT entity, year_month, target_is_profitable,
               row_number() OVER (PARTITION BY target_is_profitable ORDER BY md5('42|' || entity || '|' || strftime(year_month, '%Y-%m')))
                 <= round(count(*) OVER (PARTITION BY target_is_profitable) * 0.75) AS is_train
        FROM target"""),
    "profit_summary": _of(MONTHLY + """,
        a AS (SELECT min(year_month) AS lo, max(year_month) AS hi, count(*) AS n, sum(is_profitable) AS good,
                     avg(operating_profit) AS p, avg(operating_margin_pct) AS m FROM monthly)
        SELECT 'Analysis Date' AS metric, '2001-11-05' AS value
        UNION ALL SELECT 'Forecast Horizon', '3 months ahead'
        UNION ALL SELECT 'Model Type', 'Random Forest + Gradient Boosting'
        UNION ALL SELECT 'Historical Period', strftime(lo, '%Y-%m') || ' to ' || strftime(hi, '%Y-%m') FROM a
        UNION ALL SELECT 'Total Months Analyzed', CAST(n AS VARCHAR) FROM a
        UNION ALL SELECT 'Profitable Months', CAST(good AS VARCHAR) FROM a
        UNION ALL SELECT 'Loss Months', CAST(n - good AS VARCHAR) FROM a
        UNION ALL SELECT 'Average Monthly Profit', format('${:,.2f}', p) FROM a
        UNION ALL SELECT 'Average Operating Margin', format('{:.2f}%', m) FROM a"""),
}
NAMES = """revenue quantity_fulfilled quantity_ordered backorder_quantity unit_cost unit_price cogs stockout_cost
    carrying_cost gross_margin_pct fill_rate operating_margin_pct month quarter is_q4 low_fill_rate_flag
    high_stockout_flag declining_revenue_flag""".split() + [
    f"{n}_{s}" for n, ends in (
        ("revenue", "lag_1 lag_2 lag_3 rolling_3m mom_change"), ("gross_margin", "lag_1 lag_2 lag_3"),
        ("fill_rate", "lag_1 lag_2 lag_3 mom_change"), ("stockout_cost", "lag_1 lag_2 lag_3"),
        ("profit", "rolling_3m mom_change"), ("margin", "rolling_3m"), ("cogs", "to_revenue_ratio"),
        ("stockout", "to_revenue_ratio"), ("carrying", "to_revenue_ratio"),
    ) for s in ends.split()]
SQL["standardize"] = _of(FEATURES + " SELECT entity, year_month, " + ", ".join(
    f"half_up(coalesce(({c} - avg({c}) OVER ()) / nullif(stddev_pop({c}) OVER (), 0), 0), 4) AS {c}" for c in NAMES
) + " FROM features")
SQL |= {f"{name}_company": SQL[name].replace("CAST(s.sku_id AS VARCHAR) AS entity", "'ALL' AS entity") for name in (
    "monthly_profitability", "lag_features", "rolling_features", "mom_change", "calendar_features", "cost_ratios", "risk_flags",
    "drop_incomplete", "horizon_target", "train_test_sample", "profit_summary")}

# Predictions without a fit: profit stays as it is.
ALERTS = FEATURES + """,
    recent AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY year_month DESC) AS age FROM features) WHERE age <= 3),
    risk AS (SELECT *, CASE WHEN operating_profit < 0 THEN 1e0
                            ELSE greatest(0e0, 1 - (CASE WHEN revenue > 0 THEN operating_profit / revenue * 100 ELSE 0e0 END) / 30) END AS loss FROM recent),
    alerts AS (SELECT entity, strftime(year_month, '%Y-%m') AS month, operating_profit AS current_profit,
                      operating_profit AS predicted_profit_3m_ahead, loss * 100 AS loss_probability,
                      CASE WHEN loss > 0.7 THEN 'HIGH RISK' WHEN loss > 0.4 THEN 'MEDIUM RISK' ELSE 'LOW RISK' END AS risk_level,
                      fill_rate, stockout_cost, operating_margin_pct AS operating_margin FROM risk)"""
SQL["persistent_alerts"] = _of(ALERTS + " SELECT * FROM alerts")
SQL["persistent_actions"] = _of(ALERTS + """
    SELECT entity, month, risk_level, concat_ws('; ',
      CASE WHEN fill_rate < 90 THEN format('Fill rate is low ({:.1f}%) - improve inventory', half_up(fill_rate, 1)) END,
      CASE WHEN stockout_cost > 50000 THEN format('High stockout costs (${:,.0f}) - fix supplier issues', stockout_cost) END,
      CASE WHEN operating_margin < 10 THEN format('Low margin ({:.1f}%) - reduce costs', half_up(operating_margin, 1)) END) AS actions
    FROM alerts WHERE risk_level <> 'LOW RISK'""")
SQL["persistent_risk_count"] = _of(ALERTS + """
    SELECT count(*) FILTER (risk_level = 'HIGH RISK') AS high_risk, count(*) FILTER (risk_level = 'MEDIUM RISK') AS medium_risk,
           count(*) FILTER (risk_level = 'LOW RISK') AS low_risk FROM alerts""")
JUDGED = TARGET + """,
    j AS (SELECT target_is_profitable AS label, is_profitable AS prediction, target_profit AS actual, operating_profit AS predicted FROM target)"""
SQL["persistent_classes"] = _of(JUDGED + """,
    c AS (SELECT count(*) AS rows, count(*) FILTER (label = 0 AND prediction = 0) AS loss_found, count(*) FILTER (label = 0 AND prediction = 1) AS loss_missed,
                 count(*) FILTER (label = 1 AND prediction = 0) AS false_alarm, count(*) FILTER (label = 1 AND prediction = 1) AS profit_found FROM j)
    SELECT *, half_up((loss_found + profit_found) * 100e0 / nullif(rows, 0), 2) AS accuracy_pct,
           half_up(loss_found * 100e0 / nullif(loss_found + false_alarm, 0), 2) AS loss_precision_pct,
           half_up(loss_found * 100e0 / nullif(loss_found + loss_missed, 0), 2) AS loss_recall_pct FROM c""")
SQL["persistent_report"] = _of(JUDGED + """,
    c AS (SELECT CAST(k AS INT) AS class, count(*) FILTER (label = k AND prediction = k) AS hit, count(*) FILTER (prediction = k) AS named,
                 count(*) FILTER (label = k) AS support FROM j, generate_series(0, 1) g(k) GROUP BY k)
    SELECT class, half_up(hit * 100e0 / nullif(named, 0), 2) AS precision_pct, half_up(hit * 100e0 / nullif(support, 0), 2) AS recall_pct,
           half_up(hit * 200e0 / nullif(named + support, 0), 2) AS f1_pct, support FROM c""")
SQL["persistent_errors"] = _of(JUDGED + """
    SELECT half_up(avg(abs(predicted - actual)), 2) AS mae, half_up(sqrt(avg((predicted - actual) * (predicted - actual))), 2) AS rmse,
           half_up(1 - sum((predicted - actual) * (predicted - actual)) / nullif(var_pop(actual) * count(*), 0), 4) AS r2,
           half_up(avg(abs((predicted - actual) / nullif(actual, 0)) * 100), 2) AS mape FROM j""")
