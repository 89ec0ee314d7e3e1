"""SQL for the data-quality report, exploratory figures and dashboard tables."""

from oracle.views import VIEWS, with_views as q

COLUMNS = {
    "sku_master": "sku_id, product_name, category, unit_cost_cents, unit_price_cents, lead_time_days, carrying_cost_rate",
    "warehouse_master": "warehouse_id, warehouse_name, city, capacity_units, monthly_operating_cost_cents, "
                        "current_utilization_rate",
    "supplier_master": "supplier_id, supplier_name, supplier_type, country, on_time_delivery_rate, quality_rating, "
                       "payment_terms_days, minimum_order_quantity, is_preferred",
    "sales": "date, sku_id, category, quantity_ordered, quantity_fulfilled, backorder_quantity, unit_price_cents, "
             "revenue_cents, region",
    "current_inventory": "sku_id, warehouse_id, quantity_on_hand, reorder_point, safety_stock, unit_cost_cents, "
                         "total_value_cents",
    "purchase_orders": "order_date, expected_delivery_date, actual_delivery_date, sku_id, supplier_id, order_quantity, "
                       "received_quantity, unit_cost_cents, total_cost_cents, lead_time_expected, lead_time_actual, "
                       "on_time, quality_accepted",
    "inventory_transactions": "transaction_id, transaction_date, sku_id, warehouse_id, transaction_type, quantity, unit_cost_cents, "
                              "total_value_cents",
    "bom": "parent_sku, component_sku, quantity_per",
}


def _quality(name: str) -> str:
    columns = COLUMNS[name].split(", ")
    missing = " + ".join(f"count(*) FILTER ({c} IS NULL)" for c in columns)
    return f"""
        SELECT '{name}' AS dataset, r AS rows, {len(columns)} AS columns, m AS missing_values,
               half_up(m * 100e0 / (r * {len(columns)}), 2) AS missing_pct, r - d AS duplicates,
               m * 100e0 / (r * {len(columns)}) > 5 AS high_missing
        FROM (SELECT count(*) AS r, {missing} AS m,
                     (SELECT count(*) FROM (SELECT DISTINCT {COLUMNS[name]} FROM {name})) AS d FROM {name})"""


STOCK_FIGURES = """
    SELECT count(*) FILTER ({0}) AS items, half_up(count(*) FILTER ({0}) * 100e0 / count(*), 2) AS pct_of_items,
           coalesce(CAST(sum(total_value_cents) FILTER ({0}) AS BIGINT), 0) / 100e0 AS total_value
    FROM current_inventory"""

SQL = {
    "data_quality": q(" UNION ALL ".join(map(_quality, COLUMNS)), *VIEWS),
    "sales_totals": q("""
        SELECT CAST(sum(revenue_cents) AS BIGINT) / 100e0 AS total_revenue, CAST(sum(quantity_fulfilled) AS BIGINT) AS total_units,
               half_up(avg(revenue_cents) / 100, 2) AS avg_order_value, min(date) AS first_date, max(date) AS last_date
        FROM sales""", "sales"),
    "monthly_sales_trends": q("""
        SELECT strftime(date, '%Y-%m') AS month, CAST(sum(revenue_cents) AS BIGINT) / 100e0 AS revenue,
               CAST(sum(quantity_fulfilled) AS BIGINT) AS quantity_fulfilled,
               CAST(sum(backorder_quantity) AS BIGINT) AS backorder_quantity
        FROM sales GROUP BY 1""", "sales"),
    "monthly_sales_summary": q("""
        WITH m AS (SELECT CAST(sum(revenue_cents) AS BIGINT) AS c FROM sales GROUP BY strftime(date, '%Y-%m'))
        SELECT half_up(avg(c) / 100, 2) AS avg_monthly_revenue, max(c) / 100e0 AS peak_month_revenue,
               min(c) / 100e0 AS lowest_month_revenue FROM m""", "sales"),
    "seasonal_pattern": q("""
        WITH m AS (SELECT CAST(month(date) AS INT) AS month, avg(quantity_fulfilled) AS a FROM sales GROUP BY 1)
        SELECT month, a AS avg_quantity, (SELECT month FROM m ORDER BY a DESC LIMIT 1) AS peak_month,
               (SELECT month FROM m ORDER BY a LIMIT 1) AS low_month,
               half_up((SELECT max(a) / min(a) FROM m), 2) AS seasonal_variation
        FROM m""", "sales"),
    "category_performance": q("""
        WITH c AS (SELECT category, CAST(sum(revenue_cents) AS BIGINT) AS c, CAST(sum(quantity_fulfilled) AS BIGINT) AS n
                   FROM sales GROUP BY 1)
        SELECT category, c / 100e0 AS revenue, n AS quantity_fulfilled,
               half_up(c * 100e0 / (SELECT sum(c) FROM c), 2) AS pct_of_revenue,
               CAST(row_number() OVER (ORDER BY c DESC, category) AS INT) AS revenue_rank
        FROM c""", "sales"),
    "stockout_summary": q("""
        SELECT half_up(count(*) FILTER (backorder_quantity > 0) * 100e0 / count(*), 2) AS stockout_rate_pct,
               CAST(sum(backorder_quantity) AS BIGINT) AS total_backorder_units,
               half_up(sum(backorder_quantity) * avg(unit_price_cents) / 100, 2) AS estimated_lost_revenue
        FROM sales""", "sales"),
    "inventory_position": q("""
        SELECT CAST(sum(total_value_cents) AS BIGINT) / 100e0 AS total_inventory_value,
               CAST(sum(quantity_on_hand) AS BIGINT) AS total_units,
               half_up(CAST(sum(total_value_cents) AS DOUBLE) / sum(quantity_on_hand) / 100, 2) AS avg_unit_cost
        FROM current_inventory""", "current_inventory"),
    "top_warehouses": q("""
        SELECT warehouse_id, CAST(sum(quantity_on_hand) AS BIGINT) AS quantity_on_hand,
               CAST(sum(total_value_cents) AS BIGINT) / 100e0 AS total_value,
               half_up(sum(total_value_cents) * 100e0 / (SELECT sum(total_value_cents) FROM current_inventory), 2) AS pct_of_total
        FROM current_inventory GROUP BY 1 ORDER BY total_value DESC, warehouse_id LIMIT 5""", "current_inventory"),
    "below_reorder_point": q(STOCK_FIGURES.format("quantity_on_hand < reorder_point"), "current_inventory"),
    "excess_inventory": q(STOCK_FIGURES.format("quantity_on_hand > safety_stock * 3"), "current_inventory"),
    "supplier_tier_counts": q("""
        WITH s AS (SELECT *, on_time_delivery_rate >= 0.95e0 AND quality_rating >= 4.5e0 AS best,
                             on_time_delivery_rate < 0.7e0 OR quality_rating < 3.5e0 AS worst FROM supplier_master)
        SELECT count(*) AS suppliers, half_up(avg(on_time_delivery_rate) * 100, 2) AS avg_on_time_pct,
               half_up(avg(quality_rating), 2) AS avg_quality_rating,
               count(*) FILTER (best) AS tier_1_count, half_up(count(*) FILTER (best) * 100e0 / count(*), 2) AS tier_1_pct,
               count(*) FILTER (worst) AS tier_4_count, half_up(count(*) FILTER (worst) * 100e0 / count(*), 2) AS tier_4_pct
        FROM s""", "supplier_master"),
    "supplier_by_country": q("""
        SELECT country, round_even(half_up(avg(on_time_delivery_rate), 9), 3) AS avg_on_time_rate,
               round_even(half_up(avg(quality_rating), 9), 3) AS avg_quality, count(*) AS num_suppliers
        FROM supplier_master GROUP BY 1""", "supplier_master"),
    "insights": q("""
        WITH m AS (SELECT month(date) AS mon, avg(quantity_fulfilled) AS a FROM sales GROUP BY 1),
        s AS (SELECT CAST(sum(revenue_cents) AS BIGINT) / 100e0 AS rev, count(DISTINCT strftime(date, '%Y-%m')) AS months,
                     count(*) FILTER (backorder_quantity > 0) * 100e0 / count(*) AS outs FROM sales),
        i AS (SELECT CAST(sum(total_value_cents) AS BIGINT) / 100e0 AS val,
                     count(*) FILTER (quantity_on_hand < reorder_point) AS low,
                     count(*) FILTER (quantity_on_hand > safety_stock * 3) AS high,
                     CAST(sum(total_value_cents) FILTER (quantity_on_hand > safety_stock * 3) AS BIGINT) / 100e0 AS excess
              FROM current_inventory),
        p AS (SELECT count(*) AS poor FROM supplier_master WHERE on_time_delivery_rate < 0.7e0 OR quality_rating < 3.5e0)
        SELECT 1 AS position, format('Total revenue over {} months: ${:,.2f}', months, rev) AS insight FROM s
        UNION ALL SELECT 2, format('Demand peaks in month {} with {:.2f}x variation',
                                   (SELECT mon FROM m ORDER BY a DESC LIMIT 1), (SELECT max(a) / min(a) FROM m))
        UNION ALL SELECT 3, format('Stockout rate of {:.1f}% indicates inventory optimization opportunity', outs) FROM s
        UNION ALL SELECT 4, format('Current inventory value: ${:,.2f}', val) FROM i
        UNION ALL SELECT 5, format('{} items below reorder point - immediate action required', low) FROM i WHERE low > 0
        UNION ALL SELECT 6, format('${:,.2f} in excess inventory - potential cost reduction', excess) FROM i WHERE high > 0
        UNION ALL SELECT 7, format('{} suppliers in Tier 4 - review and potentially replace', poor) FROM p WHERE poor > 0
        """, "sales", "current_inventory", "supplier_master"),
    "executive_summary": q("""
        WITH s AS (SELECT min(date) AS a, max(date) AS b, count(*) AS n, CAST(sum(revenue_cents) AS BIGINT) / 100e0 AS rev,
                          sum(quantity_fulfilled) * 100e0 / sum(quantity_ordered) AS fill,
                          count(*) FILTER (backorder_quantity > 0) * 100e0 / count(*) AS outs FROM sales)
        SELECT 'Report Generated' AS metric, '2001-11-05' AS value
        UNION ALL SELECT 'Data Period', a || ' to ' || b FROM s
        UNION ALL SELECT 'Total SKUs', CAST(count(*) AS VARCHAR) FROM sku_master
        UNION ALL SELECT 'Total Warehouses', CAST(count(*) AS VARCHAR) FROM warehouse_master
        UNION ALL SELECT 'Total Suppliers', CAST(count(*) AS VARCHAR) FROM supplier_master
        UNION ALL SELECT 'Total Sales Transactions', CAST(n AS VARCHAR) FROM s
        UNION ALL SELECT 'Total Revenue', format('${:,.2f}', rev) FROM s
        UNION ALL SELECT 'Total Inventory Value', format('${:,.2f}', CAST(sum(total_value_cents) AS BIGINT) / 100e0) FROM current_inventory
        UNION ALL SELECT 'Average Fill Rate', format('{:.2f}%', fill) FROM s
        UNION ALL SELECT 'Stockout Rate', format('{:.2f}%', outs) FROM s""",
        "sku_master", "sales", "current_inventory", "supplier_master", "warehouse_master"),
    "daily_sales": q("""
        SELECT date, CAST(sum(revenue_cents) AS BIGINT) / 100e0 AS revenue,
               CAST(sum(quantity_fulfilled) AS BIGINT) AS quantity_fulfilled FROM sales GROUP BY 1""", "sales"),
    "year_month_units": q("""
        SELECT CAST(year(date) AS INT) AS year, CAST(month(date) AS INT) AS month,
               CAST(sum(quantity_fulfilled) AS BIGINT) AS quantity_fulfilled FROM sales GROUP BY 1, 2""", "sales"),
    "avg_by_month": q("""
        SELECT CAST(month(date) AS INT) AS month, avg(quantity_fulfilled) AS avg_quantity,
               strftime(any_value(date), '%b') AS month_name FROM sales GROUP BY 1""", "sales"),
    "category_sales_desc": q("""
        SELECT category, CAST(sum(revenue_cents) AS BIGINT) / 100e0 AS revenue,
               CAST(sum(quantity_fulfilled) AS BIGINT) AS quantity_fulfilled FROM sales GROUP BY 1""", "sales"),
    "pareto_top_n": q("""
        WITH c AS (
          SELECT i.sku_id, product_name, category, warehouse_id, total_value_cents AS v
          FROM current_inventory i JOIN sku_master m ON i.sku_id = m.sku_id
          ORDER BY v DESC, i.sku_id, warehouse_id LIMIT 50)
        SELECT sku_id, product_name, category, warehouse_id, v / 100e0 AS total_value,
               half_up(sum(v) OVER (ORDER BY v DESC, sku_id, warehouse_id ROWS UNBOUNDED PRECEDING) * 100e0
                       / sum(v) OVER (), 2) AS cumulative_pct
        FROM c""", "sku_master", "current_inventory"),
    "top_suppliers": q("""
        SELECT supplier_id, supplier_name, country, half_up(on_time_delivery_rate * 100, 1) AS on_time_pct, quality_rating,
               CASE WHEN on_time_delivery_rate >= 0.95e0 AND quality_rating >= 4.5e0 THEN 'Tier 1'
                    WHEN on_time_delivery_rate >= 0.85e0 AND quality_rating >= 4e0 THEN 'Tier 2'
                    WHEN on_time_delivery_rate >= 0.7e0 THEN 'Tier 3' ELSE 'Tier 4' END AS tier
        FROM supplier_master ORDER BY on_time_delivery_rate DESC, supplier_id LIMIT 15""", "supplier_master"),
    "stockout_rate_by_category": q("""
        SELECT category, count(*) FILTER (backorder_quantity > 0) AS stockouts, count(*) AS orders,
               half_up(count(*) FILTER (backorder_quantity > 0) * 100e0 / count(*), 2) AS stockout_rate
        FROM sales GROUP BY 1""", "sales"),
    "warehouse_utilization_band": q("""
        SELECT warehouse_id, warehouse_name, half_up(current_utilization_rate * 100, 1) AS utilization_pct,
               CASE WHEN current_utilization_rate > 0.9e0 THEN 'Over Capacity' WHEN current_utilization_rate > 0.7e0 THEN 'Optimal'
                    WHEN current_utilization_rate > 0.5e0 THEN 'Acceptable' ELSE 'Underutilized' END AS utilization_band
        FROM warehouse_master""", "warehouse_master"),
    "dashboard_kpis": q("""
        SELECT CAST(sum(revenue_cents) AS BIGINT) / 100e0 AS total_revenue, CAST(sum(quantity_fulfilled) AS BIGINT) AS total_units,
               half_up(count(*) FILTER (backorder_quantity > 0) * 100e0 / count(*), 2) AS stockout_rate,
               half_up(sum(quantity_fulfilled) * 100e0 / sum(quantity_ordered), 2) AS fill_rate
        FROM sales""", "sales"),
    "monthly_revenue": q("""
        SELECT strftime(date, '%Y-%m') AS month, CAST(sum(revenue_cents) AS BIGINT) / 100e0 AS revenue
        FROM sales GROUP BY 1""", "sales"),
    "supplier_kpis": q("""
        SELECT half_up(avg(on_time_delivery_rate) * 100, 2) AS avg_on_time_pct, half_up(avg(quality_rating), 2) AS avg_quality,
               count(*) FILTER (is_preferred) AS preferred_suppliers, count(*) AS suppliers,
               count(*) FILTER (on_time_delivery_rate < 0.7e0) AS poor_suppliers
        FROM supplier_master""", "supplier_master"),
    "supplier_type_distribution": q(
        "SELECT supplier_type, count(*) AS suppliers FROM supplier_master GROUP BY 1", "supplier_master"),
    "day_of_week_pattern": q("""
        SELECT CAST(isodow(date) AS INT) AS day_number, dayname(date) AS day_of_week, avg(quantity_fulfilled) AS avg_quantity
        FROM sales GROUP BY 1, 2""", "sales"),
}
