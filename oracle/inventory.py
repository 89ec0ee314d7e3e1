"""SQL for stock value, turnover, order quantity and slow stock."""

from oracle.views import with_views as q

SQL = {
    "abc_classification": q("""
        WITH v AS (
          SELECT c.sku_id, product_name, category, quantity_on_hand, c.unit_cost_cents / 100e0 AS unit_cost,
                 total_value_cents / 100e0 AS total_value,
                 half_up(total_value_cents * 100e0 / CAST(sum(total_value_cents) OVER () AS DOUBLE), 2) AS pct_of_total_value,
                 half_up(CAST(sum(total_value_cents) OVER (ORDER BY total_value_cents DESC) AS BIGINT) * 100e0
                       / CAST(sum(total_value_cents) OVER () AS DOUBLE), 2) AS cumulative_pct
          FROM current_inventory c JOIN sku_master s ON c.sku_id = s.sku_id)
        SELECT *, CASE WHEN cumulative_pct <= 80 THEN 'A - High Value (Top 80%)'
                       WHEN cumulative_pct <= 95 THEN 'B - Medium Value (80-95%)'
                       ELSE 'C - Low Value (Bottom 5%)' END AS abc_classification FROM v
        """, "sku_master", "current_inventory"),
    "inventory_turnover": q("""
        WITH cogs AS (
          SELECT s.sku_id, CAST(sum(quantity_fulfilled * unit_cost_cents) AS DOUBLE) AS cogs
          FROM sales s JOIN sku_master m ON s.sku_id = m.sku_id
          WHERE date >= DATE '2000-11-05' GROUP BY 1),
        stock AS (
          SELECT sku_id, warehouse_id, avg(quantity_on_hand * unit_cost_cents) AS val
          FROM current_inventory GROUP BY 1, 2)
        SELECT stock.sku_id, product_name, category, stock.warehouse_id, warehouse_name,
               half_up(val / 100e0, 2) AS avg_inventory_value, half_up(cogs / 100e0, 2) AS annual_cogs,
               half_up(cogs / nullif(val, 0), 2) AS inventory_turnover_ratio,
               half_up(365e0 / nullif(cogs / nullif(val, 0), 0), 1) AS days_inventory_on_hand,
               CASE WHEN cogs / nullif(val, 0) > 12 THEN 'Fast Moving' WHEN cogs / nullif(val, 0) > 6 THEN 'Medium Moving'
                    WHEN cogs / nullif(val, 0) > 2 THEN 'Slow Moving' ELSE 'Very Slow / Obsolete' END AS movement_category
        FROM stock JOIN sku_master m ON stock.sku_id = m.sku_id
        JOIN warehouse_master w ON stock.warehouse_id = w.warehouse_id LEFT JOIN cogs ON stock.sku_id = cogs.sku_id
        """, "sku_master", "sales", "warehouse_master", "current_inventory"),
    "eoq_sql": q("""
        WITH d AS (
          SELECT sku_id, CAST(sum(quantity_fulfilled) AS BIGINT) AS units FROM sales
          WHERE date >= DATE '2000-11-05' GROUP BY 1),
        e AS (
          SELECT m.sku_id, product_name, category, units AS annual_units_sold, unit_cost_cents / 100e0 AS unit_cost,
                 carrying_cost_rate,
                 sqrt(2e0 * units * 50e0 / nullif(unit_cost_cents / 100e0 * carrying_cost_rate, 0)) AS eoq
          FROM sku_master m JOIN d ON m.sku_id = d.sku_id WHERE units > 0)
        SELECT sku_id, product_name, category, annual_units_sold, unit_cost, carrying_cost_rate,
               50 AS estimated_order_cost, half_up(eoq, 0) AS economic_order_quantity,
               half_up(annual_units_sold / nullif(eoq, 0), 1) AS orders_per_year,
               half_up(365e0 / nullif(annual_units_sold / nullif(eoq, 0), 0), 1) AS days_between_orders
        FROM e""", "sku_master", "sales"),
    "slow_moving_inventory": q("""
        WITH r AS (
          SELECT sku_id, max(date) AS last_sale_date, CAST(sum(quantity_fulfilled) AS BIGINT) AS sold FROM sales
          WHERE date >= DATE '2001-11-05' - 90 GROUP BY 1),
        d AS (
          SELECT c.sku_id, product_name, category, warehouse_id, quantity_on_hand, total_value_cents / 100e0 AS total_value,
                 last_sale_date, date_diff('day', last_sale_date, DATE '2001-11-05') AS age, sold,
                 half_up(quantity_on_hand / nullif(sold / 90e0, 0), 0) AS days
          FROM current_inventory c JOIN sku_master m ON c.sku_id = m.sku_id LEFT JOIN r ON c.sku_id = r.sku_id
          WHERE quantity_on_hand > 0)
        SELECT sku_id, product_name, category, warehouse_id, quantity_on_hand, total_value, last_sale_date,
               CAST(age AS INT) AS days_since_last_sale, coalesce(sold, 0) AS units_sold_last_90days,
               CASE WHEN sold IS NULL OR sold = 0 THEN 999e0 ELSE days END AS days_of_inventory,
               CASE WHEN sold IS NULL THEN 'No Sales (Obsolete)' WHEN days > 180 THEN 'Excess (>180 days)'
                    WHEN days > 90 THEN 'Slow Moving (90-180 days)' ELSE 'Normal' END AS inventory_status
        FROM d""", "sku_master", "sales", "current_inventory"),
}
