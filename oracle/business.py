"""SQL for demand, supplier, service, cost, component and headline queries."""

from oracle.views import with_views as q

ROOT_CAUSE_LABEL = """CASE WHEN share > 70 THEN 'Supplier Issue' WHEN share > 30 THEN 'Mixed (Supplier + Forecast)'
                            ELSE 'Forecast Error' END AS primary_root_cause"""

SQL = {
    "seasonal_decomposition": q("""
        WITH d AS (
          SELECT date, CAST(sum(quantity_fulfilled) AS BIGINT) AS units, CAST(sum(revenue_cents) AS BIGINT) AS rev
          FROM sales GROUP BY 1),
        m AS (SELECT month(date) AS mon, avg(units) AS avg_units FROM d GROUP BY 1)
        SELECT date AS sale_date, strftime(date, '%Y') AS year, strftime(date, '%m') AS month,
               strftime(date, '%W') AS week, CAST(strftime(date, '%w') AS INT) AS day_of_week,
               units AS total_units_sold, rev / 100e0 AS total_revenue, avg_units AS avg_monthly_units,
               half_up(units / nullif(avg_units, 0), 2) AS seasonal_index,
               avg(units) OVER (ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS moving_avg_7day,
               avg(units) OVER (ORDER BY date ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS moving_avg_30day
        FROM d JOIN m ON month(date) = mon""", "sales"),
    "demand_volatility": q("""
        WITH s AS (
          SELECT sku_id, count(*) AS n, sum(quantity_fulfilled) AS t, sum(quantity_fulfilled * quantity_fulfilled) AS t2,
                 min(quantity_fulfilled) AS lo, max(quantity_fulfilled) AS hi
          FROM sales WHERE date >= DATE '2000-11-05' GROUP BY 1),
        c AS (
          SELECT *, CAST(t AS DOUBLE) / n AS mean, sqrt(CAST(n * t2 - t * t AS DOUBLE)) / n AS sd FROM s),
        v AS (SELECT *, sd / nullif(mean, 0) * 100 AS cv FROM c)
        SELECT v.sku_id, product_name, category, half_up(mean, 2) AS avg_daily_demand, half_up(sd, 2) AS stddev_demand,
               half_up(cv, 2) AS coefficient_of_variation, lo AS min_demand, hi AS max_demand, n AS num_transactions,
               CASE WHEN cv > 100 THEN 'Very High Volatility' WHEN cv > 50 THEN 'High Volatility'
                    WHEN cv > 25 THEN 'Medium Volatility' ELSE 'Low Volatility' END AS volatility_category
        FROM v JOIN sku_master m ON v.sku_id = m.sku_id""", "sku_master", "sales"),
    "sku_cooccurrence": q("""
        WITH d AS (SELECT date, sku_id, CAST(sum(quantity_fulfilled) AS BIGINT) AS qty FROM sales GROUP BY 1, 2),
        p AS (
          SELECT a.sku_id AS sku_a, b.sku_id AS sku_b, count(*) AS days_sold_together,
                 half_up(avg(a.qty), 1) AS avg_qty_a, half_up(avg(b.qty), 1) AS avg_qty_b,
                 half_up(count(*) * 100e0 / (SELECT count(DISTINCT date) FROM d), 2) AS pct_days_together
          FROM d a JOIN d b ON a.date = b.date AND a.sku_id < b.sku_id
          GROUP BY 1, 2 HAVING count(*) > 3)
        SELECT sku_a, x.product_name AS product_a, sku_b, y.product_name AS product_b, days_sold_together,
               avg_qty_a, avg_qty_b, pct_days_together
        FROM p JOIN sku_master x ON x.sku_id = sku_a JOIN sku_master y ON y.sku_id = sku_b
        ORDER BY days_sold_together DESC, sku_a, sku_b LIMIT 50""", "sku_master", "sales"),
    "demand_trend": q("""
        WITH d AS (SELECT date, CAST(sum(quantity_fulfilled) AS BIGINT) AS u FROM sales GROUP BY 1)
        SELECT date AS demand_date, u AS total_demand,
               avg(u) OVER (ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS ma_7day,
               avg(u) OVER (ORDER BY date ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS ma_30day,
               u - lag(u, 7) OVER (ORDER BY date) AS week_over_week_change,
               half_up((u - lag(u, 7) OVER (ORDER BY date)) * 100e0 / nullif(lag(u, 7) OVER (ORDER BY date), 0), 2)
                 AS week_over_week_pct_change
        FROM d ORDER BY date DESC LIMIT 90""", "sales"),
    "supplier_scorecard_po": q("""
        WITH r AS (
          SELECT supplier_id, count(*) AS n, CAST(sum(total_cost_cents) AS BIGINT) AS spend,
                 CAST(sum(lead_time_actual) AS DOUBLE) / count(*) AS lead,
                 CAST(sum(lead_time_actual - lead_time_expected) AS DOUBLE) / count(*) AS delay,
                 count(*) FILTER (on_time) * 100e0 / count(*) AS punctual,
                 count(*) FILTER (quality_accepted) * 100e0 / count(*) AS good,
                 CAST(sum(CASE WHEN on_time THEN 0 ELSE total_cost_cents END) AS BIGINT) AS late_cost
          FROM purchase_orders GROUP BY 1)
        SELECT m.supplier_id, supplier_name, supplier_type, country, n AS total_orders, spend / 100e0 AS total_spend,
               half_up(lead, 1) AS avg_lead_time_days, half_up(delay, 1) AS avg_delay_days,
               half_up(punctual, 2) AS on_time_delivery_pct, half_up(good, 2) AS quality_acceptance_pct,
               late_cost / 100e0 AS cost_of_late_deliveries,
               half_up(punctual * 0.4e0 + good * 0.4e0
                     + CASE WHEN lead < 60 THEN 100e0 ELSE 100 - (lead - 60) END * 0.2e0, 2) AS composite_score,
               CASE WHEN punctual >= 95 AND good >= 98 THEN 'Tier 1 - Excellent'
                    WHEN punctual >= 85 AND good >= 95 THEN 'Tier 2 - Good'
                    WHEN punctual >= 70 AND good >= 90 THEN 'Tier 3 - Acceptable'
                    ELSE 'Tier 4 - Poor (Review Required)' END AS supplier_tier
        FROM supplier_master m LEFT JOIN r ON m.supplier_id = r.supplier_id""", "supplier_master"),
    "supplier_scorecard_master": q("""
        SELECT supplier_id, supplier_name, supplier_type, country,
               half_up(on_time_delivery_rate * 100, 2) AS on_time_delivery_pct, quality_rating, payment_terms_days,
               minimum_order_quantity,
               CASE WHEN on_time_delivery_rate >= 0.95e0 AND quality_rating >= 4.5e0 THEN 'Tier 1 - Excellent'
                    WHEN on_time_delivery_rate >= 0.85e0 AND quality_rating >= 4e0 THEN 'Tier 2 - Good'
                    WHEN on_time_delivery_rate >= 0.7e0 AND quality_rating >= 3.5e0 THEN 'Tier 3 - Acceptable'
                    ELSE 'Tier 4 - Poor (Review Required)' END AS supplier_tier
        FROM supplier_master""", "supplier_master"),
    "lead_time_variability": q("""
        WITH r AS (
          SELECT supplier_id, count(*) AS n, sum(lead_time_actual) AS t, sum(lead_time_actual * lead_time_actual) AS t2,
                 min(lead_time_actual) AS lo, max(lead_time_actual) AS hi
          FROM purchase_orders GROUP BY 1),
        s AS (SELECT *, sqrt(CAST(n * t2 - t * t AS DOUBLE)) / n AS sd FROM r)
        SELECT supplier_id, n AS num_orders, half_up(CAST(t AS DOUBLE) / n, 1) AS avg_lead_time,
               CAST(lo AS DOUBLE) AS min_lead_time, CAST(hi AS DOUBLE) AS max_lead_time,
               CAST(hi - lo AS DOUBLE) AS lead_time_range, half_up(sd, 2) AS stddev_lead_time,
               CASE WHEN sd > 20 THEN 'High Variability' WHEN sd > 10 THEN 'Medium Variability'
                    ELSE 'Low Variability' END AS variability_category
        FROM s""", "purchase_orders"),
    "supplier_tco": q("""
        WITH r AS (
          SELECT supplier_id, CAST(sum(total_cost_cents) AS BIGINT) AS spend,
                 CAST(sum(order_quantity - received_quantity) AS BIGINT) * 50 AS quality,
                 count(*) FILTER (NOT on_time) * 500 AS late
          FROM purchase_orders GROUP BY 1)
        SELECT m.supplier_id, supplier_name, country, spend / 100e0 AS purchase_cost,
               CAST(quality AS DOUBLE) AS quality_cost, CAST(late AS DOUBLE) AS expediting_cost,
               (spend + 100 * quality + 100 * late) / 100e0 AS total_cost_of_ownership,
               half_up((quality + late) * 100 * 100e0 / nullif(spend, 0), 2) AS hidden_cost_pct
        FROM supplier_master m LEFT JOIN r ON m.supplier_id = r.supplier_id""", "supplier_master"),
    "fill_rate_analysis": q("""
        WITH o AS (
          SELECT sku_id, count(*) AS n, CAST(sum(quantity_ordered) AS BIGINT) AS wanted,
                 CAST(sum(quantity_fulfilled) AS BIGINT) AS got, CAST(sum(backorder_quantity) AS BIGINT) AS missing,
                 count(*) FILTER (quantity_fulfilled < quantity_ordered) AS outs
          FROM sales GROUP BY 1 HAVING count(*) > 10)
        SELECT o.sku_id, product_name, category, n AS total_orders, wanted AS total_units_ordered,
               got AS total_units_fulfilled, missing AS total_backorders,
               half_up(got * 100e0 / nullif(wanted, 0), 2) AS fill_rate_pct, outs AS num_stockout_events,
               half_up(outs * 100e0 / n, 2) AS stockout_frequency_pct,
               missing * unit_price_cents / 100e0 AS lost_revenue_estimate,
               CASE WHEN got * 100e0 / nullif(wanted, 0) >= 95 THEN 'Meeting Target (>=95%)'
                    WHEN got * 100e0 / nullif(wanted, 0) >= 90 THEN 'Below Target (90-95%)'
                    ELSE 'Critical (<90%)' END AS service_level_status
        FROM o JOIN sku_master m ON o.sku_id = m.sku_id""", "sku_master", "sales"),
    "stockout_root_cause": q(f"""
        WITH e AS (SELECT sku_id, date, backorder_quantity AS bo FROM sales WHERE backorder_quantity > 0),
        j AS (
          SELECT e.sku_id, count(DISTINCT date) AS days, CAST(sum(bo) AS BIGINT) AS units,
                 count(*) FILTER (NOT on_time) AS late
          FROM e LEFT JOIN purchase_orders p ON e.sku_id = p.sku_id AND actual_delivery_date >= date - 30
          GROUP BY 1),
        s AS (SELECT *, late * 100e0 / nullif(days, 0) AS share FROM j)
        SELECT s.sku_id, product_name, days AS num_stockout_days, units AS total_backorder_units,
               late AS supplier_delays_count, half_up(share, 2) AS pct_due_to_supplier_delay, {ROOT_CAUSE_LABEL}
        FROM s JOIN sku_master m ON s.sku_id = m.sku_id""", "sku_master", "sales", "purchase_orders"),
    "stockout_root_cause_bounded": q(f"""
        WITH e AS (
          SELECT sku_id, date, sum(backorder_quantity) AS bo FROM sales WHERE backorder_quantity > 0 GROUP BY 1, 2),
        f AS (
          SELECT *, EXISTS (SELECT 1 FROM purchase_orders p WHERE p.sku_id = e.sku_id AND NOT on_time
                            AND actual_delivery_date BETWEEN date - 30 AND date + 30) AS due
          FROM e),
        j AS (
          SELECT sku_id, count(*) AS days, CAST(sum(bo) AS BIGINT) AS units, count(*) FILTER (due) AS late
          FROM f GROUP BY 1),
        s AS (SELECT *, late * 100e0 / nullif(days, 0) AS share FROM j)
        SELECT s.sku_id, product_name, days AS num_stockout_days, units AS total_backorder_units,
               late AS supplier_delays_count, half_up(share, 2) AS pct_due_to_supplier_delay, {ROOT_CAUSE_LABEL}
        FROM s JOIN sku_master m ON s.sku_id = m.sku_id""", "sku_master", "sales", "purchase_orders"),
    "warehouse_efficiency": q("""
        WITH i AS (SELECT warehouse_id, CAST(sum(quantity_on_hand) AS BIGINT) AS units FROM current_inventory GROUP BY 1),
        u AS (
          SELECT w.*, units, units * 100e0 / capacity_units AS pct
          FROM warehouse_master w LEFT JOIN i ON w.warehouse_id = i.warehouse_id)
        SELECT warehouse_id, warehouse_name, city, capacity_units, units AS total_units,
               half_up(pct, 2) AS utilization_pct, monthly_operating_cost_cents / 100e0 AS monthly_operating_cost,
               half_up(CAST(monthly_operating_cost_cents AS DOUBLE) / nullif(units, 0) / 100, 2) AS cost_per_unit_stored,
               monthly_operating_cost_cents * 12 / 100e0 AS annual_operating_cost,
               CASE WHEN pct < 50 THEN 'Underutilized - Consolidation Candidate'
                    WHEN pct > 90 THEN 'Over Capacity - Expansion Needed' ELSE 'Optimal Utilization' END AS efficiency_status
        FROM u""", "warehouse_master", "current_inventory"),
    "bom_paths": q("""
        WITH RECURSIVE w AS (
          SELECT [parent_sku] AS path, component_sku AS part, CAST(quantity_per AS DOUBLE) AS need, parent_sku = component_sku AS closed FROM bom
          UNION ALL
          SELECT list_append(path, part), component_sku, need * quantity_per, list_contains(list_append(path, part), component_sku)
          FROM w JOIN bom ON parent_sku = part WHERE NOT closed)
        SELECT path[1] AS root_product, part AS component_sku, CAST(len(path) AS INTEGER) AS level, need AS total_quantity_needed
        FROM w WHERE NOT closed""", "bom"),
    "bom_cycles": q("""
        WITH RECURSIVE w AS (
          SELECT [parent_sku] AS path, component_sku AS part, CAST(quantity_per AS DOUBLE) AS need, parent_sku = component_sku AS closed FROM bom
          UNION ALL
          SELECT list_append(path, part), component_sku, need * quantity_per, list_contains(list_append(path, part), component_sku)
          FROM w JOIN bom ON parent_sku = part WHERE NOT closed)
        SELECT DISTINCT array_to_string(path, ' > ') AS cycle, CAST(len(path) AS INTEGER) AS length
        FROM w WHERE closed AND part = path[1] AND path[1] = list_min(path)""", "bom"),
    "bom_explosion": q("""
        WITH RECURSIVE x AS (
          SELECT parent_sku AS root, component_sku AS comp, 1 AS level, CAST(quantity_per AS DOUBLE) AS need FROM bom
          UNION ALL
          SELECT root, b.component_sku, level + 1, need * b.quantity_per
          FROM x JOIN bom b ON b.parent_sku = comp WHERE level < 5)
        SELECT root AS root_product, r.product_name AS root_product_name, comp AS component_sku,
               c.product_name AS component_name, level, need AS total_quantity_needed,
               half_up(need * (c.unit_cost_cents / 100e0), 2) AS component_cost_per_unit
        FROM x JOIN sku_master r ON r.sku_id = root JOIN sku_master c ON c.sku_id = comp""", "sku_master", "bom"),
    "executive_kpis": q("""
        WITH j AS (
          SELECT s.sku_id, quantity_fulfilled * unit_cost_cents AS cogs, quantity_on_hand * unit_cost_cents AS val
          FROM sales s JOIN sku_master m ON s.sku_id = m.sku_id
          LEFT JOIN (SELECT sku_id, quantity_on_hand FROM current_inventory) c ON s.sku_id = c.sku_id
          WHERE date >= DATE '2000-11-05'),
        n AS (SELECT half_up(avg(turn), 2) AS v FROM (
          SELECT CAST(sum(cogs) AS DOUBLE) / nullif(avg(val), 0) AS turn FROM j GROUP BY sku_id)),
        i AS (SELECT CAST(sum(total_value_cents) AS BIGINT) / 100e0 AS v FROM current_inventory),
        f AS (SELECT half_up(sum(quantity_fulfilled) * 100e0 / sum(quantity_ordered), 2) AS v,
                     count(*) FILTER (backorder_quantity > 0) AS c FROM sales WHERE date >= DATE '2001-05-05'),
        p AS (SELECT half_up(avg(on_time_delivery_rate) * 100, 2) AS v FROM supplier_master)
        SELECT 'Total Inventory Value' AS metric, v AS value, '$' || CAST(v AS DECIMAL(38,2)) AS value_text FROM i
        UNION ALL SELECT 'Average Inventory Turnover', v, CAST(CAST(v AS DECIMAL(38,2)) AS VARCHAR) FROM n
        UNION ALL SELECT 'Overall Fill Rate', v, CAST(v AS DECIMAL(38,2)) || '%' FROM f
        UNION ALL SELECT 'Number of Stockout Events', CAST(c AS DOUBLE), CAST(c AS VARCHAR) FROM f
        UNION ALL SELECT 'Average Supplier On-Time Delivery', v, CAST(v AS DECIMAL(38,2)) || '%' FROM p""",
        "sku_master", "sales", "current_inventory", "supplier_master"),
    "executive_kpis_corrected": q("""
        WITH s AS (SELECT sku_id, sum(quantity_fulfilled) AS sold FROM sales WHERE date >= DATE '2000-11-05' GROUP BY 1),
        c AS (SELECT sku_id, sum(quantity_on_hand) AS held FROM current_inventory GROUP BY 1),
        n AS (SELECT half_up(avg(CAST(sold * unit_cost_cents AS DOUBLE) / nullif(held * unit_cost_cents, 0)), 2) AS v
              FROM s JOIN sku_master m ON s.sku_id = m.sku_id LEFT JOIN c ON s.sku_id = c.sku_id),
        i AS (SELECT CAST(sum(total_value_cents) AS BIGINT) / 100e0 AS v FROM current_inventory),
        f AS (SELECT half_up(sum(quantity_fulfilled) * 100e0 / sum(quantity_ordered), 2) AS v,
                     count(*) FILTER (backorder_quantity > 0) AS c FROM sales WHERE date >= DATE '2001-05-05'),
        p AS (SELECT half_up(avg(on_time_delivery_rate) * 100, 2) AS v FROM supplier_master)
        SELECT 'Total Inventory Value' AS metric, v AS value, '$' || CAST(v AS DECIMAL(38,2)) AS value_text FROM i
        UNION ALL SELECT 'Average Inventory Turnover', v, CAST(CAST(v AS DECIMAL(38,2)) AS VARCHAR) FROM n
        UNION ALL SELECT 'Overall Fill Rate', v, CAST(v AS DECIMAL(38,2)) || '%' FROM f
        UNION ALL SELECT 'Number of Stockout Events', CAST(c AS DOUBLE), CAST(c AS VARCHAR) FROM f
        UNION ALL SELECT 'Average Supplier On-Time Delivery', v, CAST(v AS DECIMAL(38,2)) || '%' FROM p""",
        "sku_master", "sales", "current_inventory", "supplier_master"),
}
SQL["fill_rate_analysis_six_months"] = SQL["fill_rate_analysis"].replace(
    "FROM sales GROUP BY 1 HAVING count(*) > 10", "FROM sales WHERE date >= DATE '2001-05-05' GROUP BY 1 HAVING count(*) > 1")
