"""SQL for the round trips through files, and for the log of the standard queries."""

from oracle import business, explore, inventory
from oracle.views import with_views as q

# Query -> number of result columns.
AUDITED = {"abc_classification": 9, "inventory_turnover": 10, "eoq_sql": 10, "slow_moving_inventory": 11,
           "seasonal_decomposition": 11, "demand_volatility": 10, "supplier_scorecard_master": 9,
           "fill_rate_analysis": 12, "warehouse_efficiency": 10, "executive_kpis": 3}
CHECKED = {**inventory.SQL, **business.SQL}

SQL = {
    "read_csv": q("""
        SELECT CAST(sku_id AS VARCHAR) AS sku_id, product_name, category, unit_cost_cents, unit_price_cents,
               lead_time_days, carrying_cost_rate FROM sku_master""", "sku_master"),
    "read_json_records": q("""
        SELECT CAST(supplier_id AS VARCHAR) AS supplier_id, supplier_name, supplier_type, country, on_time_delivery_rate,
               quality_rating, payment_terms_days, minimum_order_quantity, is_preferred FROM supplier_master""",
        "supplier_master"),
    "write_table": q("""
        SELECT strftime(date, '%Y-%m') AS sales_month, count(*) AS rows,
               CAST(sum(quantity_ordered) AS BIGINT) AS quantity_ordered, CAST(sum(quantity_fulfilled) AS BIGINT) AS quantity_fulfilled,
               CAST(sum(backorder_quantity) AS BIGINT) AS backorder_quantity, count(DISTINCT sku_id) AS skus,
               min(date) AS first_date, max(date) AS last_date
        FROM sales GROUP BY 1""", "sales"),
    "read_table": q(f"SELECT {explore.COLUMNS['current_inventory']} FROM current_inventory", "current_inventory"),
    "write_csv": explore.SQL["monthly_sales_trends"],
    "write_json_records": explore.SQL["category_performance"],
    "parse_dates": "SELECT CAST(o_orderdate AS DATE) AS o_orderdate, count(*) AS orders FROM orders GROUP BY 1",
    "query_audit": " UNION ALL ".join(
        f"SELECT '{name}' AS query_name, (SELECT count(*) FROM ({CHECKED[name]})) AS rows_returned, "
        f"{width} AS columns, 'SUCCESS' AS status" for name, width in AUDITED.items()),
    "report_kv": q("""
        WITH s AS (SELECT CAST(sum(revenue_cents) AS BIGINT) / 100e0 AS rev, CAST(sum(quantity_fulfilled) AS BIGINT) AS u,
                          avg(revenue_cents) / 100 AS mean, min(date) AS a, max(date) AS b FROM sales)
        SELECT 'Total Revenue' AS metric, format('${:,.2f}', rev) AS value FROM s
        UNION ALL SELECT 'Total Units', CAST(u AS VARCHAR) FROM s
        UNION ALL SELECT 'Average Order Value', format('${:,.2f}', mean) FROM s
        UNION ALL SELECT 'Date Range', a || ' to ' || b FROM s""", "sales"),
}
SQL["sales_summary"] = q("""
    SELECT sku_id, date, count(*) AS sales_rows, count(quantity_fulfilled) AS fulfilled_rows,
           CAST(sum(quantity_ordered) AS BIGINT) AS quantity_ordered, CAST(sum(quantity_fulfilled) AS BIGINT) AS quantity_fulfilled,
           CAST(sum(quantity_fulfilled * quantity_fulfilled) AS BIGINT) AS fulfilled_squares,
           CAST(sum(backorder_quantity) AS BIGINT) AS backorder_quantity,
           count(*) FILTER (backorder_quantity > 0) AS backorder_rows, count(*) FILTER (quantity_fulfilled < quantity_ordered) AS short_rows,
           CAST(min(quantity_fulfilled) AS BIGINT) AS fulfilled_min, CAST(max(quantity_fulfilled) AS BIGINT) AS fulfilled_max,
           strftime(date, '%Y-%m') AS sales_month
    FROM sales GROUP BY sku_id, date""", "sales")
SQL["inventory_transactions"] = q("""
    SELECT warehouse_id, transaction_type, CAST(date_trunc('month', transaction_date) AS DATE) AS month, count(*) AS transactions,
           CAST(sum(quantity) AS BIGINT) AS quantity, CAST(sum(total_value_cents) AS BIGINT) AS value_cents
    FROM inventory_transactions GROUP BY 1, 2, 3""", "inventory_transactions")

SQL["read_json_arrays"] = SQL["read_json_records"]
