"""Bodies of the common table expressions that give the parquet tables the operators' shape."""

VIEWS = {
    "sku_master": """
        SELECT p_partkey AS sku_id, p_name AS product_name, p_type AS category,
               CAST(floor(CAST(round(p_retailprice * 100) AS BIGINT) * (30 + p_size) / 100e0) AS BIGINT) AS unit_cost_cents,
               CAST(round(p_retailprice * 100) AS BIGINT) AS unit_price_cents,
               45 + p_size AS lead_time_days,
               (150 + 10 * (p_partkey % 11)) / 1000e0 AS carrying_cost_rate
        FROM part""",
    "sales": """
        SELECT *, quantity_ordered - quantity_fulfilled AS backorder_quantity,
               quantity_fulfilled * unit_price_cents AS revenue_cents
        FROM (SELECT CAST(l_shipdate AS DATE) AS date, l_partkey AS sku_id, p_type AS category,
                     CAST(l_quantity AS BIGINT) AS quantity_ordered,
                     CASE WHEN l_returnflag = 'R' AND l_linestatus = 'O'
                          THEN CAST(floor(CAST(l_quantity AS BIGINT)
                                    * (50 + 4 * CAST(round(l_discount * 100) AS INT)) / 100e0) AS BIGINT)
                          ELSE CAST(l_quantity AS BIGINT) END AS quantity_fulfilled,
                     CAST(round(p_retailprice * 100) AS BIGINT) AS unit_price_cents, r_name AS region
              FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
              JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)""",
    "purchase_orders": """
        SELECT supplier_id, sku_id, order_date, lead_time_expected, lead_time_actual,
               order_date + CAST(lead_time_expected AS INT) AS expected_delivery_date,
               order_date + CAST(lead_time_actual AS INT) AS actual_delivery_date,
               lead_time_actual <= lead_time_expected AS on_time, NOT bad AS quality_accepted, order_quantity,
               CASE WHEN bad THEN order_quantity - CAST(floor(order_quantity / 10e0) AS BIGINT) - 1
                    ELSE order_quantity END AS received_quantity,
               unit_cost_cents, order_quantity * unit_cost_cents AS total_cost_cents
        FROM (SELECT l_suppkey AS supplier_id, l_partkey AS sku_id, CAST(o_orderdate AS DATE) AS order_date,
                     CAST(45 + p_size AS BIGINT) AS lead_time_expected,
                     CAST(45 + p_size + 5 * (CAST(round(l_tax * 100) AS INT) + l_suppkey % 5 - 8) AS BIGINT) AS lead_time_actual,
                     l_returnflag = 'R' AND CAST(round(l_discount * 100) AS INT) >= 11 - l_suppkey % 5 AS bad,
                     CAST(l_quantity AS BIGINT) AS order_quantity,
                     CAST(floor(CAST(round(p_retailprice * 100) AS BIGINT) * (30 + p_size) / 100e0) AS BIGINT) AS unit_cost_cents
              FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)""",
    "supplier_master": """
        SELECT s_suppkey AS supplier_id, s_name AS supplier_name, r_name AS supplier_type, n_name AS country,
               CAST(round(punctual * 1000e0 / n) AS BIGINT) / 1000e0 AS on_time_delivery_rate,
               CAST(200 + round(good * 300e0 / n) AS BIGINT) / 100e0 AS quality_rating,
               CAST(30 + 15 * (s_suppkey % 4) AS INT) AS payment_terms_days,
               CAST(100 + 98 * (s_suppkey % 50) AS INT) AS minimum_order_quantity, s_acctbal > 0 AS is_preferred
        FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
        LEFT JOIN (SELECT supplier_id, count(*) AS n, count(*) FILTER (on_time) AS punctual,
                     count(*) FILTER (quality_accepted) AS good FROM purchase_orders GROUP BY supplier_id)
          ON supplier_id = s_suppkey""",
    "warehouse_master": """
        SELECT n_nationkey AS warehouse_id, n_name AS warehouse_name, r_name AS city, capacity_units,
               capacity_units * (50 + 10 * (n_nationkey % 8)) AS monthly_operating_cost_cents,
               (40 + (n_nationkey * 7) % 60) / 100e0 AS current_utilization_rate
        FROM (SELECT n_nationkey, n_name, n_regionkey, coalesce(n_sup, 0) * (80000 + 20000 * (n_nationkey % 10)) AS capacity_units
              FROM nation LEFT JOIN (SELECT s_nationkey, count(*) AS n_sup FROM supplier GROUP BY 1) ON s_nationkey = n_nationkey)
        JOIN region ON n_regionkey = r_regionkey""",
    "inventory_transactions": """
        SELECT left(kind, 1) || '-' || l_orderkey || '-' || l_linenumber AS transaction_id, CAST(l_shipdate AS DATE) AS transaction_date,
               l_partkey AS sku_id, s_nationkey AS warehouse_id, kind AS transaction_type,
               CASE kind WHEN 'RECEIPT' THEN 1 ELSE -1 END * CAST(l_quantity AS BIGINT) AS quantity, unit_cost_cents,
               CAST(l_quantity AS BIGINT) * unit_cost_cents AS total_value_cents
        FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN sku_master ON l_partkey = sku_id,
             (VALUES ('RECEIPT'), ('SHIPMENT')) k(kind)""",
    "current_inventory": """
        SELECT l_partkey AS sku_id, s_nationkey AS warehouse_id, quantity_on_hand,
               500 + (l_partkey * 37) % 1500 AS reorder_point, 200 + (l_partkey * 53) % 800 AS safety_stock,
               unit_cost_cents, quantity_on_hand * unit_cost_cents AS total_value_cents
        FROM (SELECT l_partkey, s_nationkey, CAST(sum(CAST(l_quantity AS BIGINT)) * 10 AS BIGINT) AS quantity_on_hand
              FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2)
        JOIN sku_master ON sku_id = l_partkey""",
    "bom": """
        SELECT CAST(floor(p_partkey / 6e0) AS BIGINT) AS parent_sku, p_partkey AS component_sku,
               1 + p_partkey % 4 AS quantity_per
        FROM part WHERE p_partkey > 0""",
}

NEEDS = {"supplier_master": ("purchase_orders",), "current_inventory": ("sku_master",), "inventory_transactions": ("sku_master",)}


def _half_even(x: str) -> str:
    d = f"CAST({x} AS DECIMAL(28,9))"
    return (f"CAST(CASE WHEN abs({d} * 100 % 1) = 0.5 AND trunc({d} * 100) % 2 = 0 THEN trunc({d} * 100) / 100e0 "
            f"ELSE CAST(round({d}, 2) AS DOUBLE) END AS DOUBLE)")


def _decimal(x: str, digits: str, scale: int) -> str:
    return f"CAST(round(CAST({x} AS DECIMAL(38,{scale})),{digits}) AS DOUBLE)"


ROUNDINGS = {
    "half_even(": _half_even,
    "half_up(": lambda inside: _decimal(*inside.rsplit(",", 1), 12),
    "money(": lambda inside: _decimal(inside, " 2", 6),
}


def _rounding(sql: str) -> str:
    """Writes out the roundings of a double as decimals.

    ``half_up(x, n)`` is for ratios, ``money(x)`` for amounts that may be large (a cast with twelve
    decimals would lose digits there), ``half_even(x)`` gives two decimals, ties to even. DuckDB itself rounds the binary value, so that 1.025 becomes
    1.02; the operators follow the decimal text.
    """
    for name in ("half_even(", "half_up(", "money("):
        while (start := sql.find(name)) >= 0:
            at = start + len(name)
            depth, end = 1, at
            while depth:
                depth += {"(": 1, ")": -1}.get(sql[end], 0)
                end += 1
            sql = sql[:start] + ROUNDINGS[name](sql[at:end - 1]) + sql[end:]
    return sql


def with_views(body: str, *names: str) -> str:
    """The query with the named views (and what they build on) as leading CTEs."""
    return _rounding(_with_ctes(body, names))


def _with_ctes(body: str, names: tuple[str, ...]) -> str:
    order: list[str] = []
    for name in names:
        for view in (*NEEDS.get(name, ()), name):
            if view not in order:
                order.append(view)
    ctes = [f"{name} AS ({VIEWS[name].strip()})" for name in order]
    body = body.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return "WITH RECURSIVE " + ", ".join(ctes + [body[15:]])
    if body.upper().startswith("WITH "):
        return "WITH " + ", ".join(ctes + [body[5:]])
    return "WITH " + ", ".join(ctes) + " " + body
