"""Explicit schemas of the input files, and the rule that turns them canonical.

Files hold money as decimal fractions of a currency unit. Readers turn every money column
``x`` into ``x_cents`` (whole cents) once, so that sums are exact and independent of the
order in which partitions are merged. Operators divide by 100 last.
"""

from __future__ import annotations

from pyspark.sql import types as T

_TYPES = {
    "str": T.StringType(),
    "int": T.IntegerType(),
    "long": T.LongType(),
    "float": T.DoubleType(),
    "date": T.DateType(),
    "bool": T.BooleanType(),
}


def _struct(spec: str) -> T.StructType:
    fields = (item.split(":") for item in spec.split())
    return T.StructType([T.StructField(name, _TYPES[kind], True) for name, kind in fields])


# Column names and order of the input files.
FILE_SCHEMAS: dict[str, T.StructType] = {
    "sku_master": _struct(
        "sku_id:str product_name:str category:str unit_cost:float unit_price:float "
        "lead_time_days:int carrying_cost_rate:float weight_kg:float is_active:bool"
    ),
    "warehouse_master": _struct(
        "warehouse_id:str warehouse_name:str city:str state:str capacity_units:int "
        "monthly_operating_cost:float cost_per_unit_stored:float current_utilization_rate:float"
    ),
    "supplier_master": _struct(
        "supplier_id:str supplier_name:str supplier_type:str country:str "
        "on_time_delivery_rate:float quality_rating:float payment_terms_days:int "
        "minimum_order_quantity:int is_preferred:bool"
    ),
    "sales": _struct(
        "date:date sku_id:str category:str quantity_ordered:long quantity_fulfilled:long "
        "backorder_quantity:long unit_price:float revenue:float customer_segment:str region:str"
    ),
    "inventory_transactions": _struct(
        "transaction_id:str transaction_date:date sku_id:str warehouse_id:str "
        "transaction_type:str quantity:long unit_cost:float total_value:float"
    ),
    "current_inventory": _struct(
        "sku_id:str warehouse_id:str quantity_on_hand:long quantity_allocated:long "
        "quantity_available:long reorder_point:long safety_stock:long last_count_date:date "
        "unit_cost:float total_value:float"
    ),
    "purchase_orders": _struct(
        "po_number:str order_date:date expected_delivery_date:date actual_delivery_date:date "
        "sku_id:str supplier_id:str order_quantity:long received_quantity:long unit_cost:float "
        "total_cost:float lead_time_expected:long lead_time_actual:long on_time:bool "
        "quality_accepted:bool"
    ),
    "supplier_performance": _struct(
        "supplier_id:str month:str on_time_delivery_rate:float quality_rating:float "
        "lead_time_avg_days:float lead_time_variance:float defect_rate:float total_orders:long "
        "total_spend:float"
    ),
    "economic_indicators": _struct(
        "month:str gdp_index:float manufacturing_pmi:float usd_cny_rate:float "
        "consumer_confidence:float"
    ),
    "promotional_calendar": _struct(
        "promotion_name:str start_date:date end_date:date discount_rate:float "
        "expected_demand_lift:float categories_included:str"
    ),
    "bom": _struct("parent_sku:str component_sku:str quantity_per:long is_critical:bool"),
}

# Columns that hold money, per table.
MONEY_COLUMNS: dict[str, tuple[str, ...]] = {
    "sku_master": ("unit_cost", "unit_price"),
    "warehouse_master": ("monthly_operating_cost", "cost_per_unit_stored"),
    "sales": ("unit_price", "revenue"),
    "inventory_transactions": ("unit_cost", "total_value"),
    "current_inventory": ("unit_cost", "total_value"),
    "purchase_orders": ("unit_cost", "total_cost"),
    "supplier_performance": ("total_spend",),
}
