"""Fill rate, causes of stockouts, and warehouse use."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larder.functions import labels
from larder.functions.columns import banded, money, percent, ratio
from larder.operators.inventory import months_back
from larder.plans.operator import Tables, operator
from larder.sources.summary import instead, measures, merged, since


@operator(
    instead=instead("date sku_id sales_rows quantity_ordered quantity_fulfilled backorder_quantity short_rows"),
    sales="date sku_id quantity_ordered quantity_fulfilled backorder_quantity",
    sku_master="sku_id product_name category unit_price_cents",
)
def fill_rate_analysis(t: Tables, *, as_of: date, lookback_months: int | None = 6, min_orders: int = 10,
                       ordered: bool = True) -> DataFrame:
    """Fill rate, stockouts, lost revenue and service level per SKU; ``None`` looks at all dates."""
    sales = t["sales"] if lookback_months is None else since(t["sales"], months_back(as_of, lookback_months))
    per_sku = measures(sales).groupBy("sku_id").agg(
        *merged("sales_rows", "quantity_ordered", "quantity_fulfilled", "backorder_quantity", "short_rows"),
    ).withColumnsRenamed({
        "sales_rows": "total_orders", "quantity_ordered": "total_units_ordered", "quantity_fulfilled": "total_units_fulfilled",
        "backorder_quantity": "total_backorders", "short_rows": "num_stockout_events",
    }).filter(F.col("total_orders") > min_orders)
    fill = percent("total_units_fulfilled", "total_units_ordered", None)
    result = per_sku.join(t["sku_master"], "sku_id").select(
        "sku_id", "product_name", "category", "total_orders", "total_units_ordered", "total_units_fulfilled",
        "total_backorders", F.round(fill, 2).alias("fill_rate_pct"), "num_stockout_events",
        percent("num_stockout_events", "total_orders").alias("stockout_frequency_pct"),
        money(F.col("total_backorders") * F.col("unit_price_cents")).alias("lost_revenue_estimate"),
        banded(fill, labels.SERVICE_BANDS, labels.SERVICE_REST, ">=").alias("service_level_status"),
    )
    return result.orderBy("fill_rate_pct") if ordered else result


@operator(
    sales="date sku_id backorder_quantity",
    purchase_orders="sku_id actual_delivery_date on_time",
    sku_master="sku_id product_name",
)
def stockout_root_cause(t: Tables, *, mode: str = "reference", days: int = 30, ordered: bool = True) -> DataFrame:
    """How far late deliveries explain the stockouts of each SKU.

    ``mode='reference'`` matches a stockout with every order of the SKU delivered from ``days``
    before it onwards, without upper bound: units and late counts are multiplied by the matches.
    ``mode='bounded'`` counts a stockout day once if a late delivery lies within ``days`` of it.
    No pair is ever formed: both sides shrink to one row per SKU and day, lie on one time axis,
    and a window over it counts the matches. A SKU has at most as many rows there as there are days.
    """
    out = (
        t["sales"].filter(F.col("backorder_quantity") > 0).groupBy("sku_id", "date")
        .agg(F.count(F.lit(1)).alias("rows"), F.sum("backorder_quantity").alias("units"))
    )
    back = days if mode == "reference" else 0
    out = out.select("sku_id", F.date_sub("date", back).alias("at"), "rows", "units",
                     F.lit(0).cast("long").alias("orders"), F.lit(0).cast("long").alias("late"))
    none = F.lit(None).cast("long")
    came = (
        t["purchase_orders"].filter(F.col("actual_delivery_date").isNotNull())
        .groupBy("sku_id", F.col("actual_delivery_date").alias("at"))
        .agg(F.count(F.lit(1)).alias("orders"), F.count_if(~F.col("on_time")).alias("late"))
        .select("sku_id", "at", none.alias("rows"), none.alias("units"), "orders", "late")
    )
    axis = out.unionByName(came)
    if mode == "reference":
        later = Window.partitionBy("sku_id").orderBy(F.desc("at")).rangeBetween(Window.unboundedPreceding, 0)
        matched = axis.select("sku_id", "rows", "units", F.sum("orders").over(later).alias("orders"),
                              F.sum("late").over(later).alias("late"))
        units = F.sum(F.col("units") * F.greatest(F.col("orders"), F.lit(1)))
        delays = F.sum(F.col("rows") * F.col("late"))
    else:
        near = Window.partitionBy("sku_id").orderBy(F.unix_date("at")).rangeBetween(-days, days)
        matched = axis.select("sku_id", "rows", "units", F.sum("late").over(near).alias("late"))
        units, delays = F.sum("units"), F.count_if(F.col("late") > 0)
    per_sku = matched.filter(F.col("rows").isNotNull()).groupBy("sku_id").agg(
        F.count(F.lit(1)).alias("num_stockout_days"), units.alias("total_backorder_units"),
        delays.alias("supplier_delays_count"),
    )
    share = percent("supplier_delays_count", "num_stockout_days", None)
    result = per_sku.join(t["sku_master"], "sku_id").select(
        "sku_id", "product_name", "num_stockout_days", "total_backorder_units", "supplier_delays_count",
        F.round(share, 2).alias("pct_due_to_supplier_delay"),
        banded(share, labels.CAUSE_BANDS, labels.CAUSE_REST).alias("primary_root_cause"),
    )
    return result.orderBy(F.desc("num_stockout_days")) if ordered else result


@operator(
    warehouse_master="warehouse_id warehouse_name city capacity_units monthly_operating_cost_cents",
    current_inventory="warehouse_id quantity_on_hand",
)
def warehouse_efficiency(t: Tables, *, ordered: bool = True) -> DataFrame:
    """Use of capacity and cost per stored unit of each warehouse."""
    stock = t["current_inventory"].groupBy("warehouse_id").agg(F.sum("quantity_on_hand").alias("total_units"))
    rows = t["warehouse_master"].join(stock, "warehouse_id", "left")
    return use_of_capacity(rows, ordered)


def use_of_capacity(rows: DataFrame, ordered: bool = True) -> DataFrame:
    use = percent("total_units", "capacity_units", None)
    (low, low_label), (high, high_label) = labels.WAREHOUSE_LOW, labels.WAREHOUSE_HIGH
    status = F.when(use < low, low_label).when(use > high, high_label).otherwise(labels.WAREHOUSE_REST)
    cost = F.col("monthly_operating_cost_cents")
    result = rows.select(
        "warehouse_id", "warehouse_name", "city", "capacity_units", "total_units",
        F.round(use, 2).alias("utilization_pct"),
        money(cost).alias("monthly_operating_cost"),
        F.round(ratio(cost, "total_units") / 100, 2).alias("cost_per_unit_stored"),
        money(cost * 12).alias("annual_operating_cost"),
        status.alias("efficiency_status"),
    )
    return result.orderBy(F.asc_nulls_first("utilization_pct")) if ordered else result
