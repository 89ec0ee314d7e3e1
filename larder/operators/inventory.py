"""Stock value classes, turnover, order quantity and slow stock."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.functions import labels
from larder.functions.columns import banded, money, percent, ratio
from larder.functions.running import running_total_desc
from larder.plans.operator import Tables, operator
from larder.sources.summary import instead, since


def months_back(as_of: date, months: int) -> Column:
    """First day of the look-back; folded to a literal, so it reaches the scan as a filter."""
    return F.add_months(F.lit(as_of), -months)


@operator(
    current_inventory="sku_id quantity_on_hand unit_cost_cents total_value_cents",
    sku_master="sku_id product_name category",
)
def abc_classification(t: Tables, *, a_cut: float = 80, b_cut: float = 95,
                       method: str = "ranges", ordered: bool = True) -> DataFrame:
    """Share and running share of stock value, largest first, with class A, B or C.

    Ties share their running total and the class follows the rounded percentage.
    ``method='ranges'`` spreads the running total over the cluster; ``'window'`` sorts all rows in
    one task, hardly quicker even on a small table, and serves as a check.
    """
    stock = t["current_inventory"].join(t["sku_master"], "sku_id")
    if method == "window":
        by_value = Window.orderBy(F.desc("total_value_cents"))
        running = stock.withColumns({
            "running": F.sum("total_value_cents").over(by_value),
            "total": F.sum("total_value_cents").over(Window.partitionBy()),
        })
    else:
        running = running_total_desc(stock, "total_value_cents", "running", "total")
    if ordered:  # before the shares are made, so that fewer columns are sorted
        running = running.orderBy(F.desc("total_value_cents"))
    shares = running.select(
        "sku_id", "product_name", "category", "quantity_on_hand",
        money("unit_cost_cents").alias("unit_cost"),
        money("total_value_cents").alias("total_value"),
        percent("total_value_cents", "total").alias("pct_of_total_value"),
        percent("running", "total").alias("cumulative_pct"),
    )
    (_, a_label), (_, b_label) = labels.ABC_BANDS
    return shares.withColumn(
        "abc_classification",
        banded(F.col("cumulative_pct"), ((a_cut, a_label), (b_cut, b_label)), labels.ABC_REST, "<="),
    )


@operator(
    instead=instead("date sku_id quantity_fulfilled"),
    sales="date sku_id quantity_fulfilled",
    sku_master="sku_id product_name category unit_cost_cents",
    warehouse_master="warehouse_id warehouse_name",
    current_inventory="sku_id warehouse_id quantity_on_hand unit_cost_cents",
)
def inventory_turnover(t: Tables, *, as_of: date, lookback_months: int = 12,
                       apportion: bool = False, ordered: bool = True) -> DataFrame:
    """Cost of goods sold against mean stock value per SKU and warehouse.

    The cost is that of the whole SKU, set against each warehouse's stock; ``apportion=True``
    splits it by stock value instead.
    """
    sold = (
        since(t["sales"], months_back(as_of, lookback_months))
        .groupBy("sku_id").agg(F.sum("quantity_fulfilled").alias("sold"))
    )
    stock = (
        t["current_inventory"]
        .withColumn("value", F.col("quantity_on_hand") * F.col("unit_cost_cents"))
        .groupBy("sku_id", "warehouse_id")
        .agg(ratio(F.sum("value"), F.count("value")).alias("stock_value"))
    )
    rows = (
        stock.join(sold, "sku_id", "left").join(t["sku_master"], "sku_id").join(t["warehouse_master"], "warehouse_id")
        .withColumn("cogs", (F.col("sold") * F.col("unit_cost_cents")).cast("double"))
    )
    if apportion:
        whole = F.sum("stock_value").over(Window.partitionBy("sku_id"))
        rows = rows.withColumn("cogs", F.col("cogs") * F.try_divide(F.col("stock_value"), whole))
    turns = ratio("cogs", "stock_value")
    if ordered:  # before further columns are made, so that fewer are sorted
        rows = rows.orderBy(F.desc_nulls_last(F.round(turns, 2)))
    return rows.select(
        "sku_id", "product_name", "category", "warehouse_id", "warehouse_name",
        F.round(money("stock_value"), 2).alias("avg_inventory_value"),
        F.round(money("cogs"), 2).alias("annual_cogs"),
        F.round(turns, 2).alias("inventory_turnover_ratio"),
        F.round(F.try_divide(F.lit(365.0), turns), 1).alias("days_inventory_on_hand"),
        banded(turns, labels.TURNOVER_BANDS, labels.TURNOVER_REST).alias("movement_category"),
    )


@operator(
    instead=instead("date sku_id quantity_fulfilled"),
    sales="date sku_id quantity_fulfilled",
    sku_master="sku_id product_name category unit_cost_cents carrying_cost_rate",
)
def eoq_sql(t: Tables, *, as_of: date, lookback_months: int = 12,
            order_cost: int = labels.ORDER_COST, ordered: bool = True) -> DataFrame:
    """Economic order quantity per SKU from the demand of the look-back."""
    demand = (
        since(t["sales"], months_back(as_of, lookback_months))
        .groupBy("sku_id").agg(F.sum("quantity_fulfilled").alias("annual_units_sold"))
        .filter(F.col("annual_units_sold") > 0)
    )
    return order_quantities(demand.join(t["sku_master"], "sku_id"), order_cost, ordered)


def order_quantities(rows: DataFrame, order_cost: int, ordered: bool = True) -> DataFrame:
    """Order quantity, orders per year and days between orders, from the unrounded quantity."""
    units = F.col("annual_units_sold").cast("double")
    eoq = F.sqrt(F.try_divide(F.lit(2.0) * units * F.lit(float(order_cost)),
                              money("unit_cost_cents") * F.col("carrying_cost_rate")))
    rows = rows.withColumn("eoq", eoq).withColumn("orders", F.try_divide(units, F.col("eoq")))
    result = rows.select(
        "sku_id", "product_name", "category", "annual_units_sold",
        money("unit_cost_cents").alias("unit_cost"), "carrying_cost_rate",
        F.lit(order_cost).alias("estimated_order_cost"),
        F.round("eoq", 0).alias("economic_order_quantity"),
        F.round("orders", 1).alias("orders_per_year"),
        F.round(F.try_divide(F.lit(365.0), F.col("orders")), 1).alias("days_between_orders"),
    )
    return result.orderBy(F.desc("economic_order_quantity")) if ordered else result


@operator(
    instead=instead("date sku_id quantity_fulfilled"),
    sales="date sku_id quantity_fulfilled",
    sku_master="sku_id product_name category",
    current_inventory="sku_id warehouse_id quantity_on_hand total_value_cents",
)
def slow_moving_inventory(t: Tables, *, as_of: date, lookback_days: int = 90,
                          ordered: bool = True) -> DataFrame:
    """Days of stock per SKU and warehouse from recent sales, and whether it is slow or dead."""
    recent = (
        since(t["sales"], F.date_sub(F.lit(as_of), lookback_days))
        .groupBy("sku_id")
        .agg(F.max("date").alias("last_sale_date"), F.sum("quantity_fulfilled").alias("sold"))
    )
    rows = (
        t["current_inventory"].filter(F.col("quantity_on_hand") > 0)
        .join(t["sku_master"], "sku_id").join(recent, "sku_id", "left")
    )
    per_day = ratio("sold", F.lit(float(lookback_days)))
    days = F.round(ratio("quantity_on_hand", per_day), 0)
    status = F.when(F.col("sold").isNull(), F.lit(labels.STOCK_NO_SALES)).otherwise(
        banded(days, labels.STOCK_BANDS, labels.STOCK_REST)
    )
    stock_days = F.coalesce(days, F.lit(labels.STOCK_DAYS_UNKNOWN))
    if ordered:  # before further columns are made, so that fewer are sorted
        rows = rows.orderBy(F.desc(stock_days))
    return rows.select(
        "sku_id", "product_name", "category", "warehouse_id", "quantity_on_hand",
        money("total_value_cents").alias("total_value"), "last_sale_date",
        F.datediff(F.lit(as_of), F.col("last_sale_date")).alias("days_since_last_sale"),
        F.coalesce("sold", F.lit(0)).alias("units_sold_last_90days"),
        stock_days.alias("days_of_inventory"),
        status.alias("inventory_status"),
    )
