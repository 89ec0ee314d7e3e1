"""Headline figures as (metric, value) rows."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions.columns import money, percent, plain_number
from larder.operators.inventory import months_back
from larder.plans.operator import Tables, operator
from larder.sources.summary import instead, measures, since


@operator(
    instead=instead("date sku_id sales_rows quantity_ordered quantity_fulfilled backorder_rows"),
    sales="date sku_id quantity_ordered quantity_fulfilled backorder_quantity",
    sku_master="sku_id unit_cost_cents",
    current_inventory="sku_id quantity_on_hand total_value_cents",
    supplier_master="on_time_delivery_rate",
)
def executive_kpis(t: Tables, *, as_of: date, mode: str = "reference", turnover_months: int = 12,
                   service_months: int = 6) -> DataFrame:
    """Stock value, mean turnover, fill rate, stockouts and supplier punctuality.

    ``mode='reference'`` counts the cost of goods once per stocked warehouse, against the mean
    value per warehouse; ``mode='corrected'`` counts it once, against the SKU's whole stock.
    """
    # One pass over sales and one over stock: both shrink to one row per SKU before they meet.
    day = F.col("date")
    in_turnover, in_service = (day >= months_back(as_of, m) for m in (turnover_months, service_months))

    def recent(column: Column) -> Column:
        return F.sum(F.when(in_service, column))

    sold = (
        measures(since(t["sales"], months_back(as_of, max(turnover_months, service_months)))).groupBy("sku_id")
        .agg(F.sum(F.when(in_turnover, F.col("quantity_fulfilled"))).alias("sold"),
             recent(F.col("quantity_fulfilled")).alias("filled"), recent(F.col("quantity_ordered")).alias("wanted"),
             F.coalesce(recent(F.col("backorder_rows")), F.lit(0)).alias("stockouts"))
    )
    stock = t["current_inventory"].groupBy("sku_id").agg(
        F.count(F.lit(1)).alias("warehouses"), F.sum("quantity_on_hand").alias("on_hand"),
        F.sum("total_value_cents").alias("stock_cents"),
    )
    per_sku = sold.join(stock, "sku_id", "full").join(t["sku_master"], "sku_id", "left")
    cogs = (F.col("sold") * F.col("unit_cost_cents")).cast("double")
    value = (F.col("on_hand") * F.col("unit_cost_cents")).cast("double")
    if mode == "reference":
        turns = F.try_divide(cogs * F.col("warehouses"), F.try_divide(value, F.col("warehouses").cast("double")))
    else:
        turns = F.try_divide(cogs, value)
    figures = per_sku.agg(
        money(F.sum("stock_cents")).alias("stock"), F.round(F.avg(turns), 2).alias("turns"),
        percent(F.sum("filled"), F.sum("wanted")).alias("fill"), F.sum("stockouts").alias("outs"),
    )
    punctual = t["supplier_master"].agg(F.round(F.avg("on_time_delivery_rate") * 100, 2).alias("punctual"))
    stock_value, mean_turns, fill, outs, rate = map(F.col, ("stock", "turns", "fill", "outs", "punctual"))
    return _rows(
        figures,
        _row("Total Inventory Value", stock_value, F.concat(F.lit("$"), plain_number(stock_value))),
        _row("Average Inventory Turnover", mean_turns, plain_number(mean_turns)),
        _row("Overall Fill Rate", fill, F.concat(plain_number(fill), F.lit("%"))),
        _row("Number of Stockout Events", outs.cast("double"), outs.cast("string")),
    ).unionByName(_rows(
        punctual, _row("Average Supplier On-Time Delivery", rate, F.concat(plain_number(rate), F.lit("%")))
    ))


def _row(metric: str, value: Column, text: Column) -> Column:
    return F.struct(F.lit(metric).alias("metric"), value.alias("value"), text.alias("value_text"))


def _rows(one: DataFrame, *rows: Column) -> DataFrame:
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
