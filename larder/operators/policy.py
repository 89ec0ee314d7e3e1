"""Inventory policy: order quantity, safety stock, reorder point, and what they cost."""

from __future__ import annotations

from datetime import date
from statistics import NormalDist

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.functions import labels
from larder.functions.columns import money, percent, ratio, rounded, squares, stddev_samp_exact
from larder.functions.report import dollars, key_values, units, with_percent
from larder.plans.operator import Tables, operator

READS = dict(
    sales="sku_id quantity_fulfilled",
    sku_master="sku_id product_name category unit_cost_cents lead_time_days carrying_cost_rate",
)
STOCK = "sku_id quantity_on_hand reorder_point safety_stock"


def demand_by_sku(t: Tables, history_years: float) -> DataFrame:
    qty = F.col("quantity_fulfilled")
    stats = t["sales"].groupBy("sku_id").agg(
        F.count(qty).alias("n"), F.sum(qty).alias("total"), squares(qty).alias("squares")
    ).withColumn("avg_daily_demand", ratio("total", "n"))
    spread = F.coalesce(stddev_samp_exact("n", "total", "squares"), F.col("avg_daily_demand") * 0.1)
    return stats.select(
        "sku_id", "avg_daily_demand", spread.alias("std_daily_demand"),
        (F.col("total") / F.lit(float(history_years))).alias("total_annual_demand"),
        F.col("n").alias("num_transactions"),
    ).join(t["sku_master"], "sku_id", "left").withColumn("unit_cost", money("unit_cost_cents"))


def with_policy(rows: DataFrame, service_level: float, order_cost: float) -> DataFrame:
    """All policy columns for rows with demand, cost, rate and lead time. Halves round to even."""
    z = NormalDist().inv_cdf(service_level)
    demand, eoq, orders = F.col("total_annual_demand"), F.col("eoq"), F.col("orders_per_year")
    steps = (
        ("carrying_cost_per_unit", F.col("unit_cost") * F.col("carrying_cost_rate")),
        ("eoq", F.bround(F.coalesce(F.sqrt(F.try_divide(2 * demand * F.lit(float(order_cost)),
                                                        F.col("carrying_cost_per_unit"))), F.lit(0.0))).cast("long")),
        ("orders_per_year", F.bround(F.coalesce(ratio(demand, eoq), F.lit(0.0)), 1)),
        ("days_between_orders", F.bround(F.coalesce(F.try_divide(F.lit(365.0), orders), F.lit(365.0))).cast("int")),
        ("safety_stock", F.bround(F.coalesce(F.lit(z) * F.col("std_daily_demand")
                                             * F.sqrt(F.col("lead_time_days").cast("double")), F.lit(0.0))).cast("long")),
        ("lead_time_demand", F.bround(F.col("avg_daily_demand") * F.col("lead_time_days")).cast("long")),
        ("reorder_point", F.col("lead_time_demand") + F.col("safety_stock")),
        ("annual_ordering_cost", orders * F.lit(float(order_cost))),
        ("avg_inventory", eoq / F.lit(2.0) + F.col("safety_stock")),
        ("annual_carrying_cost", F.col("avg_inventory") * F.col("carrying_cost_per_unit")),
        ("total_annual_cost", F.col("annual_ordering_cost") + F.col("annual_carrying_cost")),
    )
    for name, value in steps:
        rows = rows.withColumn(name, value)
    return rows


def policy_rows(t: Tables, service_level: float = 0.95, order_cost: float = labels.ORDER_COST,
                history_years: float = 2.0) -> DataFrame:
    return with_policy(demand_by_sku(t, history_years), service_level, order_cost)


@operator(**READS)
def demand_statistics(t: Tables, *, history_years: float = 2.0) -> DataFrame:
    """Mean, sample deviation (a tenth of the mean for a single row) and yearly demand per SKU."""
    return demand_by_sku(t, history_years).drop("unit_cost_cents")


@operator(**READS)
def eoq_policy(t: Tables, **params: float) -> DataFrame:
    """Order quantity rounded to units, orders per year and days between orders."""
    return policy_rows(t, **params).select(
        "sku_id", "total_annual_demand", "carrying_cost_per_unit", "eoq", "orders_per_year", "days_between_orders"
    )


@operator(**READS)
def safety_stock(t: Tables, **params: float) -> DataFrame:
    """Units that cover demand swings over the lead time at the service level."""
    return policy_rows(t, **params).select("sku_id", "std_daily_demand", "lead_time_days", "safety_stock")


@operator(**READS)
def reorder_point(t: Tables, **params: float) -> DataFrame:
    """Demand over the lead time plus safety stock."""
    return policy_rows(t, **params).select("sku_id", "lead_time_demand", "safety_stock", "reorder_point")


@operator(**READS)
def inventory_cost(t: Tables, *, ordered: bool = True, **params: float) -> DataFrame:
    """Yearly ordering and carrying cost per category."""
    names = ("total_annual_cost", "annual_ordering_cost", "annual_carrying_cost")
    result = policy_rows(t, **params).groupBy("category").agg(*(rounded(F.sum(c)).alias(c) for c in names))
    return result.orderBy(F.desc("total_annual_cost")) if ordered else result


def compared(t: Tables, mode: str, **params: float) -> DataFrame:
    policy = policy_rows(t, **params).withColumnsRenamed(
        {"reorder_point": "reorder_point_optimized", "safety_stock": "safety_stock_optimized"}
    )
    stock = t["current_inventory"]
    if mode == "corrected":
        stock = stock.groupBy("sku_id").agg(
            *(F.sum(c).alias(c) for c in ("quantity_on_hand", "reorder_point", "safety_stock"))
        )
    stock = stock.withColumnsRenamed(
        {"reorder_point": "reorder_point_current", "safety_stock": "safety_stock_current"}
    )
    rows = policy.join(stock, "sku_id", "left")
    if mode == "corrected":
        rows = rows.fillna(0, ["quantity_on_hand", "reorder_point_current", "safety_stock_current"])
    per_unit = F.col("carrying_cost_per_unit")
    rows = rows.withColumns({
        "current_carrying_cost": F.col("quantity_on_hand") * per_unit,
        "optimized_carrying_cost": F.col("avg_inventory") * per_unit,
        "rop_difference": F.col("reorder_point_optimized") - F.col("reorder_point_current"),
        "safety_stock_difference": F.col("safety_stock_optimized") - F.col("safety_stock_current"),
    })
    return rows.withColumn("potential_savings", F.col("current_carrying_cost") - F.col("optimized_carrying_cost"))


@operator(**READS, current_inventory=STOCK)
def policy_comparison(t: Tables, *, mode: str = "reference", ordered: bool = True, **params: float) -> DataFrame:
    """Current against computed policy, and the carrying cost saved.

    ``mode='reference'`` sets the SKU's policy against each warehouse's stock, and leaves savings
    NULL without stock; ``mode='corrected'`` adds up the stock of a SKU first, none counting as zero.
    """
    result = compared(t, mode, **params).select(
        "sku_id", "product_name", "category", "eoq", "reorder_point_optimized", "safety_stock_optimized",
        "reorder_point_current", "safety_stock_current", "rop_difference", "safety_stock_difference",
        rounded("potential_savings").alias("potential_savings"),
    )
    return result.orderBy(F.desc_nulls_last("potential_savings")) if ordered else result


@operator(**READS, current_inventory=STOCK)
def policy_savings(t: Tables, *, mode: str = "reference", **params: float) -> DataFrame:
    """Totals of the comparison and how many reorder points go up or down."""
    return compared(t, mode, **params).agg(
        rounded(F.sum("current_carrying_cost")).alias("current_cost"),
        rounded(F.sum("optimized_carrying_cost")).alias("optimized_cost"),
        rounded(F.sum("potential_savings")).alias("savings"),
        percent(F.sum("potential_savings"), F.sum("current_carrying_cost")).alias("savings_pct"),
        F.count_if(F.col("rop_difference") > 0).alias("increase_reorder_point"),
        F.count_if(F.col("rop_difference") < 0).alias("decrease_reorder_point"),
    )


@operator(**READS)
def policy_detail(t: Tables, *, ordered: bool = True, **params: float) -> DataFrame:
    """The whole policy per SKU, most expensive first."""
    result = policy_rows(t, **params).select(
        "sku_id", "product_name", "category", "avg_daily_demand", "std_daily_demand", "total_annual_demand",
        "lead_time_days", "unit_cost", "carrying_cost_rate", "eoq", "orders_per_year", "days_between_orders",
        "safety_stock", "reorder_point", rounded("annual_ordering_cost").alias("annual_ordering_cost"),
        rounded("annual_carrying_cost").alias("annual_carrying_cost"),
        rounded("total_annual_cost").alias("total_annual_cost"),
    )
    return result.orderBy(F.desc("total_annual_cost")) if ordered else result


@operator(**READS, current_inventory=STOCK)
def policy_summary(t: Tables, *, as_of: date, mode: str = "reference", service_level: float = 0.95,
                   **params: float) -> DataFrame:
    """Means, totals and savings as text."""
    params["service_level"] = service_level
    means = policy_rows(t, **params).agg(
        F.count(F.lit(1)).alias("n"), *(ratio(F.sum(c), F.count(c)).alias(c)
                                        for c in ("eoq", "reorder_point", "safety_stock")),
        F.sum("total_annual_cost").alias("total"),
    )
    # Sums of decimals do not depend on the order of partitions: a total may lie on half a cent.
    saved = compared(t, mode, **params).agg(
        *(F.sum(F.col(c).cast("decimal(28,6)")).alias(name) for c, name in (
            ("current_carrying_cost", "current"), ("optimized_carrying_cost", "optimized"), ("potential_savings", "savings"))),
    )
    top = key_values(
        means,
        Analysis_Date=F.lit(as_of), SKUs_Analyzed=F.col("n"), Target_Service_Level=F.lit(f"{service_level:.0%}"),
        Average_EOQ=units(F.col("eoq")), Average_Reorder_Point=units(F.col("reorder_point")),
        Average_Safety_Stock=units(F.col("safety_stock")),
        **{"Total_Annual_Inventory_Cost_(Optimized)": dollars(F.col("total"))},
    )
    return top.unionByName(key_values(
        saved,
        Current_Annual_Carrying_Cost=dollars(F.round("current", 2).cast("double")),
        Optimized_Annual_Carrying_Cost=dollars(F.round("optimized", 2).cast("double")),
        Potential_Annual_Savings=dollars(F.round("savings", 2).cast("double")),
        Cost_Reduction_Percentage=with_percent(percent("savings", "current", None), 1),
    ))
