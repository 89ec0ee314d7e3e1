"""Supplier scorecards, lead times and cost of ownership."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.functions import labels
from larder.functions.columns import banded, money, paired_tier, percent, ratio, squares, stddev_pop_exact
from larder.plans.operator import Tables, operator


@operator(
    supplier_master="supplier_id supplier_name supplier_type country",
    purchase_orders="supplier_id total_cost_cents lead_time_actual lead_time_expected on_time quality_accepted",
)
def supplier_scorecard_po(t: Tables, *, ordered: bool = True) -> DataFrame:
    """Spend, delays, punctuality, quality, composite score and tier from purchase orders."""
    cost = F.col("total_cost_cents")
    record = t["purchase_orders"].groupBy("supplier_id").agg(
        F.count(F.lit(1)).alias("total_orders"),
        F.sum(cost).alias("spend"),
        F.sum("lead_time_actual").alias("lead"),
        F.sum(F.col("lead_time_actual") - F.col("lead_time_expected")).alias("delay"),
        F.count_if("on_time").alias("punctual"),
        F.count_if("quality_accepted").alias("good"),
        F.sum(F.when(F.col("on_time"), F.lit(0)).otherwise(cost)).alias("late_cost"),
    )
    rows = t["supplier_master"].join(record, "supplier_id", "left").withColumns({
        "lead_mean": ratio("lead", "total_orders"),
        "punctual_pct": percent("punctual", "total_orders", None),
        "good_pct": percent("good", "total_orders", None),
    })
    lead_score = F.when(F.col("lead_mean") < 60, F.lit(100.0)).otherwise(100 - (F.col("lead_mean") - 60))
    score = F.col("punctual_pct") * 0.4 + F.col("good_pct") * 0.4 + lead_score * 0.2
    result = rows.select(
        "supplier_id", "supplier_name", "supplier_type", "country", "total_orders",
        money("spend").alias("total_spend"),
        F.round("lead_mean", 1).alias("avg_lead_time_days"),
        F.round(ratio("delay", "total_orders"), 1).alias("avg_delay_days"),
        F.round("punctual_pct", 2).alias("on_time_delivery_pct"),
        F.round("good_pct", 2).alias("quality_acceptance_pct"),
        money("late_cost").alias("cost_of_late_deliveries"),
        F.round(score, 2).alias("composite_score"),
        paired_tier(F.col("punctual_pct"), F.col("good_pct"), labels.ORDER_TIERS, labels.TIER_4).alias("supplier_tier"),
    )
    return result.orderBy(F.desc_nulls_last("composite_score")) if ordered else result


@operator(
    supplier_master="supplier_id supplier_name supplier_type country on_time_delivery_rate quality_rating "
                    "payment_terms_days minimum_order_quantity",
)
def supplier_scorecard_master(t: Tables, *, ordered: bool = True) -> DataFrame:
    """Tier per supplier from the rates held in master data."""
    rate, quality = F.col("on_time_delivery_rate"), F.col("quality_rating")
    rows = t["supplier_master"]
    if ordered:
        rows = rows.orderBy(rate.desc(), quality.desc())
    return rows.select(
        "supplier_id", "supplier_name", "supplier_type", "country",
        F.round(rate * 100, 2).alias("on_time_delivery_pct"), "quality_rating",
        "payment_terms_days", "minimum_order_quantity",
        paired_tier(rate, quality, labels.MASTER_TIERS, labels.TIER_4).alias("supplier_tier"),
    )


@operator(purchase_orders="supplier_id lead_time_actual")
def lead_time_variability(t: Tables, *, ordered: bool = True) -> DataFrame:
    """Mean, range and population deviation of the actual lead time per supplier."""
    lead = F.col("lead_time_actual")
    stats = t["purchase_orders"].groupBy("supplier_id").agg(
        F.count(F.lit(1)).alias("num_orders"), F.count(lead).alias("n"), F.sum(lead).alias("total"),
        squares(lead).alias("squares"), F.min(lead).alias("low"), F.max(lead).alias("high"),
    ).withColumn("sd", stddev_pop_exact("n", "total", "squares"))
    result = stats.select(
        "supplier_id", "num_orders",
        F.round(ratio("total", "n"), 1).alias("avg_lead_time"),
        F.col("low").cast("double").alias("min_lead_time"),
        F.col("high").cast("double").alias("max_lead_time"),
        (F.col("high") - F.col("low")).cast("double").alias("lead_time_range"),
        F.round("sd", 2).alias("stddev_lead_time"),
        banded(F.col("sd"), labels.LEAD_TIME_BANDS, labels.LEAD_TIME_REST).alias("variability_category"),
    )
    return result.orderBy(F.desc("stddev_lead_time")) if ordered else result


@operator(
    supplier_master="supplier_id supplier_name country",
    purchase_orders="supplier_id total_cost_cents order_quantity received_quantity on_time",
)
def supplier_tco(t: Tables, *, defect_cost: int = labels.DEFECT_COST, late_cost: int = labels.LATE_COST,
                 ordered: bool = True) -> DataFrame:
    """Purchase cost plus a penalty per missing unit and per late delivery."""
    record = t["purchase_orders"].groupBy("supplier_id").agg(
        F.sum("total_cost_cents").alias("spend"),
        F.sum(F.col("order_quantity") - F.col("received_quantity")).alias("short_units"),
        F.count_if(~F.col("on_time")).alias("late"),
    )
    rows = t["supplier_master"].join(record, "supplier_id", "left").withColumns({
        "quality": F.col("short_units") * (100 * defect_cost), "expedite": F.col("late") * (100 * late_cost),
    })
    hidden = F.col("quality") + F.col("expedite")
    result = rows.select(
        "supplier_id", "supplier_name", "country",
        money("spend").alias("purchase_cost"),
        money("quality").alias("quality_cost"),
        money("expedite").alias("expediting_cost"),
        money(F.col("spend") + hidden).alias("total_cost_of_ownership"),
        percent(hidden, "spend").alias("hidden_cost_pct"),
    )
    return result.orderBy(F.desc_nulls_last("total_cost_of_ownership")) if ordered else result
