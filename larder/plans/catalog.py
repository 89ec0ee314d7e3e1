"""The named queries: operator, parameters, and the star-schema tables they run on."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date
from functools import lru_cache, partial
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.operators import bom, dashboard, demand, explore, forecast, inventory, kpi, models, policy, profit, quality, service, supplier
from larder.functions.columns import month_start
from larder.functions.pin import scratch_path
from larder.plans.audit import query_audit
from larder.plans.operator import Operator
from larder.sources import files, summary
from larder.sources.star import ALL_COLUMNS, StarViews

Query = Callable[[SparkSession, str], DataFrame]

AS_OF = date(2001, 11, 5)
HISTORY_YEARS = 7.0


def on_star(op: Operator, **params: Any) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return op(StarViews(spark, folder).tables(op.reads), as_of=AS_OF, **params)

    return run


def quality_of_all_tables(spark: SparkSession, folder: str) -> DataFrame:
    return quality.data_quality(StarViews(spark, folder).tables(ALL_COLUMNS))


@lru_cache(maxsize=4)
def _fitted(application: str, folder: str, by: str, regress: bool) -> models.ProfitModels:
    reads = {table: tuple(names.split()) for table, names in profit.READS.items()}
    return models.fit(StarViews(SparkSession.getActiveSession(), folder).tables(reads), by=by, regress=regress)


def fitted(spark: SparkSession, folder: str, by: str, regress: bool) -> models.ProfitModels:
    """Fitted once per application and folder: several queries read the same models, none those of
    an application that has ended."""
    return _fitted(spark.sparkContext.applicationId, folder, by, regress)


def with_models(use: Callable[[models.ProfitModels], DataFrame], by: str, regress: bool = True) -> Query:
    return lambda spark, folder: use(fitted(spark, folder, by, regress))


def feature_importance(spark: SparkSession, folder: str) -> DataFrame:
    return models.feature_importance(spark, fitted(spark, folder, "sku_id", False))


def csv_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """SKU master written as CSV and read back by its schema."""
    master = StarViews(spark, folder).table("sku_master", ALL_COLUMNS["sku_master"])
    path, columns = scratch_path(spark, "sku_master"), files.file_columns(master, "sku_master")
    files.write_csv(columns, path)
    return files.read_csv(spark, path, "sku_master", columns.columns)


def json_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Supplier master written as JSON records and read back by its schema."""
    master = StarViews(spark, folder).table("supplier_master", ALL_COLUMNS["supplier_master"])
    path = scratch_path(spark, "supplier_master")
    files.write_json_records(files.file_columns(master, "supplier_master"), path)
    return files.read_json_records(spark, path, "supplier_master", array_file=False)


def json_array_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Supplier master written as JSON arrays of about a thousand records and read back in splits."""
    master = files.file_columns(StarViews(spark, folder).table("supplier_master", ALL_COLUMNS["supplier_master"]), "supplier_master")
    arrays = master.agg(F.ceil(F.count(F.lit(1)) / F.lit(1000.0))).scalar()
    record = F.to_json(F.struct(*master.columns))
    rows = master.select(record.alias("record"), F.pmod(F.xxhash64(*master.columns), arrays).alias("array"))
    path = scratch_path(spark, "supplier_arrays")
    rows.groupBy("array").agg(F.concat(F.lit("["), F.array_join(F.collect_list("record"), ",\n"), F.lit("]")).alias("value")).select("value").write.text(path)
    return files.read_json_records(spark, path, "supplier_master")


def table_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Sales written by month and read back, summed over the months."""
    columns = ("date", "sku_id", "quantity_ordered", "quantity_fulfilled", "backorder_quantity")
    path = scratch_path(spark, "sales")
    files.write_table(StarViews(spark, folder).table("sales", columns), path, by_month="date")
    return files.read_table(spark, path).groupBy(F.col("sales_month").cast("string").alias("sales_month")).agg(
        F.count(F.lit(1)).alias("rows"), *(F.sum(c).alias(c) for c in columns[2:]), F.count_distinct("sku_id").alias("skus"),
        F.min("date").alias("first_date"), F.max("date").alias("last_date"),
    )


def sales_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Sales by SKU and day, written by month and read back."""
    path = scratch_path(spark, "sales_summary")
    summary.write_sales_summary(StarViews(spark, folder).table("sales", summary.READS), path)
    rows = summary.read_sales_summary(spark, path)
    return rows.withColumn(summary.MONTH, F.col(summary.MONTH).cast("string"))


def result_as_csv(spark: SparkSession, folder: str) -> DataFrame:
    """A result written as CSV and read back by its own schema."""
    result = QUERIES["monthly_sales_trends"](spark, folder)
    path = scratch_path(spark, "monthly_sales_trends")
    files.write_csv(result, path)
    return spark.read.schema(result.schema).option("header", True).csv(path)


def result_as_json(spark: SparkSession, folder: str) -> DataFrame:
    """A result written as JSON records and read back by its own schema."""
    result = QUERIES["category_performance"](spark, folder)
    path = scratch_path(spark, "category_performance")
    files.write_json_records(result, path)
    return spark.read.schema(result.schema).json(path)


def stock_table(spark: SparkSession, folder: str) -> DataFrame:
    """Stock kept as a table, read whole."""
    path = scratch_path(spark, "current_inventory")
    files.write_table(StarViews(spark, folder).table("current_inventory", ALL_COLUMNS["current_inventory"]), path)
    return files.read_table(spark, path)


def stock_movements(spark: SparkSession, folder: str) -> DataFrame:
    """Receipts and shipments per warehouse and month."""
    moves = StarViews(spark, folder).table("inventory_transactions", ALL_COLUMNS["inventory_transactions"])
    return moves.groupBy("warehouse_id", "transaction_type", month_start("transaction_date").alias("month")).agg(
        F.count(F.lit(1)).alias("transactions"), F.sum("quantity").alias("quantity"), F.sum("total_value_cents").alias("value_cents"))


def parsed_dates(spark: SparkSession, folder: str) -> DataFrame:
    """Order dates from text, counted."""
    text = StarViews(spark, folder).raw("orders", "o_orderdate").select(F.col("o_orderdate").cast("string"))
    return files.parse_dates(text, "o_orderdate").groupBy("o_orderdate").agg(F.count(F.lit(1)).alias("orders"))


# The queries whose runs are logged together.
AUDITED = ("abc_classification", "inventory_turnover", "eoq_sql", "slow_moving_inventory", "seasonal_decomposition",
           "demand_volatility", "supplier_scorecard_master", "fill_rate_analysis", "warehouse_efficiency",
           "executive_kpis")


def audited(spark: SparkSession, folder: str) -> DataFrame:
    """Log of the ten standard queries, without the seconds (which differ from run to run)."""
    log = query_audit(spark, {name: partial(QUERIES[name], spark, folder) for name in AUDITED})
    return log.drop("execution_time_sec")


QUERIES: dict[str, Query] = {
    "abc_classification": on_star(inventory.abc_classification),
    "inventory_turnover": on_star(inventory.inventory_turnover),
    "eoq_sql": on_star(inventory.eoq_sql),
    "slow_moving_inventory": on_star(inventory.slow_moving_inventory),
    "seasonal_decomposition": on_star(demand.seasonal_decomposition),
    "demand_volatility": on_star(demand.demand_volatility),
    # SKUs of the test tables share a handful of days at most, far below the default of 30.
    "sku_cooccurrence": on_star(demand.sku_cooccurrence, min_days=3),
    "demand_trend": on_star(demand.demand_trend),
    "supplier_scorecard_po": on_star(supplier.supplier_scorecard_po),
    "supplier_scorecard_master": on_star(supplier.supplier_scorecard_master),
    "lead_time_variability": on_star(supplier.lead_time_variability),
    "supplier_tco": on_star(supplier.supplier_tco),
    # About 30 sales rows per SKU over seven years: the default six months would hold too few.
    "fill_rate_analysis": on_star(service.fill_rate_analysis, lookback_months=None),
    "fill_rate_analysis_six_months": on_star(service.fill_rate_analysis, min_orders=1),
    "stockout_root_cause": on_star(service.stockout_root_cause),
    "stockout_root_cause_bounded": on_star(service.stockout_root_cause, mode="bounded"),
    "warehouse_efficiency": on_star(service.warehouse_efficiency),
    "bom_explosion": on_star(bom.bom_explosion),
    "bom_paths": on_star(bom.bom_paths),
    "bom_cycles": on_star(bom.bom_cycles),
    "executive_kpis": on_star(kpi.executive_kpis),
    "executive_kpis_corrected": on_star(kpi.executive_kpis, mode="corrected"),
    # Sources and sinks
    "read_csv": csv_round_trip,
    "read_json_records": json_round_trip,
    "read_json_arrays": json_array_round_trip,
    "write_table": table_round_trip,
    "read_table": stock_table,
    "write_csv": result_as_csv,
    "write_json_records": result_as_json,
    "parse_dates": parsed_dates,
    "inventory_transactions": stock_movements,
    "query_audit": audited,
    "sales_summary": sales_summary,
    "report_kv": on_star(explore.report_kv),
    # Exploratory figures
    "data_quality": quality_of_all_tables,
    **{op.name: on_star(op) for op in (
        explore.sales_totals, explore.monthly_sales_trends, explore.monthly_sales_summary,
        explore.seasonal_pattern, explore.category_performance, explore.stockout_summary,
        explore.inventory_position, explore.top_warehouses, explore.below_reorder_point,
        explore.excess_inventory, explore.supplier_tier_counts, explore.supplier_by_country,
        explore.insights, explore.executive_summary,
    )},
    # Inventory policy: the test tables span seven years of sales
    **{op.name: on_star(op, history_years=HISTORY_YEARS) for op in (
        policy.demand_statistics, policy.eoq_policy, policy.safety_stock, policy.reorder_point,
        policy.inventory_cost, policy.policy_comparison, policy.policy_savings, policy.policy_detail,
        policy.policy_summary, dashboard.cost_pareto_top_n, dashboard.top_cost_drivers,
        dashboard.category_cost, dashboard.policy_averages,
    )},
    "policy_comparison_corrected": on_star(policy.policy_comparison, mode="corrected", history_years=HISTORY_YEARS),
    "policy_savings_corrected": on_star(policy.policy_savings, mode="corrected", history_years=HISTORY_YEARS),
    # Dashboard tables
    **{op.name: on_star(op) for op in (
        dashboard.daily_sales, dashboard.year_month_units, dashboard.avg_by_month,
        dashboard.category_sales_desc, dashboard.pareto_top_n, dashboard.top_suppliers,
        dashboard.stockout_rate_by_category, dashboard.warehouse_utilization_band,
        dashboard.dashboard_kpis, dashboard.monthly_revenue, dashboard.supplier_kpis,
        dashboard.supplier_type_distribution, dashboard.day_of_week_pattern,
    )},
    # Forecasts, one series per category
    "daily_demand": on_star(forecast.daily_demand, by="category"),
    "daily_demand_filled": on_star(forecast.daily_demand, by="category", fill=True),
    "holdout_split": on_star(forecast.holdout_split, by="category"),
    "forecast_naive": on_star(forecast.forecast, by="category", models=[forecast.NAIVE]),
    "forecast_moving_average": on_star(forecast.forecast, by="category", models=forecast.BASELINES[1:]),
    "forecast_holt_winters": on_star(forecast.forecast, by="category", models=[forecast.SMOOTHING]),
    "forecast_holt_winters_stated": on_star(forecast.smoothed, by="category", weights=(0.2, 0.1, 0.3), digits=2),
    "forecast_seasonal_ar": on_star(forecast.forecast, by="category", models=[forecast.SEASONAL_AR], digits=2),
    "forecast_trend_fourier": on_star(forecast.forecast_band, by="category"),
    "forecast_metrics": on_star(forecast.forecast_metrics, by="category", models=forecast.BASELINES),
    "forecast_ranking": on_star(forecast.forecast_ranking, by="category", models=forecast.BASELINES),
    "forecast_ranking_all_models": on_star(forecast.forecast_ranking, by="category"),
    "forecast_summary": on_star(forecast.forecast_summary, by="category", models=forecast.BASELINES),
    "forecast_wide": on_star(forecast.forecast_wide, by="category", models=forecast.BASELINES),
    "error_histogram": on_star(forecast.error_histogram, by="category", model=forecast.BASELINES[1]),
    # Other grains: the company as a whole, and every SKU with its empty days
    "daily_demand_company": on_star(forecast.daily_demand),
    "forecast_metrics_company": on_star(forecast.forecast_metrics, models=forecast.BASELINES),
    "forecast_ranking_company": on_star(forecast.forecast_ranking, models=forecast.BASELINES),
    "daily_demand_sku_filled": on_star(forecast.daily_demand, by="sku_id", fill=True),
    "forecast_metrics_sku": on_star(forecast.forecast_metrics, by="sku_id", fill=True, models=forecast.BASELINES),
    "forecast_ranking_sku": on_star(forecast.forecast_ranking, by="sku_id", fill=True),
    # Monthly profit and features, one entity per SKU
    **{op.name: on_star(op, by="sku_id") for op in (
        profit.monthly_profitability, profit.lag_features, profit.rolling_features, profit.mom_change,
        profit.calendar_features, profit.cost_ratios, profit.risk_flags, profit.drop_incomplete,
        profit.horizon_target, profit.train_test_sample, profit.profit_summary,
    )},
    "standardize": on_star(profit.standardize, by="sku_id", digits=4),
    # The same for the company as a whole
    **{f"{op.name}_company": on_star(op) for op in (
        profit.monthly_profitability, profit.lag_features, profit.rolling_features, profit.mom_change,
        profit.calendar_features, profit.cost_ratios, profit.risk_flags, profit.drop_incomplete,
        profit.horizon_target, profit.train_test_sample, profit.profit_summary,
    )},
    # Models: losses occur on SKU-months, so the classifier learns there; profit is predicted per category
    "profit_classifier": with_models(models.classified, by="sku_id", regress=False),
    "classifier_metrics": with_models(lambda m: models.classifier_metrics(models.classified(m)), by="sku_id", regress=False),
    "class_report": with_models(lambda m: models.class_report(models.classified(m)), by="sku_id", regress=False),
    "feature_importance": feature_importance,
    "profit_regressor": with_models(models.predicted_profit, by="category"),
    "regressor_metrics": with_models(lambda m: models.regressor_metrics(models.predicted_profit(m)), by="category"),
    "risk_alerts": with_models(models.risk_alerts, by="category"),
    "alert_actions": with_models(lambda m: models.alert_actions(models.risk_alerts(m)), by="category"),
    # Without a fit: profit stays as it is
    **{op.name: on_star(op, by="sku_id") for op in (
        models.persistent_alerts, models.persistent_actions, models.persistent_risk_count, models.persistent_classes,
        models.persistent_report, models.persistent_errors,
    )},
    "high_risk_count": with_models(lambda m: models.high_risk_count(models.risk_alerts(m)), by="category"),
}
