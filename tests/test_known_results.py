"""Known outputs, in samples. Inputs and the results they must give."""

from pyspark.sql import functions as F

from larder.operators import explore, forecast, inventory, models, policy, service, supplier

POLICY_IN = ("sku_id string, avg_daily_demand double, std_daily_demand double, total_annual_demand double, "
             "lead_time_days int, unit_cost double, carrying_cost_rate double")
POLICY = [
    (("SKU0039", 75.92476060191518, 37.930521592307784, 27750.5, 105, 796.46, 0.241),
     (120, 231.3, 2, 639, 8611, 11565.0, 134170.85514, 145735.85514)),
    (("SKU0048", 65.26575342465753, 33.27279366281735, 23822.0, 103, 688.11, 0.212),
     (128, 186.1, 2, 555, 7277, 9305.0, 90299.29908, 99604.29908)),
    (("SKU0177", 61.071135430916556, 31.733830980658972, 22321.5, 66, 737.42, 0.249),
     (110, 202.9, 2, 424, 4455, 10145.0, 87952.82082, 98097.82082)),
]
POLICY_OUT = ("eoq", "orders_per_year", "days_between_orders", "safety_stock", "reorder_point",
              "annual_ordering_cost", "annual_carrying_cost", "total_annual_cost")


def test_policy(make):
    rows = policy.with_policy(make(POLICY_IN, *(i for i, _ in POLICY)), 0.95, 50)
    got = {r.sku_id: tuple(round(r[c], 6) for c in POLICY_OUT) for r in rows.collect()}
    assert got == {i[0]: out for i, out in POLICY}


def test_order_quantity(make):
    rows = make("sku_id string, product_name string, category string, annual_units_sold long, unit_cost_cents long, "
                "carrying_cost_rate double",
                ("SKU0111", "n", "Accessories", 24306, 1048, 0.167), ("SKU0130", "n", "Accessories", 39548, 1920, 0.242),
                ("SKU0054", "n", "Components", 12640, 1041, 0.155))
    got = [(r.sku_id, r.economic_order_quantity, r.orders_per_year) for r in inventory.order_quantities(rows, 50).collect()]
    assert got == [("SKU0111", 1178.0, 20.6), ("SKU0130", 923.0, 42.9), ("SKU0054", 885.0, 14.3)]


SUPPLIERS = ("supplier_id string, supplier_name string, supplier_type string, country string, "
             "on_time_delivery_rate double, quality_rating double, payment_terms_days int, minimum_order_quantity int")


def test_scorecard_from_master(make):
    t = {"supplier_master": make(
        SUPPLIERS, ("SUP001", "Supplier_001", "Distributor", "USA", 0.883, 4.38, 30, 1995),
        ("SUP002", "Supplier_002", "Distributor", "China", 0.885, 3.82, 60, 1539),
        ("SUP022", "Supplier_022", "Manufacturer", "Japan", 0.979, 4.56, 30, 1158),
        ("SUP011", "Supplier_011", "Contract Manufacturer", "USA", 0.972, 4.79, 45, 3911))}
    got = [(r.supplier_id, r.on_time_delivery_pct, r.supplier_tier) for r in supplier.supplier_scorecard_master(t).collect()]
    assert got == [("SUP022", 97.9, "Tier 1 - Excellent"), ("SUP011", 97.2, "Tier 1 - Excellent"),
                   ("SUP002", 88.5, "Tier 3 - Acceptable"), ("SUP001", 88.3, "Tier 2 - Good")]
    country = {r.country: (r.avg_on_time_rate, r.avg_quality) for r in explore.supplier_by_country(t).collect()}
    assert country["USA"] == (0.928, 4.585)  # .9275 is a tie: to even


def test_warehouses(make):
    rows = make("warehouse_id string, warehouse_name string, city string, capacity_units int, total_units long, "
                "monthly_operating_cost_cents long",
                ("WH01", "n", "Los Angeles", 183052, 225755, 11719930), ("WH08", "n", "Dallas", 179749, 237351, 16310064))
    got = [(r.warehouse_id, r.utilization_pct, r.cost_per_unit_stored, r.annual_operating_cost, r.efficiency_status)
           for r in service.use_of_capacity(rows).collect()]
    over = "Over Capacity - Expansion Needed"
    assert got == [("WH01", 123.33, 0.52, 1406391.6, over), ("WH08", 132.05, 0.69, 1957207.68, over)]


def test_loss_probability_from_margin(make):
    # Predicted profit, and the month's operating profit over its margin as revenue.
    df = make("p double, r double", (15432760.218235286, 84896992.0), (34179926.31038239, 155191213.0))
    got = [r.x for r in df.select(models.margin_rule(F.col("p"), F.col("r")).alias("x")).collect()]
    assert [round(x, 3) for x in got] == [0.394, 0.266]


def test_forecast_scores(make):
    long = make("series string, date string, model string, actual long, forecast double",
                ("ALL", "1", "Naive", 100, 90.0), ("ALL", "2", "Naive", 50, 60.0), ("ALL", "3", "Naive", 0, 3.0),
                ("ALL", "1", "MA_7day", 100, 100.0), ("ALL", "2", "MA_7day", 50, 49.0), ("ALL", "3", "MA_7day", 0, 0.0))
    ranked = forecast.rank_models(forecast.score(long)).collect()
    assert [r.model for r in ranked] == ["MA_7day", "Naive"]
    naive = ranked[1]
    assert (naive.mae, naive.rmse, naive.mape, naive.bias, naive.forecast_accuracy) == (7.67, 8.35, 15.0, 1.0, 85.0)
    assert naive.zero_actuals == 1 and ranked[0].gain_over_naive == 14.0
