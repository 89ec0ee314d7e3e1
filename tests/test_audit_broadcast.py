"""Queries that run side by side share what one may broadcast; the session has its setting back afterwards."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from larder.operators import inventory
from larder.plans.audit import BROADCAST, CLEAN_UP, query_audit


@pytest.mark.parametrize("setting, wanted", [("64m", 64 * 2**20 // 16), ("-1", -1)])
def test_audited_queries_broadcast_less(spark, setting, wanted):
    before, seen = spark.conf.get(BROADCAST), []

    def build():
        seen.append(int(spark.conf.get(BROADCAST)))
        return spark.range(3)

    def broken():
        raise ValueError("no")

    try:
        spark.conf.set(BROADCAST, setting)
        log = query_audit(spark, {"a": build, "b": broken, "c": build}, at_once=2).collect()
        assert spark.conf.get(BROADCAST) == setting
    finally:
        spark.conf.set(BROADCAST, before)
    assert seen == [wanted, wanted] and [r["rows_returned"] for r in log] == [3, 0, 3]


def test_what_a_query_shuffled_goes_when_it_ends(spark, tmp_path):
    kept = []

    def left(name):
        def build():
            kept.append(spark.conf.get(CLEAN_UP))
            return spark.range(1000).repartition(3, F.col("id") % 7).groupBy((F.col("id") % 7).alias("k")).count()
        return build

    before = spark.conf.get(CLEAN_UP)
    log = query_audit(spark, {"a": left("a"), "b": left("b")})
    assert [r.rows_returned for r in log.collect()] == [7, 7]
    assert kept == ["true", "true"] and spark.conf.get(CLEAN_UP) == before


def test_sorts_carry_no_derived_columns(spark):
    tables = {
        "sales": spark.createDataFrame([(date(2001, 10, 1), k, 10 * k) for k in range(1, 6)], "date date, sku_id long, quantity_fulfilled long"),
        "sku_master": spark.createDataFrame([(k, f"p{k}", "c", 100) for k in range(1, 7)], "sku_id long, product_name string, category string, unit_cost_cents long"),
        "warehouse_master": spark.createDataFrame([(1, "w")], "warehouse_id int, warehouse_name string"),
        "current_inventory": spark.createDataFrame([(k, 1, 7, 100) for k in range(1, 7)], "sku_id long, warehouse_id int, quantity_on_hand long, unit_cost_cents long"),
    }
    found = inventory.inventory_turnover(tables, as_of=date(2001, 11, 5))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "movement_category" not in plan[plan.index("Sort ["):] and "days_inventory_on_hand" not in plan[plan.index("Sort ["):]
    assert [(r.sku_id, r.inventory_turnover_ratio) for r in found.collect()] == [(5, 7.14), (4, 5.71), (3, 4.29), (2, 2.86), (1, 1.43), (6, None)]
