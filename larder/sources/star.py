"""The operators' tables seen through an order/lineitem star schema in parquet.

Every view builds only the joins that its requested columns need. Dimension joins are left
joins on unique keys, so leaving one out never changes the rows that remain.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.session import SPLIT_HOT_KEYS

# Stated, so that opening a table reads no file footer.
RAW_SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
                "l_linestatus string, l_shipdate timestamp_ntz",
}


def _whole(value: Column | str) -> Column:
    value = F.col(value) if isinstance(value, str) else value
    return F.round(value).cast("int")


def _price_cents() -> Column:
    return F.round(F.col("p_retailprice") * 100).cast("long")


def _cost_cents() -> Column:
    return F.floor(_price_cents() * (30 + F.col("p_size")) / F.lit(100.0)).cast("long")


class StarViews:
    """Builds canonical tables, column by column, from the parquet files of one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        # Line items meet parts and orders row by row; one part may hold a third of them.
        spark.conf.set(SPLIT_HOT_KEYS, "true")
        self._spark = spark
        self._folder = folder

    def raw(self, name: str, *columns: str) -> DataFrame:
        return self._spark.read.schema(RAW_SCHEMAS[name]).parquet(f"{self._folder}/{name}.parquet").select(*columns)

    def table(self, name: str, columns: tuple[str, ...]) -> DataFrame:
        build: Callable[[set[str]], DataFrame] = getattr(self, f"_{name}")
        return build(set(columns)).select(*columns)

    def tables(self, reads: Mapping[str, tuple[str, ...]]) -> dict[str, DataFrame]:
        return {name: self.table(name, columns) for name, columns in reads.items()}

    def names(self) -> Iterator[str]:
        return iter(ALL_COLUMNS)

    def _sku_master(self, _: set[str]) -> DataFrame:
        return self.raw("part", "p_partkey", "p_name", "p_type", "p_size", "p_retailprice").select(
            F.col("p_partkey").alias("sku_id"),
            F.col("p_name").alias("product_name"),
            F.col("p_type").alias("category"),
            _cost_cents().alias("unit_cost_cents"),
            _price_cents().alias("unit_price_cents"),
            (45 + F.col("p_size")).alias("lead_time_days"),
            ((150 + 10 * (F.col("p_partkey") % 11)) / F.lit(1000.0)).alias("carrying_cost_rate"),
        )

    def _sales(self, columns: set[str]) -> DataFrame:
        line = self.raw("lineitem", "l_partkey", "l_suppkey", "l_quantity", "l_discount",
                        "l_returnflag", "l_linestatus", "l_shipdate")
        ordered = F.col("l_quantity").cast("long")
        short = (F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "O")
        kept = F.floor(ordered * (50 + 4 * _whole(F.col("l_discount") * 100)) / F.lit(100.0)).cast("long")
        fulfilled = F.when(short, kept).otherwise(ordered)
        rows = line.select(
            F.col("l_shipdate").cast("date").alias("date"),
            F.col("l_partkey").alias("sku_id"),
            "l_suppkey",
            ordered.alias("quantity_ordered"),
            fulfilled.alias("quantity_fulfilled"),
            (ordered - fulfilled).alias("backorder_quantity"),
        )
        if columns & {"category", "unit_price_cents", "revenue_cents"}:
            part = self.raw("part", "p_partkey", "p_type", "p_retailprice").select(
                "p_partkey", F.col("p_type").alias("category"), _price_cents().alias("unit_price_cents")
            )
            rows = rows.join(part, rows["sku_id"] == part["p_partkey"], "left").withColumn(
                "revenue_cents", F.col("quantity_fulfilled") * F.col("unit_price_cents")
            )
        if "region" in columns:
            rows = rows.join(self._supplier_place(), F.col("l_suppkey") == F.col("s_suppkey"), "left")
            rows = rows.withColumnRenamed("r_name", "region")
        return rows

    def _supplier_place(self) -> DataFrame:
        return (
            self.raw("supplier", "s_suppkey", "s_nationkey")
            .join(self.raw("nation", "n_nationkey", "n_name", "n_regionkey"),
                  F.col("s_nationkey") == F.col("n_nationkey"), "left")
            .join(self.raw("region", "r_regionkey", "r_name"),
                  F.col("n_regionkey") == F.col("r_regionkey"), "left")
            .select("s_suppkey", "n_name", "r_name")
        )

    def _purchase_orders(self, columns: set[str]) -> DataFrame:
        line = self.raw("lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_quantity",
                        "l_discount", "l_tax", "l_returnflag")
        quantity = F.col("l_quantity").cast("long")
        # Days late: five per point of tax, shifted by supplier.
        late_days = (5 * (_whole(F.col("l_tax") * 100) + F.col("l_suppkey") % 5 - 8)).cast("long")
        bad = (F.col("l_returnflag") == "R") & (
            _whole(F.col("l_discount") * 100) >= 11 - F.col("l_suppkey") % 5
        )
        lost = F.floor(quantity / F.lit(10.0)).cast("long") + 1
        rows = line.select(
            "l_orderkey",
            F.col("l_suppkey").alias("supplier_id"),
            F.col("l_partkey").alias("sku_id"),
            quantity.alias("order_quantity"),
            F.when(bad, quantity - lost).otherwise(quantity).alias("received_quantity"),
            (late_days <= 0).alias("on_time"),
            (~bad).alias("quality_accepted"),
            late_days.alias("late_days"),
        )
        lead = {"lead_time_expected", "lead_time_actual", "expected_delivery_date", "actual_delivery_date"}
        if columns & (lead | {"unit_cost_cents", "total_cost_cents"}):
            part = self.raw("part", "p_partkey", "p_size", "p_retailprice").select(
                "p_partkey",
                (45 + F.col("p_size")).cast("long").alias("lead_time_expected"),
                _cost_cents().alias("unit_cost_cents"),
            )
            rows = rows.join(part, rows["sku_id"] == part["p_partkey"], "left").withColumns({
                "lead_time_actual": F.col("lead_time_expected") + F.col("late_days"),
                "total_cost_cents": F.col("order_quantity") * F.col("unit_cost_cents"),
            })
        if columns & {"order_date", "expected_delivery_date", "actual_delivery_date"}:
            orders = self.raw("orders", "o_orderkey", "o_orderdate").select(
                "o_orderkey", F.col("o_orderdate").cast("date").alias("order_date")
            )
            rows = rows.join(orders, rows["l_orderkey"] == orders["o_orderkey"], "left")
            if columns & {"expected_delivery_date", "actual_delivery_date"}:
                rows = rows.withColumns({
                    "expected_delivery_date": F.date_add("order_date", F.col("lead_time_expected").cast("int")),
                    "actual_delivery_date": F.date_add("order_date", F.col("lead_time_actual").cast("int")),
                })
        return rows

    def _supplier_master(self, columns: set[str]) -> DataFrame:
        rows = self.raw("supplier", "s_suppkey", "s_name", "s_acctbal")
        if columns & {"supplier_type", "country"}:
            rows = rows.join(self._supplier_place(), "s_suppkey", "left")
        if columns & {"on_time_delivery_rate", "quality_rating"}:
            record = (
                self._purchase_orders({"supplier_id", "on_time", "quality_accepted"})
                .groupBy("supplier_id")
                .agg(F.count(F.lit(1)).alias("n"), F.count_if("on_time").alias("punctual"),
                     F.count_if("quality_accepted").alias("good"))
            )
            rows = rows.join(record, rows["s_suppkey"] == record["supplier_id"], "left")  # no deliveries: no rates
            rows = rows.withColumns({
                "on_time_delivery_rate":
                    F.round(F.col("punctual") * F.lit(1000.0) / F.col("n")).cast("long") / F.lit(1000.0),
                "quality_rating":
                    (200 + F.round(F.col("good") * F.lit(300.0) / F.col("n"))).cast("long") / F.lit(100.0),
            }).drop("supplier_id")
        renamed = {"s_name": "supplier_name", "r_name": "supplier_type", "n_name": "country"}
        return rows.withColumnsRenamed(renamed).withColumns({
            "supplier_id": F.col("s_suppkey"),
            "payment_terms_days": (30 + 15 * (F.col("s_suppkey") % 4)).cast("int"),
            "minimum_order_quantity": (100 + 98 * (F.col("s_suppkey") % 50)).cast("int"),
            "is_preferred": F.col("s_acctbal") > 0,
        })

    def _warehouse_master(self, _: set[str]) -> DataFrame:
        suppliers = self.raw("supplier", "s_nationkey").groupBy("s_nationkey").agg(
            F.count(F.lit(1)).alias("n_suppliers")
        )
        key = F.col("n_nationkey")
        rows = (
            self.raw("nation", "n_nationkey", "n_name", "n_regionkey")
            .join(suppliers, F.col("n_nationkey") == F.col("s_nationkey"), "left")
            .join(self.raw("region", "r_regionkey", "r_name"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
            .withColumn("capacity_units", F.coalesce("n_suppliers", F.lit(0)) * (80000 + 20000 * (key % 10)))
        )
        return rows.select(
            key.alias("warehouse_id"), F.col("n_name").alias("warehouse_name"), F.col("r_name").alias("city"),
            "capacity_units",
            (F.col("capacity_units") * (50 + 10 * (key % 8))).alias("monthly_operating_cost_cents"),
            ((40 + (key * 7) % 60) / F.lit(100.0)).alias("current_utilization_rate"),
        )

    def _current_inventory(self, columns: set[str]) -> DataFrame:
        line = self.raw("lineitem", "l_partkey", "l_suppkey", "l_quantity")
        key = F.col("l_partkey")
        rows = (
            line.join(self.raw("supplier", "s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"), "left")
            .groupBy("l_partkey", "s_nationkey")
            .agg((F.sum(F.col("l_quantity").cast("long")) * 10).alias("quantity_on_hand"))
            .select(
                key.alias("sku_id"), F.col("s_nationkey").alias("warehouse_id"), "quantity_on_hand",
                (500 + (key * 37) % 1500).alias("reorder_point"),
                (200 + (key * 53) % 800).alias("safety_stock"),
            )
        )
        if columns & {"unit_cost_cents", "total_value_cents"}:
            part = self.raw("part", "p_partkey", "p_size", "p_retailprice").select(
                "p_partkey", _cost_cents().alias("unit_cost_cents")
            )
            rows = rows.join(part, rows["sku_id"] == part["p_partkey"], "left").withColumn(
                "total_value_cents", F.col("quantity_on_hand") * F.col("unit_cost_cents")
            )
        return rows

    def _inventory_transactions(self, columns: set[str]) -> DataFrame:
        """Every line item as a receipt by its supplier's nation and as a shipment from there."""
        line = self.raw("lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate")
        place = self.raw("supplier", "s_suppkey", "s_nationkey")
        part = self.raw("part", "p_partkey", "p_size", "p_retailprice").select("p_partkey", _cost_cents().alias("unit_cost_cents"))
        rows = line.join(place, F.col("l_suppkey") == F.col("s_suppkey"), "left").join(part, F.col("l_partkey") == F.col("p_partkey"), "left")
        kinds = F.array(F.lit("RECEIPT"), F.lit("SHIPMENT"))
        rows = rows.withColumn("transaction_type", F.explode(kinds))
        number = F.concat_ws("-", F.substring("transaction_type", 1, 1), "l_orderkey", "l_linenumber")
        sign = F.when(F.col("transaction_type") == "RECEIPT", 1).otherwise(-1)
        quantity = F.col("l_quantity").cast("long")
        return rows.select(
            number.alias("transaction_id"), F.col("l_shipdate").cast("date").alias("transaction_date"), F.col("l_partkey").alias("sku_id"),
            F.col("s_nationkey").alias("warehouse_id"), "transaction_type", (sign * quantity).alias("quantity"), "unit_cost_cents",
            (quantity * F.col("unit_cost_cents")).alias("total_value_cents"),
        )

    def _bom(self, _: set[str]) -> DataFrame:
        key = F.col("p_partkey")
        return self.raw("part", "p_partkey").filter(key > 0).select(
            F.floor(key / F.lit(6.0)).cast("long").alias("parent_sku"),
            key.alias("component_sku"),
            (1 + key % 4).alias("quantity_per"),
        )


# Columns of each view, for whole-table uses such as the data-quality report.
ALL_COLUMNS: dict[str, tuple[str, ...]] = {
    "sku_master": ("sku_id", "product_name", "category", "unit_cost_cents", "unit_price_cents",
                   "lead_time_days", "carrying_cost_rate"),
    "warehouse_master": ("warehouse_id", "warehouse_name", "city", "capacity_units",
                         "monthly_operating_cost_cents", "current_utilization_rate"),
    "supplier_master": ("supplier_id", "supplier_name", "supplier_type", "country", "on_time_delivery_rate",
                        "quality_rating", "payment_terms_days", "minimum_order_quantity", "is_preferred"),
    "sales": ("date", "sku_id", "category", "quantity_ordered", "quantity_fulfilled", "backorder_quantity",
              "unit_price_cents", "revenue_cents", "region"),
    "current_inventory": ("sku_id", "warehouse_id", "quantity_on_hand", "reorder_point", "safety_stock",
                          "unit_cost_cents", "total_value_cents"),
    "purchase_orders": ("order_date", "expected_delivery_date", "actual_delivery_date", "sku_id", "supplier_id",
                        "order_quantity", "received_quantity", "unit_cost_cents", "total_cost_cents",
                        "lead_time_expected", "lead_time_actual", "on_time", "quality_accepted"),
    "inventory_transactions": ("transaction_id", "transaction_date", "sku_id", "warehouse_id", "transaction_type", "quantity",
                               "unit_cost_cents", "total_value_cents"),
    "bom": ("parent_sku", "component_sku", "quantity_per"),
}
