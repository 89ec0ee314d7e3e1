"""Demand patterns: seasonality, volatility, products sold together, trend."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import date
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from larder.functions import labels
from larder.functions.columns import banded, money, monday_week, ratio, stddev_pop_exact, sunday_weekday
from larder.functions.kernels import match_group
from larder.functions.pin import stored
from larder.operators.inventory import months_back
from larder.plans.operator import Tables, operator
from larder.sources.summary import instead, measures, merged, since


BLOCK_DAYS = 2_000_000  # selling days of a block of SKUs that are matched at once
COPIES = 3  # blocks up to which each SKU is dealt to all of them; more blocks are read, not dealt
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def trailing_mean(name: str, rows: int, *partition: str, by: str) -> Column:
    """Mean of this row and up to ``rows - 1`` before it."""
    frame = Window.partitionBy(*partition).orderBy(by).rowsBetween(1 - rows, 0)
    return ratio(F.sum(name).over(frame), F.count(name).over(frame))


# Windows below run over one row per calendar day, a few thousand whatever the input size.


@operator(sales="date quantity_fulfilled revenue_cents")
def seasonal_decomposition(t: Tables, *, short: int = 7, long: int = 30, ordered: bool = True) -> DataFrame:
    """Daily totals with month-of-year mean, seasonal index and two moving averages."""
    daily = t["sales"].groupBy("date").agg(
        F.sum("quantity_fulfilled").alias("total_units_sold"), F.sum("revenue_cents").alias("revenue")
    ).withColumn("month", F.date_format("date", "MM"))
    of_month = Window.partitionBy("month")
    daily = daily.withColumn(
        "avg_monthly_units", ratio(F.sum("total_units_sold").over(of_month), F.count("total_units_sold").over(of_month))
    )
    result = daily.select(
        F.col("date").alias("sale_date"),
        F.date_format("date", "yyyy").alias("year"),
        "month",
        F.lpad(monday_week("date").cast("string"), 2, "0").alias("week"),
        sunday_weekday("date").alias("day_of_week"),
        "total_units_sold",
        money("revenue").alias("total_revenue"),
        "avg_monthly_units",
        F.round(ratio("total_units_sold", "avg_monthly_units"), 2).alias("seasonal_index"),
        trailing_mean("total_units_sold", short, by="date").alias("moving_avg_7day"),
        trailing_mean("total_units_sold", long, by="date").alias("moving_avg_30day"),
    )
    return result.orderBy("sale_date") if ordered else result


@operator(
    instead=instead("date sku_id sales_rows fulfilled_rows quantity_fulfilled fulfilled_squares fulfilled_min fulfilled_max"),
    sales="date sku_id quantity_fulfilled",
    sku_master="sku_id product_name category",
)
def demand_volatility(t: Tables, *, as_of: date, lookback_months: int = 12, ordered: bool = True) -> DataFrame:
    """Mean, spread and coefficient of variation of the sold quantity per SKU."""
    recent = measures(since(t["sales"], months_back(as_of, lookback_months)))
    stats = (
        recent.groupBy("sku_id")
        .agg(*merged("fulfilled_rows", "quantity_fulfilled", "fulfilled_squares", "fulfilled_min", "fulfilled_max", "sales_rows"))
        .withColumnsRenamed({"fulfilled_rows": "n", "quantity_fulfilled": "total", "fulfilled_squares": "squares",
                             "fulfilled_min": "min_demand", "fulfilled_max": "max_demand", "sales_rows": "num_transactions"})
        .withColumns({"mean": ratio("total", "n"), "sd": stddev_pop_exact("n", "total", "squares")})
        .withColumn("cv", F.try_divide(F.col("sd"), F.col("mean")) * 100)
    )
    result = stats.join(t["sku_master"], "sku_id").select(
        "sku_id", "product_name", "category",
        F.round("mean", 2).alias("avg_daily_demand"),
        F.round("sd", 2).alias("stddev_demand"),
        F.round("cv", 2).alias("coefficient_of_variation"),
        "min_demand", "max_demand", "num_transactions",
        banded(F.col("cv"), labels.VOLATILITY_BANDS, labels.VOLATILITY_REST).alias("volatility_category"),
    )
    return result.orderBy(F.desc_nulls_last("coefficient_of_variation")) if ordered else result


def dealt(listed: DataFrame, blocks: int) -> DataFrame:
    """Every row once for each block that its own meets: a group holds two blocks, or one that meets itself."""
    own = F.pmod(F.xxhash64("sku_id"), F.lit(blocks)).cast("int")
    met = listed.withColumn("block", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return met.withColumns({"left": F.least("block", "other"), "right": F.greatest("block", "other")}).drop("other")


def whole_blocks(listed: DataFrame, blocks: int) -> DataFrame:
    """Every block as one row, with every block from its own on, ``left`` and ``right``. Nothing but the blocks themselves is shuffled: a task reads the
    two that it matches, and copies of them go nowhere."""
    own = F.pmod(F.xxhash64("sku_id"), F.lit(blocks)).cast("int")
    packed = listed.groupBy(own.alias("block")).agg(F.collect_list(F.struct("sku_id", "days", "quantities")).alias("skus"))
    packed = stored(packed, "sku_blocks")
    sides = [packed.repartition(blocks, "block").select(F.col("block").alias(side), F.col("skus").alias(f"{side}_skus")) for side in ("left", "right")]
    return sides[0].join(sides[1].hint("shuffle_replicate_nl"), F.col("left") <= F.col("right"))


def matched_blocks(met: DataFrame, schema: T.StructType, min_days: int, top: int | None) -> DataFrame:
    """Pairs of SKUs of each two blocks, as ``match_group`` finds them, written: large blocks go to a worker two at a time, by a limit that
    the session has only as long as this takes."""
    match, kinds = match_group(min_days, top), to_arrow_schema(schema)

    def rows(batch: pa.RecordBatch, side: str, at: int) -> pd.DataFrame:
        skus = batch.column(f"{side}_skus")[at].values
        found = {"sku_id": skus.field("sku_id").to_pandas()}
        for name in ("days", "quantities"):
            lists = skus.field(name)
            found[name] = np.split(lists.flatten().to_numpy(), np.cumsum(lists.value_lengths().to_numpy())[:-1])
        return pd.DataFrame(found).assign(block=batch.column(side)[at].as_py())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                left, right = (batch.column(side)[at].as_py() for side in ("left", "right"))
                both = [rows(batch, side, at) for side in ("left", "right")[:1 + (left != right)]]
                found = match((left, right), pd.concat(both, ignore_index=True))
                if len(found):
                    yield pa.RecordBatch.from_pandas(found, schema=kinds, preserve_index=False)

    conf = met.sparkSession.conf
    before = conf.get(BATCH_BYTES)
    try:
        conf.set(BATCH_BYTES, str(4 << 20))
        return stored(_best(met.mapInArrow(run, schema), top), "sku_pairs")
    finally:
        conf.set(BATCH_BYTES, before)


def _best(pairs: DataFrame, top: int | None) -> DataFrame:
    return pairs if top is None else pairs.orderBy(F.desc("days_sold_together"), "sku_a", "sku_b").limit(top)


@operator(sales="date sku_id quantity_fulfilled", sku_master="sku_id product_name")
def sku_cooccurrence(t: Tables, *, min_days: int = 30, top: int | None = 50,
                     block_rows: int = 65_536) -> DataFrame:
    """Pairs of SKUs sold on more than ``min_days`` common days, most common first.

    Each SKU with more than ``min_days`` selling days becomes the list of them (bounded by the calendar), once. SKUs are
    dealt to blocks of about ``block_rows``, and of no more than about ``BLOCK_DAYS`` selling days, and every block meets every
    other one and itself. Up to ``COPIES`` blocks a SKU is shuffled once a block; beyond, each block is shuffled as a whole, and a task
    reads the two that it matches, so the disk follows the sales and not the number of blocks. Two blocks are matched row by row, so a task
    holds their lists and the counts of one row; of its pairs only the ``top`` best go on.
    """
    daily = t["sales"].filter("date is not null").groupBy("sku_id", "date").agg(F.sum("quantity_fulfilled").alias("qty"))
    daily = daily.join(t["sku_master"].select("sku_id"), "sku_id", "left_semi")
    days = F.sort_array(F.collect_list(F.struct(F.unix_date("date").alias("day"), F.coalesce("qty", F.lit(0)).alias("qty"))))
    listed = daily.groupBy("sku_id").agg(days.alias("sold")).filter(F.size("sold") > min_days)
    listed = stored(listed.select("sku_id", F.col("sold.day").alias("days"), F.col("sold.qty").alias("quantities")), "selling_days")
    skus, entries = listed.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("days")), F.lit(0))).first()
    blocks = max(1, ceil(skus / block_rows), ceil(entries / BLOCK_DAYS))
    id_type, whole = t["sales"].schema["sku_id"].dataType, T.LongType()
    schema = T.StructType([T.StructField("sku_a", id_type), T.StructField("sku_b", id_type),
                           *(T.StructField(c, whole) for c in ("days_sold_together", "qty_a", "qty_b"))])
    if blocks <= COPIES:
        sums = dealt(listed, blocks).groupBy("left", "right").applyInPandas(match_group(min_days, top), schema)
    else:
        sums = matched_blocks(whole_blocks(listed, blocks), schema, min_days, top)
    sums = _best(sums, top)

    selling_days = t["sales"].agg(F.count_distinct("date")).scalar()
    names = [t["sku_master"].select(F.col("sku_id").alias(f"sku_{s}"), F.col("product_name").alias(f"product_{s}"))
             for s in "ab"]
    result = sums.join(names[0], "sku_a").join(names[1], "sku_b").select(
        "sku_a", "product_a", "sku_b", "product_b", "days_sold_together",
        F.round(ratio("qty_a", "days_sold_together"), 1).alias("avg_qty_a"),
        F.round(ratio("qty_b", "days_sold_together"), 1).alias("avg_qty_b"),
        F.round(F.try_divide(F.col("days_sold_together") * F.lit(100.0), selling_days.cast("double")), 2)
        .alias("pct_days_together"),
    )
    return result.orderBy(F.desc("days_sold_together"), "sku_a", "sku_b")


@operator(sales="date quantity_fulfilled")
def demand_trend(t: Tables, *, short: int = 7, long: int = 30, lag_rows: int = 7, last: int = 90) -> DataFrame:
    """Daily demand with moving averages and change against seven rows before, latest days first."""
    daily = t["sales"].groupBy("date").agg(F.sum("quantity_fulfilled").alias("total_demand"))
    earlier = F.lag("total_demand", lag_rows).over(Window.orderBy("date"))
    rows = daily.withColumn("earlier", earlier).select(
        F.col("date").alias("demand_date"), "total_demand",
        trailing_mean("total_demand", short, by="date").alias("ma_7day"),
        trailing_mean("total_demand", long, by="date").alias("ma_30day"),
        (F.col("total_demand") - F.col("earlier")).alias("week_over_week_change"),
        F.round(F.try_divide((F.col("total_demand") - F.col("earlier")) * F.lit(100.0),
                             F.col("earlier").cast("double")), 2).alias("week_over_week_pct_change"),
    )
    return rows.orderBy(F.desc("demand_date")).limit(last)
