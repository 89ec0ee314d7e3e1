"""Running totals over a whole table without moving the table to one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larder.functions.pin import stored


def running_total_desc(df: DataFrame, value: str, out: str, total: str) -> DataFrame:
    """Adds the running total ``out`` and the grand total ``total``.

    Running sum of a non-negative ``long`` column in descending order, ties sharing one total. NULLs
    come last and add nothing, so their running total is the grand total. A negative value is an error.

    Equal to ``sum(value) OVER (ORDER BY value DESC)`` with its default RANGE frame, which Spark
    would sort in a single task. Instead the rows are dealt once by ranges of the value, and written. A row's total is the
    sum of all ranges before its own, and that of its own range up to its value. A value that holds many
    rows is spread over several ranges by a digest of the row; its rows in later ranges, found by the least
    value of a range being the largest of a later one, are added too. What is summed up by range has as
    many rows as there are partitions.
    """
    checked = F.when(F.col(value) < 0, F.raise_error(F.lit(f"{value} is negative")).cast("long")).otherwise(F.col(value))
    spread = df.withColumn(value, checked).repartitionByRange(F.desc_nulls_last(value), F.xxhash64(*df.columns))
    spread = spread.sortWithinPartitions(F.desc_nulls_last(value))  # rows alike stand together: a third of the bytes in later shuffles
    rows = stored(spread.withColumn("_part", F.spark_partition_id()), "ranges")

    by_value = rows.groupBy("_part", F.col(value).alias("_v")).agg(F.sum(value).alias("_s"))
    ranges = by_value.groupBy("_part").agg(
        F.sum("_s").alias("_sum"), F.max(F.struct("_v", "_s")).alias("_most"), F.min(F.struct("_v", "_s")).alias("_least"))
    later = ranges.select(F.col("_part").alias("_behind"), F.col("_most._v").alias("_v"), F.col("_most._s").alias("_more"))
    cut = ranges.select("_part", "_least._v").join(later, "_v").filter("_behind > _part").groupBy("_part").agg(F.sum("_more").alias("_more"))
    before = F.sum("_sum").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    limits = ranges.select("_part", F.coalesce(before, F.lit(0).cast("long")).alias("_before"), F.sum("_sum").over(Window.partitionBy()).alias(total),
                           F.col("_least._v").alias("_last")).join(cut, "_part", "left")

    within = F.sum(value).over(Window.partitionBy("_part").orderBy(F.desc_nulls_last(value)))
    joined = rows.withColumn("_within", within).join(F.broadcast(limits), "_part")
    shared = F.when(F.col(value) == F.col("_last"), F.coalesce("_more", F.lit(0).cast("long"))).otherwise(0)
    return joined.withColumn(out, F.col("_before") + F.coalesce("_within", F.lit(0).cast("long")) + shared).select(*df.columns, out, total)
