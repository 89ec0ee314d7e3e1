"""Data-quality report over whole tables."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from operator import add

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from larder.functions.pin import stored

HIGH_MISSING_PCT = 5
WORDS = 1 << 18  # of 64 bits each: the filter that rows pass before they are compared whole


def data_quality(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Rows, columns, missing values and repeated rows of every table.

    Missing values are sums of one pass. Repeated rows are found by a 128-bit digest, which is all that
    is shuffled of rows that are alone, and then counted exactly.
    """
    return reduce(DataFrame.unionByName, [_one(name, df) for name, df in tables.items()])


def repeated(marks: DataFrame) -> DataFrame:
    """A filter of fixed size from digests: the bits of up to ``WORDS`` words. It lets some others through and keeps none back."""
    bit = F.pmod("_d1", F.lit(64 * WORDS))
    return marks.groupBy(F.shiftright(bit, 6).alias("_word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(_d1, {64 * WORDS}L) & 63 as int))")).alias("_bits"))


def may_repeat(rows: DataFrame, marks: DataFrame) -> DataFrame:
    """The rows with ``_d1`` and ``_d2`` whose bit is set in the filter of these digests, found without a shuffle."""
    bit = F.pmod("_d1", F.lit(64 * WORDS))
    placed = rows.withColumns({"_word": F.shiftright(bit, 6), "_bit": bit.bitwiseAND(63).cast("int")})
    passed = placed.join(F.broadcast(repeated(marks)), "_word").filter(F.expr("shiftright(_bits, _bit) & 1L") == 1)
    return passed.drop("_word", "_bit", "_bits")


def _one(name: str, df: DataFrame) -> DataFrame:
    floating = {n for n, kind in df.dtypes if kind in ("double", "float")}
    missing = reduce(add, (
        (F.col(c).isNull() | F.isnan(c) if c in floating else F.col(c).isNull()).cast("long") for c in df.columns
    ))
    # Digests are dealt instead of rows; whole rows are compared only where a digest stands twice. Those digests are
    # written first, so that rows are never dealt before it is known which ones; rows and missing values are summed on the way.
    digest = [F.xxhash64(F.lit(seed), *df.columns) for seed in (1, 2)]
    sums = df.select(digest[0].alias("_d1"), digest[1].alias("_d2"), missing.alias("_missing")).groupBy("_d1", "_d2").agg(
        F.count(F.lit(1)).alias("_n"), F.sum("_missing").alias("_missing"))
    seen = Observation()
    sums = sums.observe(seen, F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"), F.coalesce(F.sum("_missing"), F.lit(0)).alias("missing"))
    marks = stored(sums.filter("_n > 1").select("_d1", "_d2"), "digests")
    counted = seen.get
    marked = df.withColumns({"_d1": digest[0], "_d2": digest[1]})
    twice = may_repeat(marked, marks).join(marks, ["_d1", "_d2"], "left_semi")
    copies = twice.groupBy(*df.columns).agg((F.count(F.lit(1)) - 1).alias("_more"))
    width = len(df.columns)
    sums = copies.agg(F.coalesce(F.sum("_more"), F.lit(0)).alias("duplicates")).withColumns(
        {"rows": F.lit(counted["rows"]).cast("long"), "missing_values": F.lit(counted["missing"]).cast("long")})
    pct = F.try_divide(F.col("missing_values") * F.lit(100.0), (F.col("rows") * width).cast("double"))
    return sums.select(
        F.lit(name).alias("dataset"), "rows", F.lit(width).alias("columns"), "missing_values",
        F.round(pct, 2).alias("missing_pct"), "duplicates",
        F.coalesce(pct > HIGH_MISSING_PCT, F.lit(False)).alias("high_missing"),
    )
