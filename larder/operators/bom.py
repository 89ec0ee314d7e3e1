"""Bill-of-materials explosion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.functions.columns import money
from larder.functions.pin import pinned
from larder.plans.operator import Tables, operator


@operator(bom="parent_sku component_sku quantity_per", sku_master="sku_id product_name unit_cost_cents")
def bom_explosion(t: Tables, *, depth: int = 5, ordered: bool = True) -> DataFrame:
    """Every path of up to ``depth`` edges below every parent, with quantities multiplied along it.

    Paths are kept, not merged, and the depth is the only guard against cycles. The depth is
    fixed, so the recursion is written as that many joins on the parent key. They carry ids and
    quantities alone; names and costs are attached once, to all levels together.
    """
    edges = t["bom"].select("parent_sku", "component_sku", "quantity_per")
    roots = t["sku_master"].select(F.col("sku_id").alias("root_product"), F.col("product_name").alias("root_product_name"))
    level = edges.select(F.col("parent_sku").alias("root_product"), "component_sku", F.col("quantity_per").cast("double").alias("total_quantity_needed"))
    paths = level.withColumn("level", F.lit(1))
    for number in range(2, depth + 1):
        above = level.select("root_product", F.col("component_sku").alias("parent_sku"), F.col("total_quantity_needed").alias("above"))
        level = above.join(edges, "parent_sku").select(
            "root_product", "component_sku", (F.col("above") * F.col("quantity_per")).alias("total_quantity_needed"))
        paths = paths.unionByName(level.withColumn("level", F.lit(number)))
    part = t["sku_master"].select(F.col("sku_id").alias("component_sku"), F.col("product_name").alias("component_name"), "unit_cost_cents")
    result = paths.join(roots, "root_product").join(part, "component_sku").select(
        "root_product", "root_product_name", "component_sku", "component_name", "level", "total_quantity_needed",
        F.round(F.col("total_quantity_needed") * money("unit_cost_cents"), 2).alias("component_cost_per_unit"),
    )
    return result.orderBy("root_product", "level", "component_sku") if ordered else result


def _walked(edges: DataFrame) -> DataFrame:
    """Every path without a repeated SKU but perhaps its last: ``path``, ``component_sku``, ``needed`` and ``closed``.

    Each round extends only the paths that the round before found new, and is written to the checkpoint
    folder; a path that meets itself is closed and goes no further, so the rounds end with the longest path.
    """
    edges = edges.select("parent_sku", "component_sku", F.col("quantity_per").cast("double").alias("quantity_per"))
    closed = F.array_contains("path", F.col("component_sku")).alias("closed")
    first = edges.select(F.array("parent_sku").alias("path"), "component_sku", F.col("quantity_per").alias("needed"))
    new = pinned(first.select("*", closed))
    found = new
    while not (open_ends := new.filter("not closed")).isEmpty():
        above = open_ends.select(F.concat("path", F.array("component_sku")).alias("path"), F.col("component_sku").alias("parent_sku"), "needed")
        longer = above.join(edges, "parent_sku").select("path", "component_sku", (F.col("needed") * F.col("quantity_per")).alias("needed"))
        new = pinned(longer.select("*", closed))
        found = found.unionByName(new)
    return found


@operator(bom="parent_sku component_sku quantity_per")
def bom_paths(t: Tables) -> DataFrame:
    """``root_product``, ``component_sku``, ``level`` and ``total_quantity_needed`` of every path, however deep.

    Edges with a null end, and edges that would close a cycle (see ``bom_cycles``), are on no path. An edge
    that stands several times is that many paths, as in ``bom_explosion``.
    """
    edges = t["bom"].filter("parent_sku is not null and component_sku is not null")
    return _walked(edges).filter("not closed").select(
        F.element_at("path", 1).alias("root_product"), "component_sku", F.size("path").alias("level"), F.col("needed").alias("total_quantity_needed"))


@operator(bom="parent_sku component_sku quantity_per")
def bom_cycles(t: Tables) -> DataFrame:
    """``cycle``, the SKUs of every cycle in order from the smallest one (``a > b``), and ``length``; each cycle once."""
    edges = t["bom"].filter("parent_sku is not null and component_sku is not null")
    once = edges.groupBy("parent_sku", "component_sku").agg(F.first("quantity_per").alias("quantity_per"))
    round_trips = _walked(once).filter("closed").filter("component_sku = path[0] and path[0] = array_min(path)")
    return round_trips.select(F.array_join("path", " > ").alias("cycle"), F.size("path").alias("length"))
