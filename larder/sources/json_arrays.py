"""Records of JSON arrays, each file read by as many tasks as it has splits.

Spark's reader takes a file with one array as a whole. Here the file is split as text at closing braces, which Spark can
do anywhere. Whether a brace ends a record depends on what stands before it: quotes and open braces. So a
first pass counts both for every split, running sums over the splits give each the state it starts in, and a
second pass cuts the records. What a split begins with or leaves open is put together afterwards.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

ESCAPED = re.compile(r"\\.", re.DOTALL)
BETWEEN = "[], \t\r\n\ufeff"  # what may stand between records


def measured(text: str) -> tuple[int, int, int]:
    """Quotes, and the change of depth if the text starts outside or inside a string. It has no closing braces."""
    parts = ESCAPED.sub("", text).split('"')
    return len(parts) - 1, sum(p.count("{") for p in parts[::2]), sum(p.count("{") for p in parts[1::2])


def _by_split(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], str, bool]]:
    """Split, text, and whether the split goes on, for every text up to a brace."""
    held = None
    for batch in batches:
        for text, file, block in zip(*(c.to_pylist() for c in batch.columns)):
            if held:
                yield *held, held[0] == (file, block)
            held = (file, block), text
    if held:
        yield *held, False


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each split and each of two starts: whether it ends inside a string, and the change of depth but for the
    last brace; and the bytes, a brace counted for every text."""
    inside, depth, size = [False, True], [0, 0], 0
    for split, text, more in _by_split(batches):
        quotes, *opened = measured(text)
        for s in (0, 1):
            depth[s] += opened[inside[s]]
            inside[s] ^= quotes % 2 == 1
            depth[s] -= not inside[s]
        size += len(text.encode()) + 1
        if not more:
            columns = [[split[0]], [split[1]], [inside[0]], [depth[0]], [depth[1]], [size]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["file", "block", "odd", "outside", "within", "size"])
            inside, depth, size = [False, True], [0, 0], 0


def _records(starts: dict[tuple[str, int], tuple[bool, int, bool]]):
    """Whole records, and the pieces at both ends of a split."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        fresh = True
        for split, text, more in _by_split(batches):
            if fresh:
                inside, depth, closed = starts[split]
                cut, held, at = inside or depth > 0, [], 0
            quotes, *opened = measured(text)
            brace = "}" if more or closed else ""
            if depth == 0 and not inside and not held:  # between records
                begin = text.find("{")
                other = text[: begin if begin >= 0 else None].strip(BETWEEN) + ("" if begin >= 0 else brace)
                if other:  # no record: the parser will say so
                    out.append((*split, at, "whole", other))
                    at += 1
                text = text[begin:] + brace if begin >= 0 else ""
            else:
                text += brace
            depth += opened[inside]
            inside ^= quotes % 2 == 1
            if brace and not inside:
                depth = max(depth - 1, 0)
            if text:
                held.append(text)
            if held and depth == 0 and not inside:
                out.append((*split, at, "last" if cut else "whole", "".join(held)))
                at, held, cut = at + 1, [], False
            fresh = not more
            if fresh and held:
                out.append((*split, at, "inner" if cut else "first", "".join(held)))
            if len(out) >= 2048:
                yield _batch(out)
                out = []
        yield _batch(out)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["file", "block", "at", "kind", "value"])


def array_records(spark: SparkSession, path: str) -> DataFrame:
    """``value``: the text of every record in the JSON arrays (or single objects) at ``path``.

    Text that is no record, or a record that does not end, is a row too, for the parser to refuse. What the driver
    holds is a row for each split of a file.
    """
    texts = spark.read.text(path, lineSep="}").select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    sizes = spark.read.text(path, lineSep="}").select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("bytes"))
    counts = texts.mapInArrow(_counts, "file string, block long, odd boolean, outside long, within long, size long")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    last = Window.partitionBy("file")
    found = counts.withColumn("inside", F.coalesce(F.sum(F.col("odd").cast("int")).over(before), F.lit(0)) % 2 == 1)
    found = found.withColumn("change", F.when(F.col("inside"), F.col("within")).otherwise(F.col("outside")))
    found = found.select("file", "block", "inside", F.coalesce(F.sum("change").over(before), F.lit(0)).alias("depth"),
                         F.sum("size").over(last).alias("size"), (F.col("block") == F.max("block").over(last)).alias("ends"))
    # A file whose last byte is a brace has as many braces as texts; else the last text has none.
    found = found.join(sizes.groupBy("file").agg(F.first("bytes").alias("bytes")), "file")
    starts = {(r.file, r.block): (r.inside, max(r.depth, 0), not r.ends or r.size == r.bytes) for r in found.collect()}

    rows = texts.mapInArrow(_records(starts), "file string, block long, at long, kind string, value string")
    whole = rows.filter("kind = 'whole'").select("value")
    order = Window.partitionBy("file").orderBy("block", "at")  # two pieces a split at most
    pieces = rows.filter("kind <> 'whole'").withColumn("record", F.sum((F.col("kind") == "first").cast("int")).over(order))
    parts = F.sort_array(F.collect_list(F.struct("block", "at", "value")))
    glued = pieces.groupBy("file", "record").agg(parts.alias("parts")).select(F.array_join(F.col("parts.value"), "").alias("value"))
    return whole.unionByName(glued)
