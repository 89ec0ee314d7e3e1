"""Arrow batches inside tasks: slices of bounded size, whole texts only."""

from __future__ import annotations

import ctypes
import gc
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

SLICE_BYTES = 4 << 20
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def tidy(run: Callable) -> Callable:
    """``run`` for mapInArrow, which gives freed memory back to the system when a task ends: Spark keeps workers
    alive between tasks, and what their allocators hold adds up over the workers of an executor."""

    def wrapped(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(parts)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            if sys.platform == "linux":
                trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only glibc has it
                trim and trim(0)

    return wrapped


def small_batches(df: DataFrame) -> DataFrame:
    """Lowers the session's limit for batches of Arrow rows to 4 MB: texts are long, and ten thousand of
    them at once would fill a small executor. A lower limit is left as it is."""
    conf = df.sparkSession.conf
    now = conf.get(BATCH_SETTING)
    if not now.rstrip("b").isdigit() or int(now.rstrip("b")) > SLICE_BYTES:
        conf.set(BATCH_SETTING, str(SLICE_BYTES))
    return df


def keyed(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``id``, ``text`` and ``row_key``, a digest of both. Only these columns go on, so columns of
    the input never clash with columns that an operator adds."""
    return small_batches(docs).select(F.col(id).alias("doc_id"), F.col(text).alias("text")).withColumn(
        "row_key", F.xxhash64(F.col("doc_id").cast("string"), F.lit("|"), "text"))


def slices(batch: pa.RecordBatch, text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``limit`` bytes of text each; one longer text is a part alone."""
    sizes = [len(x.as_buffer()) if x.is_valid else 0 for x in batch.column(batch.schema.get_field_index(text))]
    start = held = 0
    for at, size in enumerate(sizes):
        if held and held + size > limit:
            yield batch.slice(start, at - start)
            start, held = at, 0
        held += size
    if start < batch.num_rows:
        yield batch.slice(start)


def texts_of(batch: pa.RecordBatch, text: str = "text") -> list[bytes]:
    """UTF-8 of every text; null counts as empty."""
    column = batch.column(batch.schema.get_field_index(text))
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def mapped(df: DataFrame, work: Callable[[pa.RecordBatch], dict], schema: str, text: str = "text",
           limit: int = SLICE_BYTES) -> DataFrame:
    """``work`` on slices of the batches; it returns columns by name (lists or arrays)."""
    shape = to_arrow_schema(df.sparkSession.createDataFrame([], schema).schema)
    kinds = {f.name: f.type for f in shape}

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for part in slices(batch, text, limit):
                out = work(part)
                columns = [out[n].cast(k) if isinstance(out[n], pa.Array) else pa.array(out[n], k) for n, k in kinds.items()]
                yield pa.RecordBatch.from_arrays(columns, list(kinds))

    return df.mapInArrow(tidy(run), schema)


def runs_of_groups(parts: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Rows that arrive sorted by ``keys``, one table for each key, across batch limits."""
    held: list[pa.RecordBatch] = []

    def same(a: pa.RecordBatch, i: int, b: pa.RecordBatch, j: int) -> bool:
        return all(a.column(k)[i].as_py() == b.column(k)[j].as_py() for k in keys)

    for batch in parts:
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows, bool)
        for k in keys:
            column = batch.column(k).to_numpy(zero_copy_only=False)
            change[1:] |= column[1:] != column[:-1]
        change[0] = bool(held) and not same(held[-1], held[-1].num_rows - 1, batch, 0)
        start = 0
        for cut in np.flatnonzero(change).tolist():
            if cut > start:
                held.append(batch.slice(start, cut - start))
            if held:
                yield pa.Table.from_batches(held)
            held, start = [], cut
        held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held)
