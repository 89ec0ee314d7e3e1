"""Exact dedup by progressive refinement: length, then a hash of the beginning, then a digest of the whole text."""

from __future__ import annotations

import hashlib

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions.pin import pinned, stored
from larder.llm.anchors import filter_of, narrowed, tested
from larder.llm.batches import keyed, mapped, texts_of

BLANKS = " \t\n\x0b\x0c\r"
HEAD = 64  # code points of a text that the second step looks at
PARTS = 10_000  # a group is hot if it holds more than this part of all rows, so at most so many are hot


def _shape(text: str, blanks: str, head: int) -> tuple[Column, Column]:
    """Length without ``blanks``, and a hash of the beginning."""
    bare = F.translate(F.coalesce(F.col(text), F.lit("")), blanks, "")
    return F.octet_length(bare).alias("size"), F.xxhash64(F.substring(bare, 1, head)).alias("head")


def shared_beginnings(docs: DataFrame, text: str = "text", blanks: str = BLANKS, head: int = HEAD) -> DataFrame:
    """``size``, ``head`` and ``n`` of lengths that several rows share, and of those the beginnings that several rows
    share: the first two steps.

    Lengths and beginnings are counted in the task before they are dealt, so a hot one is a row a task. Length and
    beginning are taken after ``blanks`` are deleted. Null texts count as empty.
    """
    rows = stored(docs.select(*_shape(text, blanks, head)).groupBy("size", "head").agg(F.count(F.lit(1)).alias("n")), "heads")
    shared = rows.groupBy("size").agg(F.sum("n").alias("all")).filter("all > 1").select("size")
    return rows.join(shared, "size", "left_semi").filter("n > 1")


def digests(docs: DataFrame, id: str = "doc_id", text: str = "text", blanks: str = BLANKS, every: bool = False) -> DataFrame:
    """``doc_id``, ``row_key``, ``chars`` (code points of the text as it is), ``suspect`` and ``digest`` (SHA-256
    without ``blanks``): the third step, which reads whole texts of suspects alone, or of ``every`` row.

    Suspects are known by a filter of fixed size over lengths and beginnings. It may let others through,
    whose digests then stand alone; it never keeps a suspect back.
    """
    mark = F.xxhash64("size", "head")
    bits = filter_of(shared_beginnings(docs, text, blanks).select(mark.alias("mark")), "mark")
    drop = blanks.encode()

    def work(batch: pa.RecordBatch) -> dict:
        again = tested(bits.value, batch.column("mark").to_numpy()).tolist()
        whole = [hashlib.sha256(t.translate(None, drop)).digest() if s or every else None for t, s in zip(texts_of(batch), again)]
        chars = pc.fill_null(pc.utf8_length(batch.column("text")), 0)
        return {"doc_id": batch.column("doc_id"), "row_key": batch.column("row_key"), "chars": chars, "suspect": again, "digest": whole}

    kind = docs.schema[id].dataType.simpleString()
    rows = keyed(docs, id, text).select("*", *_shape("text", blanks, HEAD)).select("doc_id", "text", "row_key", mark.alias("mark"))
    return stored(mapped(rows, work, f"doc_id {kind}, row_key long, chars long, suspect boolean, digest binary"), "digests")


def groups(docs: DataFrame, id: str = "doc_id", text: str = "text", blanks: str = BLANKS, every: bool = False) -> DataFrame:
    """``doc_id``, ``row_key``, ``keep_id``, ``group_size``, ``kept`` and ``digest`` for every row of ``docs``.

    Texts are equal when nothing but ``blanks`` tells them apart. The longest original stays, then the
    smallest id (null ids last). Null texts count as empty, so they form one group with empty and
    blank ones. Of rows with one id, one length and equal texts, one is kept. Columns of other
    names are not read. ``digest`` is null where the first two steps settled a row, unless ``every``.
    An empty table gives no rows.
    """
    rows = digests(docs, id, text, blanks, every)
    alone = rows.filter("not suspect").select(
        "doc_id", "row_key", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "digest")
    # Repeated rows are one row with a count from here on.
    same = pinned(rows.filter("suspect").groupBy("digest", "doc_id", "chars").agg(F.count(F.lit(1)).alias("n"), F.min("row_key").alias("row_key")))
    order = F.struct(-F.col("chars"), F.col("doc_id").isNull().alias("none"), "doc_id")
    found = pinned(same.groupBy("digest").agg(F.sum("n").alias("group_size"), F.min(order).alias("first")))
    joined = _joined(same, found, rows)
    each = joined.select("*", F.posexplode(F.sequence(F.lit(1).cast("long"), "n")).alias("nth", "_"))
    stays = order.eqNullSafe(F.col("first")) & (F.col("nth") == 0)
    return alone.unionByName(each.select("doc_id", "row_key", F.col("first.doc_id").alias("keep_id"), "group_size", stays.alias("kept"), "digest"))


def _joined(same: DataFrame, found: DataFrame, rows: DataFrame) -> DataFrame:
    """Members with their groups. Hot groups, ``PARTS`` at most by their definition, are broadcast, so that no
    task gets all members of one."""
    limit = max(rows.count() // PARTS, 1000)
    hot, rest = found.filter(F.col("group_size") > limit), found.filter(F.col("group_size") <= limit)
    by_hot = same.join(F.broadcast(hot), "digest")
    others = same.join(F.broadcast(hot.select("digest")), "digest", "left_anti").join(rest, "digest")
    return by_hot.unionByName(others)


def keep_one(docs: DataFrame, id: str = "doc_id", text: str = "text", blanks: str = BLANKS) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; texts are never shuffled but those of rows
    that may go. Of rows alike in id and text the first stays, whatever their other columns hold."""
    found = groups(docs, id, text, blanks)
    doubtful = stored(found.filter("group_size > 1").select("doc_id", "row_key", "kept"), "doubtful")
    wrapped = docs.select(F.struct("*").alias("__row"), F.col(id).alias("__id"),
                          F.xxhash64(F.col(id).cast("string"), F.lit("|"), text).alias("row_key"))
    stay = doubtful.filter("kept").select(F.struct("doc_id", "row_key").alias("__mark"))
    known = doubtful.select(F.struct("doc_id", "row_key").alias("__mark")).distinct()
    rest = narrowed(wrapped, doubtful)
    sure = narrowed(wrapped, doubtful, inside=False).unionByName(rest.join(known, _marked(), "left_anti"))
    chosen = rest.join(stay, _marked(), "left_semi").dropDuplicates(["__id", "row_key"])
    return sure.select("__row.*").unionByName(chosen.select("__row.*"))


def _marked() -> Column:
    return F.col("__id").eqNullSafe(F.col("__mark.doc_id")) & (F.col("row_key") == F.col("__mark.row_key"))
