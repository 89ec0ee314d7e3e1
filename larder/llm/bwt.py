"""Suffix-array dedup: repeated byte strings from merged Burrows-Wheeler transforms of shards.

Only chunks that share an anchor with an unlike chunk need this (see ``anchors``). Their texts are
dealt by anchor, and a task takes some at a time: it sorts the suffixes of each shard of them, then
merges the shards' transforms by refining their interleaving, one symbol more in each round. Suffixes
that stay together for ``span`` bytes are a repeated interval; their sort is never redone.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.functions.pin import stored
from larder.llm import anchors
from larder.llm.anchors import KEYS, merged  # by name: modules do not travel to tasks by value
from larder.llm.batches import runs_of_groups, texts_of, tidy

SPAN, GRAM = 200, 32  # bytes of a repeated string, bytes of a hashed k-gram
STRIDE = 8  # bytes in a symbol of the transform, at most
SHARD, BATCH = 1 << 16, 1 << 18  # bytes sorted on their own, bytes merged in one go: a few shards, whose arrays stay in a core's cache
RANGES = 8  # of places of the anchor in a string, for the test before the merge
FULLER = 16_384  # unlike chunks of one anchor that a task takes; a hotter anchor is split by place


class Rotations:
    """Texts as cyclic strings with an end mark, in symbols of ``stride`` bytes."""

    def __init__(self, texts: list[bytes], stride: int):
        kinds, data = np.unique(np.frombuffer(b"\0".join(texts) + b"\0", "u1"), return_inverse=True)
        kinds = len(kinds) + 1
        ends = np.cumsum([len(t) + 1 for t in texts])
        starts = np.r_[0, ends[:-1]]
        data = data.astype("u4") + np.uint32(1)
        data[ends - 1] = 0
        self.ends, self.starts = ends, starts
        self.step = np.arange(1, len(data) + 1, dtype="i4")  # the place after each, around its text
        self.step[ends - 1] = starts
        packed, at, most = data.astype("u8"), self.step, kinds
        for _ in range(stride - 1):
            if most * kinds > 2**64:  # ranks do as well, and take fewer bits
                _, packed = np.unique(packed, return_inverse=True)
                packed, most = packed.astype("u8"), len(packed)
            packed, most = packed * np.uint64(kinds) + data[at], most * kinds
            at = self.step[at]
        _, symbol = np.unique(packed, return_inverse=True)
        self.symbol = symbol.astype("u2" if symbol.max(initial=0) < 2**16 else "u4")
        self.ahead = at  # the place one symbol on
        self.back = np.empty_like(at)
        self.back[at] = np.arange(len(at), dtype="i4")


def by_rank(rank: np.ndarray) -> np.ndarray:
    """A stable order of ranks below 2**32, by radix: two bytes, or twice two."""
    if rank.dtype == "u2":
        return np.argsort(rank, kind="stable")
    low = np.argsort(rank.astype("u2"), kind="stable")  # the lower two bytes
    return low[np.argsort((rank >> np.uint32(16)).astype("u2")[low], kind="stable")]


def shard_order(text: Rotations, places: np.ndarray, stride: int, span: int) -> np.ndarray:
    """Rotations of one shard by their first ``span`` bytes at least, by doubling."""
    low, size = int(places[0]), len(places)
    rank, after, reach = text.symbol[places], text.ahead[places] - low, stride
    order = by_rank(rank)
    back = np.empty(size, "i4")
    while reach < span:
        # What is ``reach`` bytes ahead is in order already, so one sort by the first bytes is left.
        back[after] = np.arange(size, dtype="i4")
        second = back[order]
        order = second[by_rank(rank[second])]
        first, then = rank[order], rank[after[order]]
        number = np.cumsum(np.r_[False, (first[1:] != first[:-1]) | (then[1:] != then[:-1])])
        rank = np.empty(size, "u2" if size <= 2**16 else "u4")
        rank[order] = number
        after, reach = after[after], reach * 2
        if number[-1] == size - 1:
            break
    return places[order]


def repeated(texts: list[bytes], span: int = SPAN, stride: int = STRIDE, shard: int = SHARD) -> list[np.ndarray]:
    """For each text, whether the ``span`` bytes from a start on also start elsewhere in the texts.

    Starts are those with ``span`` bytes left. The shards' orders, one after the other, are the first
    interleaving; each round sorts it stably by the symbol before each suffix, the transform of the
    merged shards, which gives the interleaving for one symbol more. Within a shard the order never
    changes. ``block`` numbers the suffixes that are equal so far; those alone in their block are
    settled, and so are all that come from them, so they leave.
    """
    if not texts:
        return []
    stride = next(s for s in range(min(stride, span), 0, -1) if span % s == 0)  # whole symbols only
    text = Rotations(texts, stride)
    sizes, cuts, held = text.ends - text.starts, [0], 0
    for i, size in enumerate(sizes.tolist()):
        if held and held + size > shard:
            cuts.append(i)
            held = 0
        held += size
    bounds = [int(text.starts[c]) for c in cuts] + [int(text.ends[-1])]
    order = np.concatenate([shard_order(text, np.arange(a, b, dtype="i4"), stride, span) for a, b in zip(bounds, bounds[1:])])
    block = np.zeros(len(order), "i4")
    for _ in range(span // stride):
        before = text.back[order]
        symbol = text.symbol[before]  # the merged transform
        sort = by_rank(symbol)
        order, symbol, old = before[sort], symbol[sort], block[sort]
        fresh = np.r_[True, (symbol[1:] != symbol[:-1]) | (old[1:] != old[:-1])]
        alone = fresh & np.r_[fresh[1:], True]
        block = np.cumsum(fresh, dtype="i4")
        stay = np.flatnonzero(~alone)
        order, block = order[stay], block[stay]
        if not len(order):
            break
    # Only starts with a whole span count; the others run over an end mark.
    left = np.repeat(text.ends, sizes) - 1 - np.arange(int(text.ends[-1]))
    whole = left[order] >= span
    order, block = order[whole], block[whole]
    many = np.bincount(block, minlength=1)[block] > 1 if len(block) else np.zeros(0, bool)
    mark = np.zeros(int(text.ends[-1]), bool)
    mark[order[many]] = True
    return [mark[a : max(a, b - span)] for a, b in zip(text.starts.tolist(), text.ends.tolist())]


def possible(chunks: list[tuple], span: int, gram: int) -> list[tuple]:
    """Those of one anchor's chunks (..., shift, bytes) that may share a string with another of them, as
    (..., offset, bytes): the part with all such strings, and where it starts in the chunk.

    A string with the anchor ``d`` bytes after its start holds the ``d`` bytes before the anchor and the
    ``span`` - ``d`` from it on. For a range of ``d`` the bytes that all its strings hold have to be
    equal in two chunks. That drops most chunks that differ in their middle, and none that match; and
    equal strings have their anchor at one place, so strings of the other ranges match none.
    """
    width, most = -(-(span - gram + 1) // RANGES), span - gram
    parts, count = [], Counter()
    for *_, shift, chunk in chunks:
        low, high = max(shift - len(chunk) + span, 0), min(shift, most)
        own = [(d, chunk[shift - d * width : shift + span - min((d + 1) * width - 1, most)]) for d in range(low // width, high // width + 1)]
        parts.append((low, high, own))
        count.update(own)
    out = []
    for (*key, shift, chunk), (low, high, own) in zip(chunks, parts):
        if fits := [d for d, x in own if count[d, x] > 1]:
            a, b = shift - min((fits[-1] + 1) * width - 1, high), shift - max(fits[0] * width, low) + span
            out.append((*key, a, chunk[a:b]))
    return out


def _ranges(marks: np.ndarray, offset: int) -> list[dict]:
    turn = np.flatnonzero(np.diff(np.r_[False, marks, False].astype("i1"))) + offset
    return [{"a": int(a), "b": int(b)} for a, b in zip(turn[::2], turn[1::2])]


def merge_chunks(chunks: DataFrame, span: int = SPAN, gram: int = GRAM, stride: int = STRIDE) -> DataFrame:
    """``d1``, ``d2`` and ``found``, the repeated starts (from a to before b) of chunks that occur once.

    ``chunks`` are ``anchors.chunk_texts``. Chunks of one anchor always are merged together.
    """
    kind = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))

    def flush(rows: list[tuple]) -> pa.RecordBatch:
        marks = repeated([r[-1] for r in rows], span, stride)
        out = [(r[0], r[1], found) for r, m in zip(rows, marks) if r[2] == 1 and (found := _ranges(m, r[3]))]
        return pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], kind)], ["d1", "d2", "found"])

    def run(batches):
        held, size = [], 0
        for group in runs_of_groups(batches, ["anchor"]):
            some = possible(list(zip(*(group.column(n).to_pylist() for n in ("d1", "d2", "n", "shift", "chunk")))), span, gram)
            held += some
            size += sum(len(x[-1]) for x in some)
            if size > BATCH:
                yield flush(held)
                held, size = [], 0
        if held:
            yield flush(held)

    return chunks.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(tidy(run), "d1 long, d2 long, found array<struct<a:bigint,b:bigint>>")


def split_chunks(chunks: DataFrame, span: int = SPAN) -> DataFrame:
    """As ``merge_chunks``, for anchors with more chunks than a task should take: a row for each start
    with the digest of its string, counted by digest, however many share it."""
    def run(batches):
        for batch in batches:
            for d1, d2, chunk in zip(*(batch.column(n).to_pylist() for n in ("d1", "d2", "chunk"))):
                n = len(chunk) - span + 1
                digest = np.frombuffer(b"".join(xxhash.xxh3_128_digest(chunk[i : i + span]) for i in range(n)), ">i8").reshape(-1, 2).astype("i8")
                yield pa.RecordBatch.from_arrays([pa.array([d1] * n), pa.array([d2] * n), pa.array(range(n), pa.int64()), pa.array(digest[:, 0]), pa.array(np.ascontiguousarray(digest[:, 1]))], ["d1", "d2", "at", "w1", "w2"])

    starts = chunks.mapInArrow(tidy(run), "d1 long, d2 long, at long, w1 long, w2 long")
    many = starts.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("times")).filter("times > 1")
    hit = starts.join(many, ["w1", "w2"]).select("d1", "d2", F.struct(F.col("at").alias("a"), (F.col("at") + 1).alias("b")).alias("s"))
    return hit.groupBy("d1", "d2").agg(F.collect_list("s").alias("found"))


def repeated_spans(rows: DataFrame, span: int = SPAN, gram: int = GRAM, fuller: int = FULLER) -> DataFrame:
    """``doc_id``, ``row_key``, ``first`` and ``stop`` of bytes that a repeated string covers.

    ``rows`` are ``anchors.rows_of``.
    """
    known = anchors.distinct_chunks(rows, False, span, gram)
    found = anchors.occurrences(rows, known, False, span, gram)
    twice = found.filter("n > 1").select("doc_id", "row_key", F.col("lo").alias("first"), (F.col("hi") + span).alias("stop"))
    texts = stored(anchors.chunk_texts(rows, found.filter("kinds > 1 and single > 0"), False, span).join(
        known.select(*KEYS, "kinds"), KEYS), "chunk_texts")
    parts = merge_chunks(texts.filter(F.col("kinds") <= fuller), span, gram)
    if not texts.filter(F.col("kinds") > fuller).isEmpty():
        parts = parts.unionByName(split_chunks(texts.filter(F.col("kinds") > fuller), span))
    inner = found.filter("n = 1").join(parts, ["d1", "d2"]).select("doc_id", "row_key", "lo", F.explode("found").alias("f")).select(
        "doc_id", "row_key", (F.col("lo") + F.col("f.a")).alias("first"), (F.col("lo") + F.col("f.b") - 1 + span).alias("stop"))
    return twice.unionByName(inner)


def deduplicated(docs: DataFrame, id: str = "doc_id", text: str = "text", span: int = SPAN, gram: int = GRAM, texts: bool = True) -> DataFrame:
    """``doc_id``, ``row_key``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256`` and, with
    ``texts``, ``kept`` (the bytes left) of every row.

    Each byte goes that is covered by a ``span``-byte string which also starts anywhere else in the
    table, overlaps and the same document included. Null texts count as empty. Rows repeated in full
    are repeats of each other. Null ids take part; an empty table gives no rows.
    """
    rows = anchors.rows_of(docs, id, text)

    def work(batch: pa.RecordBatch) -> dict:
        out = {k: [] for k in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")}
        for data, spans in zip(texts_of(batch), batch.column("spans").to_pylist()):
            gone = merged(spans)
            parts, at = [], 0
            for a, b in gone:
                parts.append(data[at:a])
                at = b
            kept = b"".join(parts) + data[at:]
            for k, v in zip(out, (len(data), sum(b - a for a, b in gone), len(gone), hashlib.sha256(kept).hexdigest(), kept)):
                out[k].append(v)
        return {"doc_id": batch.column("doc_id"), "row_key": batch.column("row_key"), **out}

    id_type = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, row_key long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return anchors.by_document(rows, repeated_spans(rows, span, gram), work, schema + (", kept binary" if texts else ""))
