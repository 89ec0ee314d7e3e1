"""Chunks of text around least k-gram hashes, which find repeated runs without a row for every position.

A run of ``span`` units (bytes or words) holds span - gram + 1 k-grams; the first of the least hash is
its anchor, wherever the run occurs. Consecutive runs with one anchor form a chunk: the units
from the first run's start to the last one's end. Every run lies in one chunk, and two equal runs lie
in chunks with equal anchors. So equal chunks are equal runs throughout, and only unlike chunks with
one anchor hash have to be looked into.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larder.functions.pin import stored
from larder.llm.batches import keyed, mapped, slices, small_batches, texts_of, tidy
from larder.llm.winnow import BASE, _powers, hash_filter, mix

PART = 1 << 15  # units hashed or searched at once: their arrays stay in a core's cache
SLICE = 1 << 20  # bytes of text held at once; the arrays over them take about a hundred times as much
FILTER_BITS = 26  # the filters that thin out rows before a join have 2**26 bits (8 MB), however large the input
KEYS = ["anchor", "d1", "d2"]


class Units:
    """Several texts as bytes or words: where each unit starts and ends, and each text's first unit."""

    def __init__(self, texts: list[bytes], words: bool):
        if words:  # equal words are equal bytes then, whatever stands between them
            texts = [b" ".join(t.split()) for t in texts]
            self.data = b"\n".join(texts)
            codes = np.frombuffer(self.data, "u1")
            inner = np.zeros(len(codes) + 2, bool)
            inner[1:-1] = (codes != 32) & (codes != 10)
            turn = np.flatnonzero(inner[1:] != inner[:-1])
            self.start, self.end = turn[::2], turn[1::2]
            limits = np.cumsum([len(t) + 1 for t in texts], dtype="i8") if texts else np.zeros(0, "i8")
            self.first = np.concatenate([[0], np.searchsorted(self.start, limits)]).astype("i8")
            sums, (_, back) = _sums(codes), _tables(PART)
            far = _powers(pow(BASE, -PART, 2**64), len(codes) // PART + 1)
            self.hash = sums[self.end] - sums[self.start]
            self.hash *= back[self.start % PART] * far[self.start // PART]
            self.hash += (self.end - self.start).astype("u8")
            self.hash = mix(self.hash)
        else:
            self.data = b"".join(texts)
            self.start = self.end = None
            self.first = np.cumsum([0, *map(len, texts)], dtype="i8")
            self.hash = np.frombuffer(self.data, "u1")

    def slice(self, a: int, b: int) -> bytes:
        """Units a to b as bytes."""
        return self.data[a:b] if self.start is None else self.data[self.start[a] : self.end[b - 1]] if b > a else b""

    def grams(self, size: int) -> np.ndarray:
        n = max(len(self.hash) - size + 1, 0)
        out = np.empty(n, "u8")
        powers, back = _tables(PART + size)
        for a in range(0, n, PART):
            b = min(a + PART, n)
            values = self.hash[a : b + size - 1].astype("u8")
            if self.start is None:  # a zero byte must not be as good as none
                values += np.uint64(1)
            values *= powers[: len(values)]
            sums = np.cumsum(values)
            part = out[a:b]
            part[0] = sums[size - 1]
            np.subtract(sums[size:], sums[: b - a - 1], out=part[1:])
            part *= back[: b - a]
            part[:] = mix(part)
        return out

    def chunks(self, span: int, gram: int) -> tuple[np.ndarray, ...]:
        """Text, first and last start of a run (as units of all texts), anchor hash, and units from the
        first start to the anchor, of each chunk."""
        counts = np.maximum(np.diff(self.first) - span + 1, 0)
        if not counts.sum():
            none = np.zeros(0, "i8")
            return none, none, none, none.view("u8"), none
        grams = self.grams(gram)
        at, turns = _least(grams, span - gram + 1)
        # A chunk begins with a new anchor or a new text, and ends where its text has no further run.
        some = np.flatnonzero(counts)
        cut = np.unique(np.concatenate([turns, self.first[some], self.first[some] + counts[some]]))
        text = np.searchsorted(self.first, cut, "right") - 1
        inside = np.flatnonzero(cut - self.first[text] < np.r_[counts, 0][text])
        lo, place = cut[inside], at[cut[inside]]
        return text[inside], lo, cut[inside + 1] - 1, grams[place], place - lo

    def digests(self, lo: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """128-bit digests of units lo to stop, two signed longs each."""
        a, b = (lo, stop) if self.start is None else (self.start[lo], self.end[stop - 1])
        data, digest = memoryview(self.data), xxhash.xxh3_128_digest
        return np.frombuffer(b"".join([digest(data[x:y]) for x, y in zip(a.tolist(), b.tolist())]), ">i8").reshape(-1, 2).astype("i8")


@lru_cache(maxsize=4)
def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse."""
    return _powers(BASE, n), _powers(pow(BASE, -1, 2**64), n)


def _sums(codes: np.ndarray) -> np.ndarray:
    """Sums of the bytes, each by the power of its place, up to every byte."""
    out = np.zeros(len(codes) + 1, "u8")
    powers, _ = _tables(PART)
    far = _powers(pow(BASE, PART, 2**64), len(codes) // PART + 1)
    for i, a in enumerate(range(0, len(codes), PART)):
        values = codes[a : a + PART].astype("u8") + np.uint64(1)
        values *= powers[: len(values)]
        values *= far[i]
        part = out[a + 1 : a + 1 + len(values)]
        np.cumsum(values, out=part)
        part += out[a]
    return out


def _least(grams: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Place of the first least hash in every window of ``width`` hashes, and the windows whose place
    is not the one before's."""
    n = max(len(grams) - width + 1, 0)
    out = np.empty(n, "i8")
    for a in range(0, n, PART):
        b = min(a + PART, n)
        part = grams[a : b + width - 1]
        # The place stands below the upper 40 bits, so the least key is the first least hash.
        keys = part & ~np.uint64(0xFFFFFF)
        keys |= np.arange(len(part), dtype="u8")
        reach = 1
        while 2 * reach <= width:
            keys = np.minimum(keys[:-reach], keys[reach:])
            reach *= 2
        rest = width - reach
        keys = np.minimum(keys[: b - a], keys[rest : rest + b - a])
        keys &= np.uint64(0xFFFFFF)
        np.add(keys.view("i8"), a, out=out[a:b])
    return out, np.flatnonzero(np.r_[True, out[1:] != out[:-1]])


def tested(bits: np.ndarray, values: np.ndarray, size: int = FILTER_BITS) -> np.ndarray:
    prefix = values.view("u8") >> np.uint64(64 - size)
    return (bits[(prefix >> np.uint64(3)).astype("i8")] >> (prefix & np.uint64(7)).astype("u1")) & 1 > 0


def filter_of(rows: DataFrame, column: str):
    """A broadcast bit filter of a long column: of fixed size, so it lets more through as rows grow,
    and never keeps anything back."""
    return rows.sparkSession.sparkContext.broadcast(hash_filter(rows.select(F.col(column).alias("mark")), FILTER_BITS))


def distinct_chunks(docs: DataFrame, words: bool, span: int, gram: int) -> DataFrame:
    """Chunks that can hold a repeated run: ``anchor``, ``d1``, ``d2`` (digest), ``n`` occurrences,
    ``source`` (least id and place), ``kinds`` (unlike chunks of the anchor), ``single`` (those that occur once)
    and ``total`` (occurrences of the anchor).

    Equal chunks of a slice are summed up in the task, so hot chunks are few rows when they are dealt.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def work(batch: pa.RecordBatch) -> dict:
        units = Units(texts_of(batch), words)
        text, lo, hi, anchor, _ = units.chunks(span, gram)
        digest = units.digests(lo, hi + span)
        ids = batch.column("doc_id")
        order = np.empty(batch.num_rows, "i8")
        values = ids.to_pylist()
        order[sorted(range(len(values)), key=lambda i: (values[i] is None, values[i]))] = np.arange(len(values))
        local = lo - units.first[text]
        by = np.lexsort((local, order[text], digest[:, 1], digest[:, 0], anchor))
        same = np.zeros(len(by), bool)
        same[1:] = (anchor[by][1:] == anchor[by][:-1]) & (digest[by][1:] == digest[by][:-1]).all(1)
        head = np.flatnonzero(~same)
        pick = by[head]
        return {"anchor": anchor[pick].view("i8"), "d1": digest[pick, 0], "d2": digest[pick, 1], "n": np.diff(np.r_[head, len(by)]),
                "source_id": ids.take(pa.array(text[pick])), "source_at": local[pick]}

    rows = mapped(docs, work, f"anchor long, d1 long, d2 long, n long, source_id {id_type}, source_at long", limit=SLICE)
    # All later grouping is by the anchor or more, so the rows are dealt once.
    rows = rows.repartition("anchor").groupBy(*KEYS).agg(F.sum("n").alias("n"), F.min(F.struct(F.col("source_id").isNull().alias("none"), "source_id", "source_at")).alias("source"))
    own = Window.partitionBy("anchor")
    rows = rows.withColumn("total", F.sum("n").over(own)).withColumn("kinds", F.count(F.lit(1)).over(own)).withColumn("single", F.sum((F.col("n") == 1).cast("long")).over(own))
    return stored(rows.filter("total > 1"), "chunks")


def occurrences(docs: DataFrame, known: DataFrame, words: bool, span: int, gram: int) -> DataFrame:
    """Where the known chunks stand: their columns, ``doc_id``, ``row_key``, ``lo`` and ``hi``, first and
    last start of a run, and ``shift``, units from ``lo`` to the anchor."""
    bits = filter_of(known, "d1")
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def work(batch: pa.RecordBatch) -> dict:
        units = Units(texts_of(batch), words)
        text, lo, hi, anchor, shift = units.chunks(span, gram)
        digest = units.digests(lo, hi + span)
        keep = tested(bits.value, np.ascontiguousarray(digest[:, 0]))
        text, lo, hi, anchor, shift, digest = text[keep], lo[keep], hi[keep], anchor[keep], shift[keep], digest[keep]
        at, base = pa.array(text), units.first[text]
        return {"anchor": anchor.view("i8"), "d1": digest[:, 0], "d2": digest[:, 1], "doc_id": batch.column("doc_id").take(at),
                "row_key": batch.column("row_key").take(at), "lo": lo - base, "hi": hi - base, "shift": shift}

    rows = mapped(docs, work, f"anchor long, d1 long, d2 long, doc_id {id_type}, row_key long, lo long, hi long, shift long", limit=SLICE)
    return stored(rows.join(known, KEYS), "occurrences")


def narrowed(docs: DataFrame, wanted: DataFrame, inside: bool = True) -> DataFrame:
    """Rows of ``docs`` whose key passes the filter of ``wanted`` (and maybe some more), or, with
    ``inside`` False, exactly the others."""
    bits = filter_of(wanted, "row_key")

    def run(batches):
        for batch in batches:
            fits = tested(bits.value, np.ascontiguousarray(batch.column("row_key").to_numpy()))
            yield batch.filter(pa.array(fits == inside))

    return small_batches(docs).mapInArrow(tidy(run), docs.schema)


def chunk_texts(docs: DataFrame, chunks: DataFrame, words: bool, span: int) -> DataFrame:
    """``anchor``, ``d1``, ``d2``, ``n``, ``shift`` and ``chunk`` (bytes) of one occurrence of each distinct chunk.
    ``chunks`` are rows of ``occurrences``."""
    one = chunks.groupBy(*KEYS).agg(F.min("n").alias("n"), F.min_by(F.struct("doc_id", "row_key", "lo", "hi", "shift"), F.col("row_key")).alias("at"))
    wanted = stored(one.select("at.doc_id", "at.row_key", F.struct(*KEYS, "n", "at.lo", "at.hi", "at.shift").alias("w")), "wanted")
    by_doc = wanted.groupBy("doc_id", "row_key").agg(F.collect_list("w").alias("w")).withColumnsRenamed({"doc_id": "of_id", "row_key": "of_key"})
    rows = narrowed(docs, wanted).join(by_doc, F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("row_key") == F.col("of_key"))).select("text", "w")

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                units = Units(texts_of(part), words)
                out = {k: [] for k in (*KEYS, "n", "shift", "chunk")}
                for i, want in enumerate(part.column("w").to_pylist()):
                    base = int(units.first[i])
                    for w in want:
                        for k in (*KEYS, "n", "shift"):
                            out[k].append(w[k])
                        out["chunk"].append(units.slice(base + w["lo"], base + w["hi"] + span))
                yield pa.RecordBatch.from_arrays([*(pa.array(out[k], pa.int64()) for k in (*KEYS, "n", "shift")), pa.array(out["chunk"], pa.binary())], list(out))

    # Rows repeated in full give the same chunk twice.
    return rows.mapInArrow(tidy(run), "anchor long, d1 long, d2 long, n long, shift long, chunk binary").dropDuplicates(KEYS)


def by_document(docs: DataFrame, spans: DataFrame, work, schema: str) -> DataFrame:
    """``work`` on batches of ``doc_id``, ``row_key``, ``text`` and ``spans``, the list of (first, stop) of each
    document. Documents that the filter of the spans keeps out never are shuffled."""
    spans = stored(spans.select("doc_id", "row_key", "first", "stop"), "spans")
    lists = spans.groupBy("doc_id", "row_key").agg(F.collect_list(F.struct("first", "stop")).alias("spans")).withColumnsRenamed({"doc_id": "of_id", "row_key": "of_key"})
    some = narrowed(docs, spans).join(lists, F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("row_key") == F.col("of_key")), "left").select("doc_id", "row_key", "text", "spans")
    none = narrowed(docs, spans, inside=False).select("doc_id", "row_key", "text", F.lit(None).cast("array<struct<first:bigint,stop:bigint>>").alias("spans"))
    return mapped(some, work, schema).unionByName(mapped(none, work, schema))


def merged(spans: list[dict] | None) -> list[tuple[int, int]]:
    """Union of (first, stop) ranges, in order; ranges that touch become one."""
    out: list[list[int]] = []
    for s in sorted((s["first"], s["stop"]) for s in spans or []):
        if out and s[0] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], s[1])
        else:
            out.append([*s])
    return [(a, b) for a, b in out]


def rows_of(docs: DataFrame, id: str, text: str) -> DataFrame:
    return keyed(docs, id, text).select("doc_id", "row_key", "text")
