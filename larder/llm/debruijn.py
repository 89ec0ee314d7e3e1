"""Substring dedup on a compacted de Bruijn graph of token k-mers.

A k-mer is a run of ``span`` words and an edge of the graph, from its first span - 1 words to its
last ones. K-mers with one anchor stand together as a chunk (see ``anchors``), which is a piece of a path;
following chunks of a text overlap in span - 1 words, the node between them. Repeated chunks whose
junction does not branch are compacted by joins; chunks that are unlike but share an anchor are taken
apart into k-mers, which compact where they lie. The source coordinates of each path, its least
document and place, then verify and date every long repeated span.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larder.functions.pin import pinned, stored
from larder.llm import anchors
from larder.llm.anchors import KEYS, SLICE, merged  # by name: modules do not travel to tasks by value
from larder.llm.batches import slices, texts_of, tidy

SPAN, GRAM = 50, 8  # words of a k-mer, words of a hashed gram
EDGE = ["d1", "d2"]


def paths(found: DataFrame) -> DataFrame:
    """Compacted paths of repeated chunks: ``d1``, ``d2``, ``head1``, ``head2`` and ``ahead``, the k-mers
    from the head's first one to the chunk's first one.

    ``found`` are occurrences with ``d1``, ``d2``, ``n``, ``doc_id``, ``row_key``, ``lo`` and ``hi``. Two chunks are on one
    path if one follows the other as often as each occurs: then no occurrence of either leaves the
    path. Chunks find their head by doubling, a join for each power of two of a path's length.
    """
    by_place = Window.partitionBy("doc_id", "row_key", "copy").orderBy("lo")
    # Rows repeated in full have the same places, so each gets its own number.
    numbered = found.withColumn("copy", F.row_number().over(Window.partitionBy("doc_id", "row_key", "lo").orderBy(*EDGE)))
    after = numbered.select("n", *EDGE, (F.col("hi") - F.col("lo") + 1).alias("size"), F.lead("lo").over(by_place).alias("next"), "hi",
                            *(F.lead(c).over(by_place).alias(f"to_{c}") for c in (*EDGE, "n")))
    joined = after.filter("next = hi + 1 and n = to_n").groupBy(*EDGE, "to_d1", "to_d2").agg(F.count(F.lit(1)).alias("times"), F.min("n").alias("n"), F.min("size").alias("size"))
    before = joined.filter("times = n").select(F.col("to_d1").alias("d1"), F.col("to_d2").alias("d2"), F.col("d1").alias("head1"), F.col("d2").alias("head2"), F.col("size").alias("ahead"))
    edges = found.select(*EDGE).distinct()
    state = pinned(edges.join(before, EDGE, "left").select(
        *EDGE, F.coalesce("head1", "d1").alias("head1"), F.coalesce("head2", "d2").alias("head2"), F.coalesce("ahead", F.lit(0)).cast("long").alias("ahead"), F.col("head1").isNotNull().alias("open")))
    while not state.filter("open").isEmpty():
        upper = state.filter("head1 <> d1 or head2 <> d2").select(
            F.col("d1").alias("head1"), F.col("d2").alias("head2"), F.col("head1").alias("top1"), F.col("head2").alias("top2"), F.col("ahead").alias("more"))
        state = pinned(state.join(upper, ["head1", "head2"], "left").select(
            *EDGE, F.coalesce("top1", "head1").alias("head1"), F.coalesce("top2", "head2").alias("head2"),
            (F.col("ahead") + F.coalesce("more", F.lit(0))).alias("ahead"), F.col("top1").isNotNull().alias("open")))
    return state.drop("open")


def kmers(texts: DataFrame, span: int, id_type: str) -> DataFrame:
    """Every k-mer of unlike chunks with one anchor: ``d1``, ``d2``, ``at`` (place in the chunk), and ``w1``, ``w2``, its digest."""
    def run(batches):
        for batch in (part for whole in batches for part in slices(whole, "chunk", SLICE // 4)):
            d1, d2, at, digest = [], [], [], []
            for a, b, chunk in zip(*(batch.column(n).to_pylist() for n in ("d1", "d2", "chunk"))):
                ends = np.cumsum([len(w) + 1 for w in chunk.split(b" ")])
                starts = np.r_[0, ends[:-1]]
                n = len(ends) - span + 1
                digest += [xxhash.xxh3_128_digest(chunk[x:y]) for x, y in zip(starts[:n].tolist(), (ends[span - 1 :] - 1).tolist())]
                d1 += [a] * n
                d2 += [b] * n
                at += range(n)
            both = np.frombuffer(b"".join(digest), ">i8").reshape(-1, 2).astype("i8")
            yield pa.RecordBatch.from_arrays([pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(at, pa.int64()), *(pa.array(np.ascontiguousarray(both[:, i])) for i in (0, 1))], ["d1", "d2", "at", "w1", "w2"])

    return texts.mapInArrow(tidy(run), "d1 long, d2 long, at long, w1 long, w2 long")


def repeated_spans(rows: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """``doc_id``, ``row_key``, ``first`` and ``stop`` of words that a k-mer covers which starts in a
    document with a smaller id too, and ``source_id`` and ``source_first``, where it starts there.

    ``rows`` are ``anchors.rows_of``.
    """
    id_type = rows.schema["doc_id"].dataType.simpleString()
    known = anchors.distinct_chunks(rows, True, span, gram)
    found = anchors.occurrences(rows, known, True, span, gram)
    found = found.select(*KEYS, "n", "doc_id", "row_key", "lo", "hi", "shift", "source", ((F.col("kinds") > 1) & (F.col("n") < F.col("total"))).alias("apart"))

    whole = found.filter("not apart")
    heads = paths(whole)
    sizes = whole.select(*EDGE, (F.col("hi") - F.col("lo") + 1).alias("size")).distinct()
    lengths = heads.join(sizes, EDGE).groupBy(F.col("head1").alias("d1"), F.col("head2").alias("d2")).agg(F.max(F.col("ahead") + F.col("size")).alias("length"))
    # Every occurrence of a head is followed by its whole path.
    on_path = whole.join(lengths, EDGE).filter("not source.none and source.source_id < doc_id").select(
        "doc_id", "row_key", F.col("lo").alias("first"), (F.col("lo") + F.col("length") - 1 + span).alias("stop"), "source.source_id", F.col("source.source_at").alias("source_first"))

    single = found.filter("apart")
    texts = anchors.chunk_texts(rows, single, True, span)
    origin = single.select(*EDGE, "source").dropDuplicates(EDGE)
    each = stored(kmers(texts, span, id_type).join(origin, EDGE).select(*EDGE, "at", "w1", "w2", F.struct("source.none", "source.source_id", (F.col("source.source_at") + F.col("at")).alias("source_at")).alias("source")), "kmers")
    least = each.groupBy("w1", "w2").agg(F.min("source").alias("least"), F.count(F.lit(1)).alias("chunks"))
    # A k-mer of one chunk that occurs once has no other place.
    dated = each.join(least, ["w1", "w2"]).filter("not least.none").select(*EDGE, "at", F.col("least.source_id").alias("source_id"), F.col("least.source_at").alias("source_at"), "chunks")
    # Neighbours with neighbouring sources compact to one stretch.
    run = F.col("source_at") - F.col("at")
    own = Window.partitionBy(*EDGE).orderBy("at")
    starts = dated.withColumn("run", run).withColumn("new", (
        F.lag("at").over(own).isNull() | (F.lag("at").over(own) != F.col("at") - 1) | (F.lag("run").over(own) != F.col("run")) | (F.lag("source_id").over(own) != F.col("source_id"))).cast("int"))
    stretches = starts.withColumn("g", F.sum("new").over(own)).groupBy(*EDGE, "g").agg(F.min("at").alias("a"), F.max("at").alias("b"), F.min("source_id").alias("source_id"), F.min("source_at").alias("source_first"))
    apart = single.select(*EDGE, "doc_id", "row_key", "lo").join(stretches, EDGE).filter("source_id < doc_id").select(
        "doc_id", "row_key", (F.col("lo") + F.col("a")).alias("first"), (F.col("lo") + F.col("b") + span).alias("stop"), "source_id", "source_first")
    return on_path.unionByName(apart)


def deduplicated(docs: DataFrame, id: str = "doc_id", text: str = "text", span: int = SPAN, gram: int = GRAM, texts: bool = True) -> DataFrame:
    """``doc_id``, ``row_key``, ``n_words``, ``n_removed``, ``kept_sha256`` and, with ``texts``, ``kept`` (the
    words left, joined by blanks) of every row.

    Each word goes that is covered by a run of ``span`` words whose sequence also starts in a document
    with a smaller id. White space between words does not count. Null texts have no words; null ids are
    neither smaller nor larger, so their rows stay whole and remove nothing; rows with equal ids, such
    as rows repeated in full, do not remove each other. An empty table gives no rows.
    """
    rows = anchors.rows_of(docs, id, text)
    dated = rows.filter("doc_id is not null")

    def work(batch: pa.RecordBatch) -> dict:
        out = {k: [] for k in ("n_words", "n_removed", "kept_sha256", "kept")}
        for data, spans in zip(texts_of(batch), batch.column("spans").to_pylist()):
            words, gone, parts, at = data.split(), merged(spans), [], 0
            for a, b in gone:
                parts += words[at:a]
                at = b
            kept = b" ".join(parts + words[at:])
            for k, v in zip(out, (len(words), sum(b - a for a, b in gone), hashlib.sha256(kept).hexdigest(), kept.decode())):
                out[k].append(v)
        return {"doc_id": batch.column("doc_id"), "row_key": batch.column("row_key"), **out}

    id_type = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, row_key long, n_words long, n_removed long, kept_sha256 string"
    return anchors.by_document(rows, repeated_spans(dated, span, gram), work, schema + (", kept string" if texts else ""))
