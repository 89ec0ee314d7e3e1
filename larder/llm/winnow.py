"""Benchmark decontamination by winnowing: least k-gram hash of each window, joined and extended."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.functions.pin import stored
from larder.llm.batches import keyed, mapped, texts_of

PART = 1 << 20  # bytes of text whose words are hashed together
SPAN, GRAM = 10, 5  # words of a shared span, words of a hashed k-gram
FILTER_BITS = 24  # the filter of benchmark hashes has 2**24 bits (2 MB), however large the benchmark
ODD = np.uint64(0x9E3779B97F4A7C15)
BASE = 0x100000001B3  # multiplier of the rolling byte hash, odd so that it can be inverted
WORD_BYTE = np.zeros(256, bool)
WORD_BYTE[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, "u8")
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


class Words:
    """Words of several texts: lower-cased bytes, start and end of each, its text, and a hash."""

    def __init__(self, texts: list[bytes]):
        joined = b"\n".join(texts).lower()
        self.data = np.frombuffer(joined, "u1")
        word = np.zeros(len(self.data) + 2, bool)
        word[1:-1] = WORD_BYTE[self.data]
        turn = np.flatnonzero(word[1:] != word[:-1])
        self.start, self.end = turn[::2], turn[1::2]
        self.bytes = joined
        limits = np.cumsum([len(t) + 1 for t in texts], dtype="i8") if texts else np.zeros(0, "i8")
        self.first = np.concatenate([[0], np.searchsorted(self.start, limits)]).astype("i8")  # of each text
        self.hash = self._hashes()

    def _hashes(self) -> np.ndarray:
        """Polynomial hash of each word from sums over the text, shifted back to the word's start."""
        n = len(self.data)
        if not len(self.start):
            return np.zeros(0, "u8")
        sums = np.zeros(n + 1, "u8")
        np.cumsum((self.data.astype("u8") + np.uint64(1)) * _powers(BASE, n), out=sums[1:])
        back = _powers(pow(BASE, -1, 2**64), n)
        return mix((sums[self.end] - sums[self.start]) * back[self.start] + (self.end - self.start).astype("u8"))

    def grams(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the ``size`` words from each word on, and whether they lie in one text."""
        n = len(self.start) - size + 1
        if n <= 0:
            return np.zeros(0, "u8"), np.zeros(0, bool)
        out = np.zeros(n, "u8")
        for i in range(size):
            out = out * ODD + self.hash[i : i + n]
        text = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))
        return mix(out + np.uint64(size)), text[:n] == text[size - 1 :]

    def text_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, at, side="right") - 1

    def span(self, text: int, a: int, b: int) -> list[str]:
        """Words a to b of a text (limits beyond it are cut)."""
        lo, hi = self.first[text], self.first[text + 1]
        return [self.bytes[s:e].decode() for s, e in zip(self.start[max(a, lo) : min(b, hi)].tolist(), self.end[max(a, lo) : min(b, hi)].tolist())]


def selected(words: Words, span: int, gram: int) -> np.ndarray:
    """Where the least hash of every window of span - gram + 1 k-grams stands: each run of ``span``
    words holds one, and the same one wherever it occurs. Equal least hashes are all kept."""
    hashes, whole = words.grams(gram)
    width = span - gram + 1
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, "i8")
    least = hashes[:n].copy()
    fits = whole[:n].copy()
    for i in range(1, width):
        np.minimum(least, hashes[i : i + n], out=least)
        fits &= whole[i : i + n]
    keep = np.zeros(len(hashes), bool)
    for i in range(width):
        keep[i : i + n] |= fits & (hashes[i : i + n] == least)
    return np.flatnonzero(keep)


def _marks(words: Words, span: int, gram: int, lengths: list[int], passes=None) -> tuple:
    """Text, word position in it, gram size, hash and surrounding words of every fingerprint."""
    found = []
    whole = selected(words, span, gram)
    hashes, _ = words.grams(gram)
    found.append((whole, hashes[whole] if len(whole) else np.zeros(0, "u8"), gram, span))
    for size in lengths:  # items shorter than a span match as a whole
        all_hashes, fits = words.grams(size)
        at = np.flatnonzero(fits)
        found.append((at, mix(all_hashes[at] + np.uint64(1)), size, size))
    text, pos, size, mark, before, inside = [], [], [], [], [], []
    for at, values, gram_size, whole_size in found:
        if passes is not None and len(at):
            ok = passes(values)
            at, values = at[ok], values[ok]
        owner, reach = words.text_of(at), whole_size - gram_size
        for i, (a, t) in enumerate(zip(at.tolist(), owner.tolist())):
            text.append(t)
            pos.append(a - int(words.first[t]))
            size.append(whole_size)
            mark.append(int(values[i].view("i8")))
            left = words.span(t, a - reach, a)
            before.append(len(left))
            inside.append(left + words.span(t, a, a + gram_size + reach))
    return text, pos, size, mark, before, inside


def item_marks(items: DataFrame, id: str = "item_id", text: str = "text", span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """Fingerprints of the benchmark: ``mark``, ``size``, ``item_id`` and the words around."""
    rows = items.select(F.col(id).cast("string").alias("item_id"), F.col(text).alias("text"))

    def work(batch: pa.RecordBatch) -> dict:
        texts = texts_of(batch)
        ids = batch.column("item_id").to_pylist()
        words = Words(texts)
        counts = np.diff(words.first)
        out: dict[str, list] = {k: [] for k in ("item_id", "size", "mark", "item_before", "item_words")}

        def add(part: Words, owners: list, lengths: list[int]) -> None:
            t, _, size, mark, before, inside = _marks(part, span, gram, lengths)
            out["item_id"] += [owners[i] for i in t]
            for key, value in zip(("size", "mark", "item_before", "item_words"), (size, mark, before, inside)):
                out[key] += value

        add(words, ids, [])
        for length in {int(c) for c in counts if 0 < c < span}:
            short = [i for i, c in enumerate(counts) if c == length]
            add(Words([texts[i] for i in short]), [ids[i] for i in short], [length])
        return out

    return mapped(rows, work, "item_id string, size int, mark long, item_before int, item_words array<string>").distinct()


def hash_filter(marks: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """One bit for each prefix of a hash that occurs: 2**bits bits, whatever the number of hashes."""
    prefix = F.shiftrightunsigned("mark", 64 - bits) + 1
    rows = marks.groupBy(F.bitmap_bucket_number(prefix).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(prefix)).alias("bits")).collect()
    out = np.zeros(2**bits // 8 + 8192, "u1")
    for row in rows:
        at = (row["bucket"] - 1) * 4096
        out[at : at + len(row["bits"])] = np.frombuffer(row["bits"], "u1")
    return out


def hits(docs: DataFrame, items: DataFrame, id: str = "doc_id", text: str = "text", item_id: str = "item_id",
         item_text: str = "text", span: int = SPAN, gram: int = GRAM) -> tuple[DataFrame, DataFrame]:
    """Word counts of every row of ``docs``, and the shared spans.

    The spans have ``doc_id``, ``row_key``, ``item_id``, ``first_word`` and ``n`` (words). Every run
    of ``span`` words that a document shares with an item lies in one of them; an item of fewer words
    is searched as a whole. The first result is ``doc_id``, ``row_key``, ``n_words``.
    """
    wanted = stored(item_marks(items, item_id, item_text, span, gram), "item_marks")
    short = sorted(r[0] for r in wanted.select("size").distinct().collect() if r[0] < span)  # span - 1 values at most
    known = docs.sparkSession.sparkContext.broadcast(hash_filter(wanted))  # of fixed size
    shift = np.uint64(64 - FILTER_BITS)
    rows = keyed(docs, id, text)

    def passes(values: np.ndarray) -> np.ndarray:
        prefix = values >> shift
        return (known.value[(prefix >> np.uint64(3)).astype("i8")] >> (prefix & np.uint64(7)).astype("u1")) & 1 > 0

    def work(batch: pa.RecordBatch) -> dict:
        words = Words(texts_of(batch))
        found: list[list] = [[] for _ in range(batch.num_rows)]
        for t, pos, size, mark, before, inside in zip(*_marks(words, span, gram, short, passes)):
            found[t].append({"pos": pos, "size": size, "mark": mark, "before": before, "words": inside})
        kind = pa.list_(pa.struct([("pos", pa.int64()), ("size", pa.int32()), ("mark", pa.int64()), ("before", pa.int32()), ("words", pa.list_(pa.string()))]))
        return {"doc_id": batch.column("doc_id"), "row_key": batch.column("row_key"), "n_words": np.diff(words.first), "found": pa.array(found, kind)}

    id_type = rows.schema["doc_id"].dataType.simpleString()
    read = stored(mapped(rows, work, f"doc_id {id_type}, row_key long, n_words long, found array<struct<pos:bigint,size:int,mark:bigint,before:int,words:array<string>>>", limit=PART), "document_marks")
    marks = read.select("doc_id", "row_key", F.explode("found").alias("f")).select("doc_id", "row_key", "f.*")
    joined = marks.join(wanted, ["mark", "size"])
    # The k-gram itself, then as many equal words as there are on either side of it.
    reach = F.when(F.col("size") < span, F.col("size")).otherwise(F.lit(gram))

    def run_length(one, two, n):
        """Equal leading words of two lists of which the first n count."""
        unlike = F.filter(F.sequence(F.lit(0), n), lambda i: (i >= n) | ~F.get(one, i).eqNullSafe(F.get(two, i)))
        return F.element_at(unlike, 1)

    def left(words, before):
        return F.reverse(F.slice(words, F.lit(1), before))

    def right(words, before):
        return F.slice(words, before + reach + 1, F.size(words))

    def middle(words, before):
        return F.slice(words, before + 1, reach)

    equal = joined.filter(middle(F.col("words"), F.col("before")) == middle(F.col("item_words"), F.col("item_before")))
    sided = equal.select(
        "doc_id", "row_key", "item_id", "pos", "size", reach.alias("reach"),
        left(F.col("words"), F.col("before")).alias("l1"), left(F.col("item_words"), F.col("item_before")).alias("l2"),
        right(F.col("words"), F.col("before")).alias("r1"), right(F.col("item_words"), F.col("item_before")).alias("r2"))
    grown = sided.withColumn("l", run_length(F.col("l1"), F.col("l2"), F.least(F.size("l1"), F.size("l2")))).withColumn(
        "r", run_length(F.col("r1"), F.col("r2"), F.least(F.size("r1"), F.size("r2"))))
    spans = grown.select("doc_id", "row_key", "item_id", (F.col("pos") - F.col("l")).alias("first_word"),
                         (F.col("l") + F.col("reach") + F.col("r")).cast("long").alias("n"), "size").filter(F.col("n") >= F.col("size"))
    return read.select("doc_id", "row_key", "n_words"), spans.drop("size").distinct()


def contamination(docs: DataFrame, items: DataFrame, id: str = "doc_id", text: str = "text", item_id: str = "item_id",
                  item_text: str = "text", span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """``doc_id``, ``row_key``, ``n_words``, ``n_hit`` and ``items`` (sorted) of every row of ``docs``.

    Words are runs of ASCII letters and digits and of all other non-ASCII bytes, after A-Z are
    lower-cased. Null texts have no words; null items and items without words match nothing; a null
    ``item_id`` is left out of ``items`` while its words count as hit. Rows repeated in full, or
    with equal ids and other texts, are each judged alone; an empty table on either side gives
    no hits. Other columns are not read.
    """
    counted, spans = hits(docs, items, id, text, item_id, item_text, span, gram)
    spans = stored(spans, "spans")
    ids = ["doc_id", "row_key"]
    word = spans.select(*ids, F.explode(F.sequence("first_word", F.col("first_word") + F.col("n") - 1)).alias("word"))
    # Rows repeated in full have the same spans twice, so distinct words are counted.
    n_hit = word.distinct().groupBy(*ids).agg(F.count(F.lit(1)).alias("n_hit"))
    found = spans.select(*ids, "item_id").distinct().groupBy(*ids).agg(F.array_sort(F.collect_list("item_id")).alias("items"))
    hit = n_hit.withColumnsRenamed({"doc_id": "hit_id", "row_key": "hit_key"}).join(
        found.withColumnsRenamed({"doc_id": "item_doc", "row_key": "item_key"}),
        F.col("hit_id").eqNullSafe(F.col("item_doc")) & (F.col("hit_key") == F.col("item_key"))).select("hit_id", "hit_key", "n_hit", "items")
    return counted.join(hit, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("row_key") == F.col("hit_key")), "left").select(
        "doc_id", "row_key", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def drop_contaminated(docs: DataFrame, items: DataFrame, id: str = "doc_id", text: str = "text", **params) -> DataFrame:
    """The rows of ``docs`` that share no span with an item, in their own columns."""
    _, spans = hits(docs, items, id, text, **params)
    hit = stored(spans.select(F.struct("doc_id", "row_key").alias("__hit")).distinct(), "contaminated")
    key = F.xxhash64(F.col(id).cast("string"), F.lit("|"), text)
    return docs.join(hit, docs[id].eqNullSafe(F.col("__hit.doc_id")) & (key == F.col("__hit.row_key")), "left_anti")
