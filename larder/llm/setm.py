"""Phrase collocations by set-oriented mining: occurrence relations joined at adjacent places, counted, and cut to frequent phrases.

The relation of length k holds where frequent phrases of k words stand, ordered by piece and place. It is kept
in stretches: a row has runs of words whose every k neighbours are frequent, in text order, with a full
stop between runs. So places next to each other are next to each other in a row, and the merge-join of two
occurrences of k words that overlap in k - 1 is a step along a run.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larder.functions.pin import pinned, stored
from larder.llm.anchors import tested
from larder.llm.batches import mapped, slices, small_batches, texts_of, tidy
from larder.llm.winnow import ODD, hash_filter, mix

LONGEST, SUPPORT, SHARE, TOP = 5, 100, 100, 2000
LEAST_BITS, MOST_BITS = 20, 28  # the filter of frequent phrases has 64 bits for each, and 32 MB at most
PART = 1 << 20  # words whose phrases are counted in one group, about
GATHERED = 1 << 21  # hashes that a task holds before it sends them
STOP = b"."
CLEAN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ,;:!?\n\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz......... ")


def occurrences(docs: DataFrame, lang: str = "lang", text: str = "text") -> DataFrame:
    """``lang``, ``words`` and ``n`` of every row: lower-cased words between blanks with a full stop between
    pieces, and the number of words. This is the one relation that is not written: it is the text itself."""

    def work(batch: pa.RecordBatch) -> dict:
        clean = [t.translate(CLEAN).replace(STOP, b" . ") for t in texts_of(batch)]
        return {"lang": batch.column("lang"), "words": [c.decode() for c in clean], "n": [len(c.split()) - c.count(STOP) for c in clean]}

    rows = small_batches(docs).select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).alias("text"))
    return mapped(rows, work, "lang string, words string, n long")


class Runs:
    """Words of one language in order, as codes; code 0 ends a run."""

    def __init__(self, lang: str, rows: list[bytes]):
        self.words = b" . ".join(rows).split()
        codes: dict[bytes, int] = defaultdict(lambda: len(codes))
        codes[STOP]
        self.codes = np.fromiter(map(codes.__getitem__, self.words), "i8", len(self.words))
        self.kinds = list(codes)
        digest, seed = xxhash.xxh64_intdigest, xxhash.xxh64_intdigest(lang)
        self.hash = np.array([digest(w, seed) for w in codes], "u8")

    def places(self, size: int) -> np.ndarray:
        """Where ``size`` words of one run start."""
        stops = np.cumsum(np.r_[0, self.codes == 0])
        return np.flatnonzero(stops[size:] == stops[:-size]) if len(stops) > size else np.zeros(0, "i8")

    def distinct(self, at: np.ndarray, size: int) -> list[tuple[bytes, int]]:
        """The phrases at these places, and how often each stands there."""
        if size == 1:
            n = np.bincount(self.codes[at], minlength=1)
            return [(self.kinds[c], m) for c, m in enumerate(n.tolist()) if m]
        phrase, kinds = self.codes[at], len(self.hash)
        for k in range(1, size):
            if kinds ** (k + 1) >= 2**63:
                phrase = np.unique(phrase, return_inverse=True)[1]
            phrase = phrase * kinds + self.codes[at + k]
        _, first, n = np.unique(phrase, return_index=True, return_counts=True)
        return [(b" ".join(self.words[a : a + size]), m) for a, m in zip(at[first].tolist(), n.tolist())]

    def marks(self, at: np.ndarray, size: int) -> np.ndarray:
        """A hash of the phrase at each place."""
        if size == 1:
            return mix(ODD + self.hash)[self.codes[at]]
        out = np.full(len(at), size, "u8")
        for k in range(size):
            out = out * ODD + self.hash[self.codes[at + k]]
        return mix(out)


def _by_language(batch: pa.RecordBatch) -> Iterator[tuple[str, Runs]]:
    rows: dict[str, list[bytes]] = defaultdict(list)
    for lang, words in zip(batch.column("lang").to_pylist(), texts_of(batch, "words")):
        rows[lang].append(words)
    return ((lang, Runs(lang, found)) for lang, found in rows.items())


def _lead(total: int) -> int:
    """Leading bits of a mark that name its group."""
    return max((total // PART).bit_length(), 4)


def heavy_marks(relation: DataFrame, size: int, support: int, total: int) -> DataFrame:
    """``mark``: hashes of phrases whose occurrences, or those of a few phrases together, reach ``support``.

    The first half of the group-count. Each task sends the hashes of its phrases, once each, in sorted
    arrays by the leading bits: about two bytes a phrase, however long its words. The groups grow in number with
    the ``total`` of words, not in size, and a group has 16 times as many hashes as words.
    """
    lead = _lead(total)
    away = np.uint64(64 - lead - 24)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def gathered() -> pa.RecordBatch:
            marks, n = np.unique(np.concatenate(held), return_counts=True)
            group, high, low = (marks >> np.uint64(24)).astype("i8"), (marks >> np.uint64(16)).astype("u1"), marks.astype("u2")
            cut = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else np.zeros(0, "i8")
            counts = np.minimum(n, 2**16 - 1).astype("u2") if support < 2**16 else n.astype("u4")
            rows = [[x[a:b].tobytes() for x in (high, low, counts)] for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(group)])]
            return pa.RecordBatch.from_arrays([pa.array(group[cut], pa.int64()), *(pa.array([r[i] for r in rows], pa.binary()) for i in range(3))],
                                              ["part", "high", "low", "counts"])

        held: list[np.ndarray] = []
        for batch in batches:
            for part in slices(batch, "words"):
                held += [runs.marks(runs.places(size), size) >> away for _, runs in _by_language(part)]
                if sum(map(len, held)) > GATHERED:
                    yield gathered()
                    held = []
        if held:
            yield gathered()

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def heavy() -> pa.RecordBatch:
            keys = np.concatenate([np.frombuffer(h, "u1").astype("u4") << np.uint32(16) | np.frombuffer(w, "u2") for h, w, _ in held])
            counts = np.concatenate([np.frombuffer(n, "u2" if support < 2**16 else "u4") for _, _, n in held])
            found, which = np.unique(keys, return_inverse=True)
            found = found[np.bincount(which, counts) >= support].astype("u8")
            return pa.RecordBatch.from_arrays([pa.array(((np.uint64(now) << np.uint64(24) | found) << away).view("i8"))], ["mark"])

        held, now = [], None
        for batch in batches:
            for part, *arrays in zip(*(c.to_pylist() for c in batch.columns)):
                if held and part != now:
                    yield heavy()
                    held = []
                now = part
                held.append(arrays)
        if held:
            yield heavy()

    rows = relation.select("lang", "words").mapInArrow(tidy(spread), "part long, high binary, low binary, counts binary")
    return stored(rows.repartition("part").sortWithinPartitions("part").mapInArrow(tidy(summed), "mark long"), f"marks_{size}")


class Known:
    """A broadcast filter of marks. It lets all of them pass, and some others."""

    def __init__(self, marks: DataFrame):
        self.size = min(max(marks.count().bit_length() + 6, LEAST_BITS), MOST_BITS)
        self.bits = marks.sparkSession.sparkContext.broadcast(hash_filter(marks, self.size))

    def __call__(self, marks: np.ndarray) -> np.ndarray:
        return tested(self.bits.value, marks, self.size)


def counted(relation: DataFrame, size: int, known: Known, support: int, total: int) -> DataFrame:
    """``lang``, ``phrase`` and ``f``, its occurrences, of known phrases that reach ``support``: the second half of the
    group-count, by their words. Each task sends its phrases and their counts in sorted arrays, dealt in as many groups as in the first half."""
    away = 32 - _lead(total)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def gathered() -> pa.RecordBatch:
            rows: dict[tuple[int, str], list] = defaultdict(list)
            for lang, counts in held.items():
                for phrase, n in sorted(counts.items()):
                    rows[zlib.crc32(phrase) >> away, lang].append((phrase, n))
            columns = ([k for k, _ in rows], [lang for _, lang in rows], [b"\n".join(p for p, _ in found) for found in rows.values()],
                       [np.array([n for _, n in found], "u4").tobytes() for found in rows.values()])
            kinds = (pa.int64(), pa.string(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["part", "lang", "phrases", "counts"])

        held: dict[str, Counter] = defaultdict(Counter)
        for batch in batches:
            for part in slices(batch, "words"):
                for lang, runs in _by_language(part):
                    at = runs.places(size)
                    held[lang].update(dict(runs.distinct(at[known(runs.marks(at, size))], size)))
                if sum(map(len, held.values())) > GATHERED // 8:
                    yield gathered()
                    held.clear()
        yield gathered()

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def frequent() -> pa.RecordBatch:
            found = {p: n for p, n in held.items() if n >= support}
            return pa.RecordBatch.from_arrays([pa.array([now[1]] * len(found), pa.string()), pa.array([p.decode() for p in found], pa.string()),
                                               pa.array(found.values(), pa.int64())], ["lang", "phrase", "f"])

        held, now = Counter(), None
        for batch in batches:
            for part, lang, phrases, counts in zip(*(c.to_pylist() for c in batch.columns)):
                if (part, lang) != now:
                    if held:
                        yield frequent()
                    held, now = Counter(), (part, lang)
                held.update(dict(zip(phrases.split(b"\n"), np.frombuffer(counts, "u4").tolist())))
        if held:
            yield frequent()

    rows = relation.select("lang", "words").mapInArrow(tidy(spread), "part long, lang string, phrases binary, counts binary")
    return rows.repartition("part").sortWithinPartitions("part", "lang").mapInArrow(tidy(summed), "lang string, phrase string, f long")


def restricted(relation: DataFrame, size: int, known: Known) -> DataFrame:
    """Runs of the relation in which every ``size`` neighbours are frequent and that one more word can follow.

    The semi-join with the frequent phrases is a test where the relation lies: it keeps each of them, and what it
    keeps besides is counted, and dropped, at the next length.
    """

    def work(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {"lang": [], "words": []}
        for lang, runs in _by_language(batch):
            at = runs.places(size)
            at = at[known(runs.marks(at, size))]
            if not len(at):
                continue
            cut = np.flatnonzero(np.diff(at) > 1) + 1
            start, last = at[np.r_[0, cut]], at[np.r_[cut, len(at)] - 1]
            longer = last > start
            found = [b" ".join(runs.words[a : b + size]) for a, b in zip(start[longer].tolist(), last[longer].tolist())]
            if found:
                out["lang"].append(lang)
                out["words"].append(b" . ".join(found).decode())
        return out

    return stored(mapped(relation.select("lang", "words"), work, "lang string, words string", text="words"), f"occurrences_{size}")


def frequent_phrases(docs: DataFrame, lang: str = "lang", text: str = "text", longest: int = LONGEST, support: int = SUPPORT) -> DataFrame:
    """``lang``, ``phrase``, ``k`` (words) and ``f`` of every phrase of up to ``longest`` words that occurs ``support``
    times within pieces, overlaps included; and for each language a row of k = 0 with all its words.

    Null texts count as empty, a null language as ``und``. Other columns are not read. An empty table gives no rows.
    """
    relation = occurrences(docs, lang, text)
    levels = pinned(relation.groupBy("lang").agg(F.sum("n").alias("f")).select("lang", F.lit("").alias("phrase"), F.lit(0).alias("k"), "f"))
    total = levels.agg(F.sum("f")).first()[0] or 0
    for size in range(1, longest + 1):
        known = Known(heavy_marks(relation, size, support, total))
        level = stored(counted(relation, size, known, support, total).select("lang", "phrase", F.lit(size).alias("k"), "f"), f"frequent_{size}")
        levels = levels.unionByName(level)
        if size < longest:
            relation = restricted(relation, size, known)
    return stored(levels, "frequent")


def _parts(first: Column | str, count: Column | str) -> Column:
    return F.array_join(F.slice("words", first, count), " ")


def collocations(docs: DataFrame, lang: str = "lang", text: str = "text", longest: int = LONGEST, support: int = SUPPORT,
                 share: int = SHARE, top: int | None = TOP) -> DataFrame:
    """The ``top`` phrases of two words and more of each language (all, if None), by the lowest score of their cuts.

    Columns: ``lang``, ``rank``, ``phrase``, ``a`` (its occurrences), ``l`` and ``r`` (those of the two parts of its lowest
    cut), ``n`` (words of the language) and ``score``, floor(1000 a n / (l r)). Of cuts with equal scores the
    first counts. Dropped are phrases inside a longer one of up to ``longest`` words that has ``share`` percent of their
    occurrences: to find these, one word more on either side is enough, since what lies between
    the two occurs as often as the longer at least. Equal ranks don't occur, since phrases differ.
    """
    levels = frequent_phrases(docs, lang, text, longest, support)
    phrases = levels.filter("k > 0").select("lang", "phrase", "k", "f", F.split("phrase", " ").alias("words"))
    totals = levels.filter("k = 0").select("lang", F.col("f").alias("n"))

    wider = phrases.filter("k > 2").select("lang", "f", F.explode(F.array(_parts(F.lit(1), F.col("k") - 1), _parts(F.lit(2), F.col("k") - 1))).alias("phrase"))
    wider = wider.groupBy("lang", "phrase").agg(F.max("f").alias("within"))
    own = phrases.filter("k > 1").join(wider, ["lang", "phrase"], "left").filter(
        F.coalesce(100 * F.col("within") < share * F.col("f"), F.lit(True)))

    cuts = own.select("lang", "phrase", F.col("f").alias("a"), "words", "k", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.select("lang", "phrase", "a", "cut", _parts(F.lit(1), F.col("cut")).alias("head"), _parts(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("tail"))
    left = phrases.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l"))
    right = phrases.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r"))
    whole = {c: F.col(c).cast("decimal(18,0)") for c in "alrn"}
    scored = cuts.join(left, ["lang", "head"]).join(right, ["lang", "tail"]).join(totals, "lang").withColumns(
        {"up": (1000 * (whole["a"] * whole["n"])).cast("decimal(38,0)"), "down": whole["l"] * whole["r"]})
    lowest = scored.withColumn("score", F.expr("up div down")).groupBy("lang", "phrase", "a", "n").agg(
        F.min(F.struct("score", "cut", "l", "r")).alias("low")).select("lang", "phrase", "a", "low.l", "low.r", "n", "low.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = lowest.withColumn("rank", F.row_number().over(order).cast("long"))
    return (ranked if top is None else ranked.filter(F.col("rank") <= top)).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
