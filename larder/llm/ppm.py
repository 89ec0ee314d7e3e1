"""Language identification by prediction by partial matching.

For each language a tree of byte contexts of length 0 to 3 is counted once. A byte costs the code
length of its longest known context that has seen it, plus the escapes of the longer ones that
have not. The statistics are frozen, so the cost of a byte depends on three bytes before it only
and the trees unfold into two tables: context -> state, and (state, byte) -> cost in each language.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larder.functions.pin import pinned
from larder.llm.batches import keyed, mapped, slices, small_batches, texts_of, tidy

ORDER = 3
SAMPLE = 400  # documents a language to fit on: the only bound, and it holds for fitting alone
SALTS = 8
SLICE = 1 << 19  # bytes scored at once
UNKNOWN = "und"


def held_out(id):
    """Every document whose crc32 of the id as text is divisible by 5."""
    return F.coalesce(F.crc32(F.encode(id.cast("string"), "utf-8")) % 5 == 0, F.lit(False))


def training_sample(docs: DataFrame, lang: str = "lang", per_language: int = SAMPLE) -> DataFrame:
    """``text`` and ``lang`` of ``per_language`` documents of each language at most, by the hash of their id.

    Ids are ranked in salted groups first, so that no task sorts a whole language.
    """
    ids = docs.select("doc_id", F.col(lang).alias("lang")).filter("lang is not null and doc_id is not null").filter(~held_out(F.col("doc_id")))
    ranked = ids.distinct().withColumn("h", F.xxhash64("doc_id"))
    salted = Window.partitionBy("lang", F.pmod(F.shiftright("h", 8), F.lit(SALTS))).orderBy("h", "doc_id")
    overall = Window.partitionBy("lang").orderBy("h", "doc_id")
    kept = ranked.withColumn("r", F.row_number().over(salted)).filter(F.col("r") <= per_language)
    kept = pinned(kept.withColumn("r", F.row_number().over(overall)).filter(F.col("r") <= per_language).select("doc_id", F.col("lang").alias("of")))
    chosen = docs.join(F.broadcast(kept), "doc_id")  # at most per_language ids a language
    return chosen.filter(F.col("text").isNotNull() & (F.col(lang) == F.col("of"))).select("text", F.col("of").alias("lang"))


def gram_counts(sample: DataFrame) -> DataFrame:
    """``lang``, ``gram`` (four bytes) and ``n`` over the sample; three zero bytes precede a text."""
    def work(batch: pa.RecordBatch) -> dict:
        langs, grams, counts = [], [], []
        by: dict[str, list[bytes]] = {}
        for lang, text in zip(batch.column("lang").to_pylist(), texts_of(batch)):
            by.setdefault(lang, []).append(text)
        for lang, texts in by.items():
            data = np.frombuffer(b"".join(b"\0\0\0" + t for t in texts), "u1").astype("u4")
            codes = (data[:-3] << 24) | (data[1:-2] << 16) | (data[2:-1] << 8) | data[3:]
            values, n = np.unique(codes, return_counts=True)
            real = (values & 255 > 0)
            grams.append(values[real])
            counts.append(n[real])
            langs += [lang] * int(real.sum())
        flat = lambda parts: np.concatenate(parts).astype("i8") if parts else np.zeros(0, "i8")
        return {"lang": pa.array(langs, pa.string()), "gram": flat(grams), "n": flat(counts)}

    return mapped(sample.select("lang", "text"), work, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Trees:
    """Frozen context trees of all languages, unfolded into tables."""

    def __init__(self, languages: list[str], counts: list[tuple[np.ndarray, np.ndarray]]):
        self.languages = languages
        seen = np.unique(np.concatenate([g for g, _ in counts] or [np.zeros(0, "i8")]))
        used = np.unique(np.concatenate([(seen >> s) & 255 for s in (0, 8, 16, 24)] + [np.zeros(1, "i8")]))
        self.symbols = len(used) + 1  # the last one stands for every byte never seen
        self.code = np.full(256, len(used), "i4")
        self.code[used] = np.arange(len(used))
        size = self.symbols
        parts = [self.code[(seen >> s) & 255].astype("i8") for s in (24, 16, 8)]
        contexts = np.unique((parts[0] * size + parts[1]) * size + parts[2])
        self.state = np.full(size**3, -1, "i4")
        self.state[contexts] = np.arange(len(contexts))
        cost = np.zeros((len(contexts), size, len(languages)), "f4")
        short = np.zeros((size, size, size, len(languages)), "f4")  # contexts of two bytes
        for i, (grams, n) in enumerate(counts):
            deep, low = self._unfold(grams, n, contexts)
            cost[..., i], short[..., i] = deep, low
        self.cost = cost.reshape(len(contexts) * size, len(languages))
        self.short = short.reshape(size**3, len(languages))

    @classmethod
    def frozen(cls, tables: dict) -> Trees:
        """The trees from their tables, which is what travels to the tasks."""
        out = cls.__new__(cls)
        out.__dict__.update(tables)
        return out

    def _unfold(self, grams: np.ndarray, n: np.ndarray, contexts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Code lengths in bits for three-byte contexts and for two-byte contexts (method C escapes)."""
        size = self.symbols
        a, b, c, s = (self.code[(grams >> k) & 255].astype("i8") for k in (24, 16, 8, 0))
        lower = np.full(size, np.log2(256.0))  # no context: any byte

        def step(table: np.ndarray, below: np.ndarray) -> np.ndarray:
            """Bits of each byte after each context, from its counts and the bits of the shorter context."""
            total, kinds = table.sum(1, keepdims=True), (table > 0).sum(1, keepdims=True)
            with np.errstate(divide="ignore", invalid="ignore"):
                known = np.log2(total + kinds) - np.log2(table)
                escape = np.log2(total + kinds) - np.log2(kinds)
            return np.where(total > 0, np.where(table > 0, known, escape + below), below).astype("f4")

        def counted(key: np.ndarray, rows: int) -> np.ndarray:
            return np.bincount(key, weights=n, minlength=rows * size).reshape(rows, size)

        order0 = step(counted(s, 1), lower[None])
        order1 = step(counted(c * size + s, size), order0)
        order2 = step(counted((b * size + c) * size + s, size * size), np.tile(order1, (size, 1)))
        row = np.searchsorted(contexts, (a * size + b) * size + c)
        order3 = step(counted(row * size + s, len(contexts)), order2[contexts % (size * size)])
        return order3, order2.reshape(size, size, size)

    def bits(self, texts: list[bytes]) -> np.ndarray:
        """Exact code length of each text in each language. Long texts are scored in slices that
        carry their context on."""
        out = np.zeros((len(texts), len(self.languages)))
        size = self.symbols

        def score(owners: list[int], pieces: list[bytes]) -> None:
            codes = self.code[np.frombuffer(b"".join(pieces), "u1")]
            a, b, c, s = codes[:-3], codes[1:-2], codes[2:-1], codes[3:]
            pair = b * size + c
            state = self.state[a * (size * size) + pair]
            deep = state >= 0
            each = np.where(deep[:, None], self.cost[np.maximum(state, 0) * size + s], self.short[pair * size + s])
            lengths = np.array([len(p) for p in pieces])
            ends = np.cumsum(lengths)
            inner = np.ones(len(codes), bool)
            for k in range(3):
                inner[ends - lengths + k] = False  # the context before a piece is no part of it
            each = np.where(inner[3:, None], each, 0).astype("f8")
            sums = np.add.reduceat(each, ends - lengths, axis=0)  # entry i is the cost of byte i + 3
            for owner, total in zip(owners, sums):
                out[owner] += total

        owners, pieces, held = [], [], 0
        for i, text in enumerate(texts):
            for at in range(0, len(text), SLICE):
                before = b"\0\0\0" if at == 0 else text[at - 3 : at]
                piece = before + text[at : at + SLICE]
                owners.append(i)
                pieces.append(piece)
                held += len(piece)
                if held > SLICE:
                    score(owners, pieces)
                    owners, pieces, held = [], [], 0
        if pieces:
            score(owners, pieces)
        return out


def fit(docs: DataFrame, lang: str = "lang", per_language: int = SAMPLE) -> Trees:
    """Context trees from a bounded sample of labelled documents that are not held out.

    ``docs`` has ``doc_id``, ``text`` and ``lang``. The distinct four-byte grams of the sample come to
    the driver; they are bounded by the sample's size.
    """
    rows = gram_counts(training_sample(docs, lang, per_language)).toPandas()
    languages = sorted(rows["lang"].unique())
    return Trees(languages, [(part["gram"].to_numpy("i8"), part["n"].to_numpy("i8")) for part in (rows[rows["lang"] == x] for x in languages)])


def judged(model: Trees, texts: list[bytes]) -> list[tuple[str, float]]:
    """Language and score of each text."""
    bits = model.bits(texts) if model.languages else None
    out = []
    for i, text in enumerate(texts):
        if bits is None or not any(map(str.isalpha, text.decode())):
            out.append((UNKNOWN, 0.0))
            continue
        best = int(np.argmin(bits[i]))
        out.append((model.languages[best], float(1 / np.exp2(bits[i][best] - bits[i]).sum())))
    return out


def identify(docs: DataFrame, trees: Trees, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``row_key``, ``lang_pred`` and ``score`` of every row, from the text alone.

    The language with the shortest code wins, the first by name if several tie. ``score`` is its
    share when every language is weighted by 2 ** -bits. Null texts, texts without a letter, and all
    texts when nothing could be learned, are ``und`` with score 0.
    """
    rows = keyed(docs, id, text)
    shared = rows.sparkSession.sparkContext.broadcast(vars(trees))  # bounded by the sample

    def work(batch: pa.RecordBatch) -> dict:
        found = judged(Trees.frozen(shared.value), texts_of(batch))
        return {"doc_id": batch.column("doc_id"), "row_key": batch.column("row_key"), "lang_pred": pa.array([n for n, _ in found], pa.string()),
                "score": pa.array([s for _, s in found], pa.float64())}

    return mapped(rows, work, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, row_key long, lang_pred string, score double")


def keep_identified(docs: DataFrame, trees: Trees, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text has a language, in their own columns; the rest is rejected.

    The whole row travels through the tasks, so nothing is shuffled.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vars(trees))

    def run(parts):
        model = Trees.frozen(shared.value)
        for batch in parts:
            for part in slices(batch, text):
                yield part.filter(pa.array([name != UNKNOWN for name, _ in judged(model, texts_of(part, text))], pa.bool_()))

    return small_batches(docs).mapInArrow(tidy(run), docs.schema)
