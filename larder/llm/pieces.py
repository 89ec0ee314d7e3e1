"""SentencePiece encoding and decoding over a suffix array of each batch.

The model is byte-pair encoding with byte fallback. A piece never continues over the end of a word,
so a text is the sequence of its units (spaces, then a word), and each batch indexes the text of
its distinct units: a suffix array, a binary search of every piece for its range of occurrences,
the resulting edges by position, and then a relaxation that merges along the best edge of a unit
until none is left.
"""

from __future__ import annotations

import hashlib
import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.batches import keyed, mapped, texts_of, tidy

SPACE = "▁"  # fixed value of the format: stands for a blank
NONE = np.iinfo("i4").max
CHARS = 1 << 19  # characters indexed at once; one longer unit is indexed alone
CACHED = 75_000  # units after which a task forgets those that it has not met again; they are encoded anew, with equal results
SLICE = 1 << 20  # bytes of text whose units are indexed together
UNIT = re.compile(" *[^ ]+| +")


class Model(NamedTuple):
    """Plain arrays and lists, so that they can be broadcast: the vocabulary is bounded."""

    texts: list[str]  # of each id; control pieces are empty
    scores: np.ndarray
    bytes_at: int  # id of the piece for byte 0
    unknown: int
    prefix: bool  # a blank is put before every text


def load(path: str) -> Model:
    """Reads a model file (BPE, byte fallback, no character normalization) on the driver."""
    from sentencepiece import sentencepiece_model_pb2 as format

    proto = format.ModelProto()
    with open(path, "rb") as file:
        proto.ParseFromString(file.read())
    rules, trained = proto.normalizer_spec, proto.trainer_spec
    if trained.model_type != 2 or not trained.byte_fallback or rules.precompiled_charsmap or rules.remove_extra_whitespaces:
        raise ValueError("needs a BPE model with byte fallback that keeps its text as it is")
    texts = [p.piece if p.type == 1 else "" for p in proto.pieces]
    if any(SPACE in t[1:] and t.strip(SPACE) for t in texts):
        raise ValueError("a piece reaches over the end of a word")
    return Model(texts, np.array([p.score for p in proto.pieces]), next(i for i, p in enumerate(proto.pieces) if p.piece == "<0x00>"),
                 trained.unk_id, rules.add_dummy_prefix)


class Searcher:
    """Finds every piece in a text and merges units along the edges found."""

    def __init__(self, model: Model):
        self.ids = np.array([i for i, t in enumerate(model.texts) if t], "i4")
        names = [model.texts[i].replace(SPACE, " ") for i in self.ids]
        self.longest = max(map(len, names))
        self.lengths = np.array([len(n) for n in names], "i4")
        self.names = np.zeros((len(names), self.longest), "u4")
        for i, name in enumerate(names):
            self.names[i, : len(name)] = [ord(c) + 1 for c in name]
        # Rank 0 merges first; pieces of equal score share a rank, and the leftmost of them merges first.
        _, worst = np.unique(model.scores[self.ids], return_inverse=True)
        self.rank = (worst.max() - worst).astype("i4")
        self.model = model

    def suffix_array(self, text: np.ndarray) -> np.ndarray:
        """Suffixes in order of their first ``longest`` characters, by doubling from as many as fit a key."""
        n = len(text)
        _, code = np.unique(text, return_inverse=True)
        bits = int(code.max(initial=0) + 1).bit_length()
        reach = max(62 // bits, 1)
        padded = np.concatenate([code.astype("i8") + 1, np.zeros(reach, "i8")])
        both = np.zeros(n, "i8")
        for k in range(reach):
            both = both << bits | padded[k : k + n]
        while True:
            order = np.argsort(both, kind="stable")
            if reach >= self.longest:
                return order
            keys = both[order]
            rank = np.empty(n, "i8")
            rank[order] = np.cumsum(np.r_[True, keys[1:] != keys[:-1]])
            after = np.zeros(n, "i8")
            after[: max(n - reach, 0)] = rank[reach:]
            both, reach = rank * (n + 2) + after, reach * 2

    def present(self, text: np.ndarray) -> np.ndarray:
        """Pieces whose first two characters stand side by side in the text."""
        pairs = np.unique(text[:-1].astype("u8") << np.uint64(32) | text[1:])
        first, second = self.names[:, 0].astype("u8"), self.names[:, min(1, self.longest - 1)]
        return np.flatnonzero(np.where(self.lengths > 1, np.isin(first << np.uint64(32) | second, pairs), np.isin(self.names[:, 0], text)))

    def ranges(self, text: np.ndarray, order: np.ndarray, pieces: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """First and end place of these (or all) pieces in the suffix array, searched side by side."""
        pieces = np.arange(len(self.ids)) if pieces is None else pieces
        padded = np.concatenate([text, np.zeros(self.longest, "u4")])

        def search(lo: np.ndarray, hi: np.ndarray, upper: bool) -> np.ndarray:
            while (open_ := np.flatnonzero(lo < hi)).size:
                mid = (lo[open_] + hi[open_]) // 2
                below = self._before(padded, order[mid], pieces[open_], upper)
                lo[open_[below]] = mid[below] + 1
                hi[open_[~below]] = mid[~below]
            return lo

        first = search(np.zeros(len(pieces), "i8"), np.full(len(pieces), len(order), "i8"), False)
        # A piece that the suffix at its place does not begin with occurs nowhere, so its end is its beginning.
        end, inside = first.copy(), np.flatnonzero(first < len(order))
        inside = inside[self._before(padded, order[first[inside]], pieces[inside], True)]
        end[inside] = len(order)
        return first, search(first.copy(), end, True)

    def _before(self, padded: np.ndarray, at: np.ndarray, piece: np.ndarray, upper: bool) -> np.ndarray:
        """Whether the suffix stands before the piece, or, with ``upper``, before or at it."""
        result = np.full(len(at), upper)
        equal = np.arange(len(at))
        for k in range(self.longest):
            equal = equal[self.lengths[piece[equal]] > k]
            if not equal.size:
                break
            one, two = padded[at[equal] + k], self.names[piece[equal], k]
            unlike = one != two
            result[equal[unlike]] = one[unlike] < two[unlike]
            equal = equal[~unlike]
        return result

    def edges(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and id of the piece that starts at a position with a length, by (position, length)."""
        order, pieces = self.suffix_array(text), self.present(text)
        first, end = self.ranges(text, order, pieces)
        count = end - first
        piece = np.repeat(pieces, count)
        place = np.repeat(first - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum())
        slot = order[place] * (self.longest + 1) + self.lengths[piece]
        rank = np.full(len(text) * (self.longest + 1), NONE, "i4")
        ids = np.full(len(text) * (self.longest + 1), -1, "i4")
        rank[slot], ids[slot] = self.rank[piece], self.ids[piece]
        return rank, ids

    def encode(self, units: list[str]) -> list[bytes]:
        """Ids of each unit as little-endian 32-bit integers."""
        out: list[bytes] = []
        start = held = 0
        for i, unit in enumerate(units):
            if held and held + len(unit) > CHARS:
                out += self._encode(units[start:i])
                start, held = i, 0
            held += len(unit)
        return out + (self._encode(units[start:]) if start < len(units) else [])

    def _encode(self, units: list[str]) -> list[bytes]:
        text = np.frombuffer("".join(units).encode("utf-32-le"), "u4") + np.uint32(1)
        lengths = np.array([len(u) for u in units], "i8")
        ends = np.cumsum(lengths)
        rank, ids = self.edges(text)
        step = self.longest + 1
        bounds = np.concatenate([ends - lengths, ends[-1:]])
        begin = np.arange(len(text))  # of the symbols that are left
        finished = [self._long(rank, int(a), int(b), step) for a, b in zip(bounds[:-1], bounds[1:]) if b - a > 256]
        owner = np.repeat(np.arange(len(units)), lengths)
        active = np.repeat(lengths <= 256, lengths)
        done = [begin[:0]] + finished
        begin, owner = begin[active], owner[active]
        while begin.size:
            # Each symbol with the next one of its unit, the rank of the two together, the best of the unit.
            paired = np.r_[owner[1:] == owner[:-1], False]
            stop, last = np.zeros(len(begin), "i8"), np.ones(len(begin), bool)
            stop[:-2], last[:-2] = begin[2:], owner[2:] != owner[:-2]
            stop = np.where(last, ends[owner], stop)
            span = stop - begin
            value = np.full(len(begin), np.int64(NONE) << 32)
            fits = paired & (span <= self.longest)
            value[fits] = rank[begin[fits] * step + span[fits]].astype("i8") << 32
            value += np.arange(len(begin))  # ties: the leftmost
            heads = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            best = np.minimum.reduceat(value, heads)
            found = best >> 32 < NONE
            drop = (best[found] & 0xFFFFFFFF) + 1  # the second symbol of the pair joins the first
            keep = np.ones(len(begin), bool)
            keep[drop] = False
            sizes = np.diff(np.r_[heads, len(begin)])
            over = np.repeat(~found, sizes)  # units without an edge are finished
            done.append(begin[over])
            keep &= ~over
            begin, owner = begin[keep], owner[keep]
        cut = np.sort(np.concatenate(done))
        span = np.r_[cut[1:], len(text)] - cut
        token = np.where(span <= self.longest, ids[cut * step + np.minimum(span, self.longest)], -1)
        return self._render(text, cut, token, bounds)

    def _long(self, rank: np.ndarray, a: int, b: int, step: int) -> np.ndarray:
        """Starts of the symbols of one long unit, merged by a heap."""
        from heapq import heapify, heappop, heappush

        after, before = list(range(1, b - a + 1)), list(range(-1, b - a - 1))
        alive, heap = [True] * (b - a), []

        def offer(x: int) -> None:
            y = after[x]
            if y < b - a and after[y] - x < step and (r := int(rank[(a + x) * step + after[y] - x])) < NONE:
                heap.append((r, x, after[y])) if not ready else heappush(heap, (r, x, after[y]))

        ready = False
        for x in range(b - a):
            offer(x)
        heapify(heap)
        ready = True
        while heap:
            _, x, stop = heappop(heap)
            y = after[x] if alive[x] else b - a
            if y >= b - a or after[y] != stop:
                continue
            alive[y], after[x] = False, stop
            if stop < b - a:
                before[stop] = x
            offer(x)
            if before[x] >= 0:
                offer(before[x])
        return a + np.flatnonzero(alive)

    def _render(self, text: np.ndarray, cut: np.ndarray, token: np.ndarray, bounds: np.ndarray) -> list[bytes]:
        """Characters that are no piece become the pieces of their bytes."""
        missing = np.flatnonzero(token < 0)
        if missing.size:
            chars = [chr(int(text[cut[i]]) - 1).encode() for i in missing]
            counts = np.ones(len(token), "i8")
            counts[missing] = [len(c) for c in chars]
            cut, token, place = np.repeat(cut, counts), np.repeat(token, counts), np.cumsum(counts) - counts
            for i, c in zip(place[missing].tolist(), chars):
                token[i : i + len(c)] = [self.model.bytes_at + x for x in c]
        flat = token.astype("<i4").tobytes()
        at = (np.searchsorted(cut, bounds) * 4).tolist()
        return [flat[x:y] for x, y in zip(at, at[1:])]


class Codec:
    """Encodes and decodes texts; remembers units between batches."""

    def __init__(self, model: Model):
        self.searcher, self.known, self.before = Searcher(model), {}, {}
        self.prefix = " " if model.prefix else ""
        self.bytes = [t.replace(SPACE, " ").encode() for t in model.texts]
        for i in range(256):
            self.bytes[model.bytes_at + i] = bytes([i])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers."""
        split = [UNIT.findall(self.prefix + t.replace(SPACE, " ")) if t else [] for t in texts]
        new = set().union(*split) - self.known.keys()
        kept = new & self.before.keys()
        fresh = list(new - kept)
        self.known.update(zip(fresh, self.searcher.encode(fresh)))
        self.known.update((unit, self.before[unit]) for unit in kept)
        get = self.known.__getitem__
        out = [b"".join(map(get, units)) for units in split]
        if len(self.known) > CACHED:  # units that don't occur until the next change are forgotten
            self.known, self.before = {}, self.known
        return out

    def decode(self, ids: bytes) -> str:
        """The text of ids; bytes that form no character become U+FFFD."""
        get = self.bytes.__getitem__
        raw = b"".join(map(get, np.frombuffer(ids, "<i4").tolist()))
        return raw[len(self.prefix) if raw.startswith(b" ") else 0 :].decode("utf-8", "replace")


def encode(docs: DataFrame, model: Model, id: str = "doc_id", text: str = "text", ids: bool = True) -> DataFrame:
    """``doc_id``, ``row_key``, ``n_tokens``, ``ids_sha256`` (of the ids as little-endian 32-bit
    integers), ``round_trip`` (decoding gives the text again) and, with ``ids``, ``token_ids``.

    Null and empty texts have no tokens. A text that itself holds U+2581 decodes with blanks in its
    place, as the format has it, so its ``round_trip`` is false; a null text's is null. Rows are
    independent: ties, repeats and null ids pass through; an empty table gives no rows.
    """
    rows = keyed(docs, id, text)
    shared = rows.sparkSession.sparkContext.broadcast(tuple(model))

    def work(batch: pa.RecordBatch) -> dict:
        codec = shared.__dict__.get("_codec")
        if codec is None:
            codec = shared.__dict__["_codec"] = Codec(Model(*shared.value))
        null = [not x.is_valid for x in batch.column("text")]
        texts = [t.decode() for t in texts_of(batch)]
        coded = codec.encode(texts)
        out = {"doc_id": batch.column("doc_id"), "row_key": batch.column("row_key"), "n_tokens": [len(c) // 4 for c in coded],
               "ids_sha256": [hashlib.sha256(c).hexdigest() for c in coded],
               "round_trip": [None if n else codec.decode(c) == t for c, t, n in zip(coded, texts, null)]}
        if ids:
            flat = np.frombuffer(b"".join(coded), "<i4")
            offsets = np.cumsum([0, *(len(c) // 4 for c in coded)]).astype("i4")
            out["token_ids"] = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
        return out

    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, row_key long, n_tokens long, ids_sha256 string, round_trip boolean"
    return mapped(rows, work, schema + (", token_ids array<int>" if ids else ""), limit=SLICE)


def decode(coded: DataFrame, model: Model, id: str = "doc_id", ids: str = "token_ids") -> DataFrame:
    """``doc_id`` and ``text`` of rows with token ids; null ids give a null text."""
    rows = coded.select(F.col(id).alias("doc_id"), F.col(ids).alias("token_ids"))
    shared = rows.sparkSession.sparkContext.broadcast(tuple(model))

    def run(parts):
        codec = Codec(Model(*shared.value))
        for batch in parts:
            texts = [None if x is None else codec.decode(np.array(x, "<i4").tobytes()) for x in batch.column("token_ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.mapInArrow(tidy(run), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string")
