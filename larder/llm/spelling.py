"""Spelling variants by finite-state composition: vocabulary acceptor, one-edit transducer, vocabulary acceptor.

The transducer copies, edits one code point, and copies on. Words are enumerated by partitions of what it copies:
an edit that lies in a window of the shorter word leaves the code points before and behind
the window alone, so both words pass the same path from the initial state to the window and from
there to the end. One task composes the acceptors of whole partitions only.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.functions.pin import pinned, stored
from larder.llm.batches import mapped, small_batches, texts_of, tidy

SHORTEST, LEAST, RATIO, EVERY = 5, 3, 2, 97
BLOCK = 20_000  # words composed at once; a larger partition is split by narrower windows


def vocabulary(docs: DataFrame, id: str = "doc_id", text: str = "text", shortest: int = SHORTEST, least: int = LEAST, every: int = EVERY) -> DataFrame:
    """``word`` and ``n``: lower-cased (A-Z) runs of letters with ``shortest`` code points that occur ``least`` times.

    A run whose CRC-32 with its document's id ``every`` divides loses one code point, so that the corpus has slips to
    find (0: none). Null texts have no runs, a null id counts as an empty one. Other columns are not read.
    """
    runs = re.compile(f"[A-Za-zÀ-ÿ]{{{shortest},}}")

    def work(batch: pa.RecordBatch) -> dict:
        found: dict[str, int] = defaultdict(int)
        for key, body in zip(batch.column("doc_id").to_pylist(), texts_of(batch)):
            begun = zlib.crc32(f"{'' if key is None else key}:".encode())
            for run, n in Counter(runs.findall(body.lower().decode())).items():
                h = zlib.crc32(run.encode(), begun)
                if every and h % every == 0:
                    run = run[: h % len(run)] + run[h % len(run) + 1 :]
                    if len(run) < shortest:
                        continue
                found[run] += n
        return {"word": list(found), "n": list(found.values())}

    rows = small_batches(docs).select(F.col(id).alias("doc_id"), F.col(text).alias("text"))
    return mapped(rows, work, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


class Acceptor:
    """Minimised acceptors of several word lists with shared states. Words of one list have one length,
    so a state is final if it has no arcs."""

    def __init__(self):
        self.arcs: list[dict[str, int]] = []
        self.known: dict[tuple, int] = {}
        self.ends: dict[int, list[str]] = {}
        self.both: dict[tuple[int, int], list[str]] = {}
        self.swaps: dict[int, list[tuple[str, str]]] = {}
        self.gaps: dict[tuple[int, int], list[tuple[str, str]]] = {}

    def state(self, arcs: dict[str, int]) -> int:
        key = tuple(arcs.items())
        if key not in self.known:
            self.known[key] = len(self.arcs)
            self.arcs.append(arcs)
        return self.known[key]

    def add(self, words: list[str]) -> int:
        """The initial state of the least acceptor of ``words``: sorted, unlike and of one length."""
        path: list[dict[str, int]] = [{}]
        last = ""
        for word in words:
            same = 0
            while same < len(last) and word[same] == last[same]:
                same += 1
            while len(path) > same + 1:
                below = self.state(path.pop())
                path[-1][last[len(path) - 1]] = below
            path.extend({} for _ in range(len(word) - same))
            last = word
        while len(path) > 1:
            below = self.state(path.pop())
            path[-1][last[len(path) - 1]] = below
        return self.state(path[0])

    def accepted(self, q: int) -> list[str]:
        if q not in self.ends:
            self.ends[q] = [x + z for x, p in self.arcs[q].items() for z in self.accepted(p)] if self.arcs[q] else [""]
        return self.ends[q]

    def shared(self, q: int, p: int) -> list[str]:
        """What both states accept: the transducer copies after its edit."""
        if q == p:
            return self.accepted(q)
        key = (q, p) if q < p else (p, q)
        if key not in self.both:
            a, b = self.arcs[key[0]], self.arcs[key[1]]
            if len(a) > len(b):
                a, b = b, a
            self.both[key] = [x + z for x, to in a.items() if x in b for z in self.shared(to, b[x])]
        return self.both[key]

    def replaced(self, q: int) -> list[tuple[str, str]]:
        """Accepted pairs that differ in one code point, the smaller word first."""
        if q not in self.swaps:
            arcs = sorted(self.arcs[q].items())
            found = [(x + a, x + b) for x, to in arcs for a, b in self.replaced(to)]
            for i, (x, to) in enumerate(arcs):
                for y, other in arcs[i + 1 :]:
                    found += [(x + z, y + z) for z in self.shared(to, other)]
            self.swaps[q] = found
        return self.swaps[q]

    def inserted(self, q: int, p: int) -> list[tuple[str, str]]:
        """Pairs of a word from ``q`` and one from ``p`` with one code point more. Of the places where it
        may be inserted only the first that tells the words apart counts, so each pair comes once."""
        if (q, p) not in self.gaps:
            arcs, more = self.arcs[q], self.arcs[p]
            found = [(x + a, x + b) for x, to in arcs.items() if x in more for a, b in self.inserted(to, more[x])]
            for y, to in more.items():
                found += [(z, y + z) for z in self.shared(q, to) if not z.startswith(y)]
            self.gaps[q, p] = found
        return self.gaps[q, p]


def composed(partitions: Iterable[tuple[int, bool, dict[str, tuple[str, int]]]]) -> dict[str, tuple[int, int, str]]:
    """Number of near words and the best of each word, over partitions of (length of the window, whether it
    ends the word, words by what stands in the window)."""
    machine = Acceptor()
    near: dict[str, tuple[int, int, str]] = {}

    def link(word: str, other: str, n: int) -> None:
        count, less, best = near.get(word, (0, 1, ""))
        near[word] = (count + 1, *min((less, best), (-n, other)))

    for size, ends, words in partitions:
        short = sorted(w for w in words if len(w) == size)
        if not short or len(words) < 2:
            continue
        q = machine.add(short)
        pairs = machine.replaced(q)
        if len(short) < len(words):
            more = machine.inserted(q, machine.add(sorted(w for w in words if len(w) > size)))
            # Where the window ends before the word does, a code point behind it belongs to a later window.
            pairs = pairs + [(a, b) for a, b in more if ends or not b.startswith(a)]
        for a, b in pairs:
            (u, n), (v, m) = words[a], words[b]
            link(u, v, m)
            link(v, u, n)
    return near


def _windows(rows: DataFrame) -> DataFrame:
    """Adds the partition of each row, ``part``, and what stands in its window, ``inner``."""
    length = F.char_length("word")
    behind = F.col("m") - F.col("hi")
    ahead, rest = F.expr("substring(word, 1, lo)"), F.expr("substring(word, char_length(word) - (m - hi) + 1, m - hi)")
    return rows.withColumn("part", F.concat_ws(":", "m", "lo", "hi", F.concat(ahead, rest))).withColumn(
        "inner", F.substring("word", F.col("lo") + 1, length - F.col("lo") - behind))


def _halves(rows: DataFrame) -> DataFrame:
    middle = ((F.col("lo") + F.col("hi")) / 2).cast("int")
    cut = F.explode(F.array(F.struct("lo", middle.alias("hi")), F.struct(middle.alias("lo"), "hi"))).alias("w")
    return rows.select("word", "n", "m", cut).select("word", "n", "m", "w.lo", "w.hi").filter("lo < hi")


def near_words(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """``word``, ``n_near`` and ``best`` (its n negated as ``less``, and the word itself) of words with near ones.

    Every word is a shorter or equal partner (m: its length) and a longer one (m: one less). Partitions of more than
    ``block`` words get windows of half the size, down to one code point, where only as many words as
    letters, and pairs of letters, are left.
    """
    length = F.char_length("word")
    rows = words.select("word", "n", F.explode(F.array(length, length - 1)).alias("m")).filter("m > 0")
    rows = _windows(_halves(rows.withColumn("lo", F.lit(0)).withColumn("hi", F.col("m"))))
    done = None
    while True:
        large = stored(rows.filter("hi - lo > 1").groupBy("part").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > block), "large")
        if large.isEmpty():
            done = rows if done is None else done.unionByName(rows)
            break
        fits = rows.join(large, "part", "left_anti")
        done = fits if done is None else done.unionByName(fits)
        rows = _windows(_halves(rows.join(large, "part", "left_semi").drop("part", "inner")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, bool, dict]] = []
        count, now, inside = 0, None, {}
        for batch in batches:
            for part, size, ends, inner, word, n in zip(*(c.to_pylist() for c in batch.columns)):
                if part != now:
                    if count >= block:
                        yield _near_rows(composed(held))
                        held, count = [], 0
                    now, inside = part, {}
                    held.append((size, ends, inside))
                inside[inner] = (word, n)
                count += 1
        yield _near_rows(composed(held))

    dealt = done.select("part", (F.col("hi") - F.col("lo")).alias("size"), (F.col("hi") == F.col("m")).alias("ends"), "inner", "word", "n")
    found = dealt.repartition("part").sortWithinPartitions("part").mapInArrow(tidy(run), "word string, n_near long, less long, near string")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct("less", "near")).alias("best"))


def _near_rows(near: dict[str, tuple[int, int, str]]) -> pa.RecordBatch:
    columns = zip(*((w, *found) for w, found in near.items())) if near else ([], [], [], [])
    kinds = [("word", pa.string()), ("n_near", pa.int64()), ("less", pa.int64()), ("near", pa.string())]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(columns, kinds)], [n for n, _ in kinds])


def variants(words: DataFrame, ratio: int = RATIO, block: int = BLOCK) -> DataFrame:
    """``word``, ``form``, ``root``, ``n``, ``n_near`` and ``form_n`` of every row of ``words`` (``word`` and ``n``, each word once).

    Two words are near if one code point inserted, deleted or replaced tells them apart. The form is the near word of
    largest n (ties: the smallest in code-point order) if that is ``ratio`` times the word's own at least (``ratio`` is above 1, so
    forms never lead back); the root is where forms lead to. Words without a form are their own root. Null
    words are left out, the empty word is near no other. An empty table gives no rows.
    """
    words = stored(words.select("word", "n").filter("word is not null"), "words")
    best = near_words(words.filter("word <> ''"), block)
    has = -F.col("best.less") >= ratio * F.col("n")
    found = stored(words.join(best, "word", "left").select(
        "word", F.when(has, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(has, -F.col("best.less")).alias("form_n")), "forms")
    steps = pinned(found.filter("form is not null").select("word", F.col("form").alias("root")))
    while True:  # every round doubles the steps that a word has gone
        ahead = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = pinned(steps.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        steps = moved.select("word", "root")
        if moved.filter("moved").isEmpty():
            break
    return found.join(steps, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
