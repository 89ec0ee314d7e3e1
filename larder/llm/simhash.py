"""SimHash near-dedup: shards of fingerprints, a BK-tree for each, searched along edges within the radius."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.functions.pin import pinned, stored
from larder.llm.anchors import narrowed
from larder.llm.batches import keyed, mapped, runs_of_groups, texts_of, tidy
from larder.llm.graph import components

SEED = 42
BLOCK = 2048  # fingerprints of one shard tree
MARGIN, SETS = 0.05, 512  # a sketch passes pairs so much below the likeness; sets compared in one group
BANDS, ROWS, BINS = 10, 3, 1024  # shards for wide radii, minima in each, and bins of the sketch


def shingle_hashes(text: bytes, size: int) -> np.ndarray:
    """XXH64 of each shingle of the lower-cased words, repeats included."""
    words = text.lower().split()
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)] if words else [], "u8")
    shifted = zip(*(words[i:] for i in range(size)))
    digest, join = xxhash.xxh64_intdigest, b" ".join
    return np.array([digest(join(x), SEED) for x in shifted], "u8")


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is 1 if more than half of the hashes have it."""
    if not len(hashes):
        return 0
    bits = np.unpackbits(hashes.astype(">u8").view("u1").reshape(-1, 8), axis=1)
    return int(np.packbits(bits.sum(0, dtype="i8") * 2 > len(hashes)).view(">u8")[0])


def sketch(hashes: np.ndarray) -> bytes:
    """The least hash in each of 1,024 bins, a byte of each (0: empty)."""
    out = np.zeros(BINS, "u1")
    if len(hashes):
        top = np.sort(hashes)
        bins, first = np.unique(top >> np.uint64(54), return_index=True)
        out[bins.astype(int)] = 1 + (top[first] * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(56)) % np.uint64(255)
    return out.tobytes()


def similar(one: bytes, two: bytes) -> float:
    """Jaccard similarity as the share of equal bins, less those that are equal by chance."""
    a, b = np.frombuffer(one, "u1"), np.frombuffer(two, "u1")
    either = np.count_nonzero(a | b)
    equal = np.count_nonzero((a == b) & (a > 0))
    chance = (np.count_nonzero((a > 0) & (b > 0)) - equal) / 254
    return (equal - chance) / either if either else 1.0


def jaccard(one: bytes, two: bytes) -> float:
    """Jaccard similarity of two sets of hashes, each sorted."""
    a, b = np.frombuffer(one, "u8"), np.frombuffer(two, "u8")
    both = len(np.intersect1d(a, b, assume_unique=True))
    either = len(a) + len(b) - both
    return both / either if either else 1.0


def bands(hashes: np.ndarray) -> list[int]:
    """Keys that two texts share with probability J**3 each, J their Jaccard similarity."""
    if not len(hashes):
        return [0]
    rng = np.random.default_rng(SEED)
    odd = rng.integers(1, 2**63, BANDS * ROWS, dtype="u8") * np.uint64(2) + np.uint64(1)
    least = np.empty(BANDS * ROWS, "u8")
    for i, factor in enumerate(odd):
        mixed = hashes * factor
        least[i] = (mixed ^ (mixed >> np.uint64(29))).min()
    keys = least.reshape(BANDS, ROWS)
    return [xxhash.xxh64_intdigest(row.tobytes(), i) - 2**63 for i, row in enumerate(keys)]


class BKTree:
    """Fingerprints by Hamming distance to their parent."""

    def __init__(self):
        self.root = None

    def add(self, value: int, payload=None) -> None:
        node = self.root
        if node is None:
            self.root = (value, payload, {})
            return
        while True:
            gap = (node[0] ^ value).bit_count()
            below = node[2].get(gap)
            if below is None:
                node[2][gap] = (value, payload, {})
                return
            node = below

    def within(self, value: int, radius: int) -> Iterator[tuple[int, object]]:
        """Follows only the edges whose distance can hold something within the radius."""
        open_nodes = [self.root] if self.root else []
        while open_nodes:
            node = open_nodes.pop()
            gap = (node[0] ^ value).bit_count()
            if gap <= radius:
                yield node[0], node[1]
            if node[2]:
                open_nodes.extend(below for edge, below in node[2].items() if gap - radius <= edge <= gap + radius)


def stars(first: list, second: list | None, radius: int, alike: Callable | None) -> list[tuple]:
    """Links (node, least node of its group) among ``first``, or between ``first`` and ``second``.

    Members are (fingerprint, node, content); ``alike`` tells whether two contents are to be linked. A
    group of linked members becomes a star, never all its pairs.
    """
    tree, up = BKTree(), {}

    def top(x):
        while (y := up.setdefault(x, x)) != x:
            up[x] = up[y]
            x = y
        return x

    def visit(value: int, node, own: bytes) -> None:
        mine = top(node)
        for _, (other, theirs) in tree.within(value, radius):
            root = top(other)
            if root != mine and (alike is None or alike(own, theirs)):
                low, high = min(root, mine), max(root, mine)
                up[high] = mine = low

    for value, node, own in first:
        if second is None:
            visit(value, node, own)
        tree.add(value, (node, own))
    for value, node, own in second or []:
        visit(value, node, own)
    return [(x, r) for x in list(up) if (r := top(x)) != x]


def fingerprints(docs: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = 3, banded: bool = False) -> DataFrame:
    """``doc_id``, ``row_key`` and ``fp`` (64 bits as a long) of every row; with ``banded`` also
    ``bands`` and ``node``, a 128-bit digest of the set of shingles, and ``fp`` is that of the set, as
    similarity does not count repeats. Null and word-less texts have the fingerprint 0."""
    size = shingle

    def work(batch: pa.RecordBatch) -> dict:
        hashes = [shingle_hashes(t, size) for t in texts_of(batch)]
        if banded:
            hashes = [np.unique(h) for h in hashes]
        marks = np.array([fingerprint(h) for h in hashes], "u8").view("i8")
        out = {"doc_id": batch.column("doc_id"), "row_key": batch.column("row_key"), "fp": marks}
        if banded:
            out["bands"] = pa.array([bands(h) for h in hashes], pa.list_(pa.int64()))
            out["node"] = pa.array([xxhash.xxh128_digest(h.tobytes(), SEED) for h in hashes], pa.binary())
        return out

    rows = keyed(docs, id, text)
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, row_key long, fp long"
    return mapped(rows, work, schema + (", bands array<long>, node binary" if banded else ""))


def block_keys(radius: int) -> Callable:
    """Shard keys of a fingerprint: of radius + 2 blocks of bits, two at least are equal within the radius."""
    edges = np.linspace(0, 64, radius + 3).astype(int).tolist()
    masks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]
    pairs = [masks[i] | masks[j] for i, j in combinations(range(len(masks)), 2)]
    signed = [m - 2**64 if m >= 2**63 else m for m in pairs]
    return lambda fp: F.array(*(F.xxhash64(fp.bitwiseAND(F.lit(m)), F.lit(i)) for i, m in enumerate(signed)))


def contents(docs: DataFrame, rows: DataFrame, wanted: DataFrame, shingle: int, make: Callable[[np.ndarray], bytes]) -> DataFrame:
    """``node`` and ``content``, made of the shingle hashes, of the wanted nodes, from one row of ``docs`` (``keyed``) each."""
    one = pinned(rows.join(wanted, "node").groupBy("node").agg(F.min("row_key").alias("row_key")))

    def work(batch: pa.RecordBatch) -> dict:
        return {"row_key": batch.column("row_key"), "content": pa.array([make(shingle_hashes(t, shingle)) for t in texts_of(batch)], pa.binary())}

    made = mapped(narrowed(docs, one), work, "row_key long, content binary")
    return made.join(one, "row_key").dropDuplicates(["node"]).select("node", "content")


def links(nodes: DataFrame, keys, radius: int, alike: Callable | None = None, block: int = BLOCK,
          content_of: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Stars of nodes within ``radius`` that share a shard key. A node is a fingerprint, or, with
    ``alike``, a set of shingles with a fingerprint, and ``alike`` judges the contents of two.

    A shard of more than ``block`` nodes is split into blocks; every block's tree meets every
    other block of the shard as queries, so a hot shard becomes many groups of bounded size. A tree
    is given to the queries of its own shard only, since all trees together grow with the corpus.
    Contents are made for those nodes alone that share a shard with another one.
    """
    name, kind = ("fp", pa.int64()) if alike is None else ("node", pa.binary())
    columns = ["fp"] if alike is None else ["fp", "node"]
    shards = nodes.select(*columns, F.explode(keys).alias("shard"))
    sizes = shards.groupBy("shard").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    parts = F.ceil(F.col("members") / block).cast("int")
    own = F.pmod(F.xxhash64(F.col(name), F.lit(7)), F.col("parts")).cast("int")
    shared = pinned(shards.join(sizes, "shard").withColumn("parts", parts).withColumn("own", own).drop("members"))
    if alike is not None:
        shared = shared.join(content_of(shared.select("node").distinct()), "node")
        columns = [*columns, "content"]
    met = shared.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        "shard", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", *columns)
    order = ["shard", "low", "high"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple] = []
        for group in runs_of_groups(batches, order):
            low, high = group.column("low")[0].as_py(), group.column("high")[0].as_py()
            marks = group.column("fp").to_numpy().view("u8").tolist()
            names = group.column("node").to_pylist() if alike else group.column("fp").to_pylist()
            members = sorted(zip(marks, names, group.column("content").to_pylist() if alike else [None] * len(marks)))
            if low == high:
                found += stars(members, None, radius, alike)
            else:
                mine = dict(zip(names, group.column("own").to_pylist()))
                found += stars([m for m in members if mine[m[1]] == low], [m for m in members if mine[m[1]] == high], radius, alike)
            if len(found) > 50_000:
                yield _pairs(found, kind)
                found = []
        yield _pairs(found, kind)

    return met.repartition(*order).sortWithinPartitions(*order).mapInArrow(tidy(run), "a long, b long" if alike is None else "a binary, b binary")


def _pairs(found: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], kind) for i in (0, 1)], ["a", "b"])


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = 3, radius: int = 2,
                    likeness: float | None = None) -> DataFrame:
    """``doc_id``, ``row_key``, ``fp`` and ``component_id`` of every row of ``docs``.

    Documents are linked if their fingerprints differ in ``radius`` bits at most, and, with
    ``likeness``, if the Jaccard similarity of their sets of shingles is as much at least. A component
    is named by its smallest id.

    Without ``likeness`` the shards are pairs of equal bit blocks, which lose no link. A radius that
    suits a Jaccard similarity of 0.8 is too wide for that, so with ``likeness`` the shards are ten
    bands of three minimum hashes (a pair of 0.8 is missed with probability 0.001). Sketches of pairs within
    the radius make groups that are alike in ``likeness`` less ``MARGIN``, and inside these groups the sets of
    shingles themselves decide. Texts with one set of shingles are one node then; texts
    that share the fingerprint alone are judged like any other two.

    Null texts and texts without words share the fingerprint 0 and one component; rows repeated in
    full, or only by text, share a fingerprint. Null ids take part and never name a component
    unless no other id does. An empty table gives no rows.
    """
    return _classed(docs, id, text, shingle, radius, likeness).drop("root")


def _classed(docs: DataFrame, id: str, text: str, shingle: int, radius: int, likeness: float | None) -> DataFrame:
    """``near_duplicates`` with ``root``, which tells components apart where their smallest ids are the same."""
    banded = likeness is not None
    node = "node" if banded else "fp"
    rows = stored(fingerprints(docs, id, text, shingle, banded), "fingerprints")
    firsts = [F.first("fp").alias("fp"), F.first("bands").alias("bands")] if banded else []  # a set's are all the same
    nodes = pinned(rows.groupBy(node).agg(F.min("doc_id").alias("least_id"), *firsts))
    if banded:
        def made(make: Callable) -> Callable:
            return lambda wanted: contents(keyed(docs, id, text), rows, wanted, shingle, make)

        loose = pinned(components(links(nodes, F.col("bands"), radius, lambda a, b: similar(a, b) >= likeness - MARGIN, content_of=made(sketch))))
        groups = nodes.select("fp", "node").join(loose, "node")
        roots = components(links(groups, F.array("root"), radius, lambda a, b: jaccard(a, b) >= likeness, SETS, made(lambda hashes: np.unique(hashes).tobytes())))
    else:
        roots = components(links(nodes, block_keys(radius)(F.col("fp")), radius))
    named = nodes.select(node, "least_id").join(roots.select(F.col("node").alias(node), "root"), node, "left").select(
        node, "least_id", F.coalesce("root", node).alias("root"))
    named = pinned(named)
    ids = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
    classes = named.select(node, "root").join(ids, "root").select(node, "component_id", "root")
    return rows.select("doc_id", "row_key", *dict.fromkeys(["fp", node])).join(classes, node).select("doc_id", "row_key", "fp", "component_id", "root")


def keep_one(docs: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = 5, radius: int = 26,
             likeness: float | None = 0.8) -> DataFrame:
    """One row of ``docs`` for each component: the smallest id, in the columns of ``docs``.

    Rows with a null id come last; of rows repeated in full one stays.
    """
    found = _classed(docs, id, text, shingle, radius, likeness)
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key")
    chosen = found.groupBy("root").agg(F.min(rank).alias("first")).select("first.doc_id", "first.row_key")
    # A row is chosen once, but may stand in the table several times.
    chosen = pinned(chosen)
    counted = found.groupBy("doc_id", "row_key").agg(F.count(F.lit(1)).alias("n"))
    judged = counted.join(chosen.withColumnsRenamed({"doc_id": "of_id", "row_key": "of_key"}), F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("row_key") == F.col("of_key")), "left")
    # Most rows stay: only those that may go, or stand there several times, are looked up by a shuffle.
    doubtful = stored(judged.select("doc_id", "row_key", F.col("of_key").isNotNull().alias("stays"), (F.col("n") > 1).alias("many")).filter("not stays or many"), "doubtful")
    key = F.xxhash64(F.col(id).cast("string"), F.lit("|"), text)
    wrapped = docs.select(F.struct("*").alias("__row"), F.col(id).alias("__id"), key.alias("row_key"))
    sure = narrowed(wrapped, doubtful, inside=False).select("__row.*")
    marks = doubtful.select(F.struct("doc_id", "row_key", "stays", "many").alias("__mark"))
    rest = narrowed(wrapped, doubtful).join(marks, F.col("__id").eqNullSafe(F.col("__mark.doc_id")) & (F.col("row_key") == F.col("__mark.row_key")), "left")
    single = rest.filter("__mark is null").select("__row.*")
    twice = rest.filter("__mark.stays and __mark.many").dropDuplicates(["__id", "row_key"]).select("__row.*")
    return sure.unionByName(single).unionByName(twice)
