"""Approximate nearest neighbours: a forest of random-projection trees with one queue for all trees."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larder.functions.pin import pinned
from larder.llm.batches import runs_of_groups, tidy

TREES, LEAF, SAMPLE = 8, 64, 65_536  # trees, sample rows in a leaf, rows to fit on
SHARE = 0.15  # of all leaves, how many a query visits, however many rows there are
LEAST = 256  # leaves that a query visits in any case
PRUNED = 200_000  # rows a task gathers before it keeps the best of each query only
CHUNK = 4096  # rows compared at once; a fuller leaf is many chunks
DEPTH = 24
SEED = 11


class Forest:
    """Planes, thresholds and children of all trees in one array each; a leaf is a negative child."""

    def __init__(self, sample: np.ndarray, trees: int, leaf: int):
        rng = np.random.default_rng(SEED)
        planes, limits, below = [], [], []
        self.leaves, self.roots = 0, []
        width = sample.shape[1]

        def grow(rows: np.ndarray, depth: int) -> int:
            if len(rows) > leaf and depth < DEPTH:
                plane = rng.standard_normal(width)
                plane = (plane / np.linalg.norm(plane)).astype("f4")
                side = sample[rows] @ plane
                limit = np.median(side)
                left, right = rows[side < limit], rows[side >= limit]
                if len(left):  # else all lie on one side, as equal rows do
                    at = len(planes)
                    planes.append(plane), limits.append(limit), below.append([0, 0])
                    below[at] = [grow(left, depth + 1), grow(right, depth + 1)]
                    return at
            self.leaves += 1
            return -self.leaves

        for _ in range(trees):
            self.roots.append(grow(np.arange(len(sample)), 0))
        self.planes = np.array(planes, "f4").reshape(-1, width)
        self.limits, self.below = np.array(limits, "f4"), np.array(below, "i4").reshape(-1, 2)

    @classmethod
    def frozen(cls, tables: dict) -> Forest:
        out = cls.__new__(cls)
        out.__dict__.update(tables)
        return out

    def place(self, rows: np.ndarray) -> np.ndarray:
        """Leaf of each row in each tree."""
        out = np.zeros((len(rows), len(self.roots)), "i4")
        for t, root in enumerate(self.roots):
            node = np.full(len(rows), root, "i4")
            while (inner := np.flatnonzero(node >= 0)).size:
                at = node[inner]
                side = np.einsum("ij,ij->i", rows[inner], self.planes[at]) >= self.limits[at]
                node[inner] = self.below[at, side.astype("i4")]
            out[:, t] = -node - 1
        return out

    def search(self, query: np.ndarray, sizes: np.ndarray, visits: int, least: int) -> list[int]:
        """Leaves by one queue over all trees: the distance to the farthest plane crossed comes first.

        Goes on beyond ``visits`` until the leaves hold ``least`` rows in every case.
        """
        sides = self.planes @ query - self.limits
        queue = [(0.0, root) for root in self.roots]
        heapq.heapify(queue)
        found, rows = [], 0
        while queue and (len(found) < visits or rows < least * len(self.roots)):
            far, node = heapq.heappop(queue)
            if node < 0:
                found.append(-node - 1)
                rows += int(sizes[-node - 1])
                continue
            side = float(sides[node])
            near = self.below[node, int(side >= 0)]
            heapq.heappush(queue, (far, int(near)))
            heapq.heappush(queue, (max(far, abs(side)), int(self.below[node, int(side < 0)])))
        return found


def usable(rows: DataFrame, id: str, vector: str) -> DataFrame:
    """``vec_id`` and ``v`` of the vectors that take part: not null, not zero, no null or non-finite
    component, and as long as most are."""
    v = F.col(vector).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = rows.select(F.col(id).alias("vec_id"), v.alias("v"), bad.alias("bad")).filter(
        "vec_id is not null and v is not null and not bad").filter(F.exists("v", lambda x: x != 0)).select("vec_id", "v")
    lengths = good.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return good.filter(F.size("v") == (lengths[0]["n"] if lengths else 0))


def nearest(rows: DataFrame, id: str = "vec_id", vector: str = "embedding", every: int = 100, k: int = 10, trees: int = TREES,
            leaf: int = LEAF, sample: int = SAMPLE, share: float = SHARE) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id`` and ``score`` (Euclidean distance) of the ``k`` nearest rows found.

    Queries are the rows whose id is divisible by ``every``; every row is indexed. The planes are
    fitted on about ``sample`` rows, chosen by the hash of their id, and on all if there are fewer. A
    query visits ``share`` of the forest's leaves whatever the number of rows (``LEAST`` leaves at least), nearest
    first over all trees, and every row in them is measured on its original vector. Recall rises with ``share``,
    and falls if the share falls with the number of rows; the README has figures.

    A leaf with more than ``CHUNK`` rows (equal vectors share their leaves) is split into chunks that
    are searched in separate groups and give ``k`` rows a query each. Rows repeated in full count once; ids without a
    vector that takes part (see ``usable``) appear nowhere; an empty table gives no rows.
    """
    good = pinned(usable(rows, id, vector))
    total = good.count()
    spread = 1 << 20
    some = good.filter(F.pmod(F.xxhash64("vec_id"), F.lit(spread)) < min(spread, -(-sample * spread // max(total, 1)))).select("vec_id", "v")
    fitted = np.array([r["v"] for r in some.orderBy("vec_id").collect()], "f4")  # bounded by ``sample``
    if not len(fitted):
        return good.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score")).limit(0)
    forest = Forest(fitted, trees, leaf)
    context = good.sparkSession.sparkContext
    shared = context.broadcast(vars(forest))  # bounded by the sample
    kind = good.schema["vec_id"].dataType.simpleString()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Forest.frozen(shared.value)
        for batch in batches:
            if batch.num_rows:
                leaves = own.place(_matrix(batch.column("v")).astype("f4"))
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(leaves.tolist(), pa.list_(pa.int32()))], ["vec_id", "v", "leaves"])

    placed = pinned(good.mapInArrow(tidy(place), f"vec_id {kind}, v array<double>, leaves array<int>"))
    counted = placed.select(F.explode("leaves").alias("leaf")).groupBy("leaf").count().collect()  # one row a leaf at most
    sizes = np.zeros(forest.leaves, "i8")
    for row in counted:
        sizes[row["leaf"]] = row["count"]
    held = context.broadcast(sizes)
    visits = max(LEAST, int(np.ceil(share * forest.leaves)))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, counts = Forest.frozen(shared.value), held.value
        for batch in batches:
            for i, query in enumerate(_matrix(batch.column("v")).astype("f4")):
                leaf_ids, chunks = [], []
                for at in own.search(query, counts, visits, k + 1):
                    n = max(1, -(-int(counts[at]) // CHUNK))
                    leaf_ids += [at] * n
                    chunks += range(n)
                n = len(leaf_ids)
                one = batch.slice(i, 1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(leaf_ids, pa.int32()), pa.array(chunks, pa.int32()), pa.array([True] * n), pa.concat_arrays([one.column("vec_id")] * n) if n else one.column("vec_id").slice(0, 0),
                     pa.concat_arrays([one.column("v")] * n) if n else one.column("v").slice(0, 0)], ["leaf", "chunk", "asks", "vec_id", "v"])

    shape = f"leaf int, chunk int, asks boolean, vec_id {kind}, v array<double>"
    asked = good.filter(F.col("vec_id") % every == 0).mapInArrow(tidy(search), shape)
    fuller = F.broadcast(_chunks_of(good.sparkSession, sizes))
    spread_rows = placed.select("vec_id", "v", F.explode("leaves").alias("leaf")).join(fuller, "leaf", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    held_rows = spread_rows.select("leaf", F.pmod(F.xxhash64("vec_id", F.lit(5)), F.col("parts")).cast("int").alias("chunk"), F.lit(False).alias("asks"), "vec_id", "v")
    order = ["leaf", "chunk"]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, rows = [], 0
        for group in runs_of_groups(batches, order):
            asks = group.column("asks").to_numpy()
            if asks.all() or not asks.any():
                continue
            names = group.column("vec_id").to_numpy()
            vectors = _matrix(group.column("v").combine_chunks())
            base, base_names = vectors[~asks], names[~asks]
            by_name = np.argsort(base_names, kind="stable")
            base, base_names = base[by_name], base_names[by_name]
            for q in np.flatnonzero(asks):
                gaps = np.sqrt(((base - vectors[q]) ** 2).sum(1))
                gaps[base_names == names[q]] = np.inf
                # Rows stand by id, so a stable order keeps smaller ids first among equal distances.
                best = np.argsort(gaps, kind="stable")[:k] if len(gaps) <= 4 * k else _first(gaps, k)
                best = best[np.isfinite(gaps[best])]
                parts.append((np.full(len(best), names[q]), base_names[best], gaps[best]))
                rows += len(best)
            if rows > PRUNED:
                parts = [_best(parts, k)]
                rows = len(parts[0][0])
                if rows > PRUNED // 2:  # many queries: what was found so far goes on as it is
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in parts[0]], ["query_id", "vec_id", "score"])
                    parts, rows = [], 0
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in _best(parts, k)], ["query_id", "vec_id", "score"])

    both = held_rows.unionByName(asked).repartition(*order).sortWithinPartitions(*order)
    found = both.mapInArrow(tidy(measure), f"query_id {kind}, vec_id {kind}, score double").groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.select("query_id", rank.alias("rank"), "vec_id", "score").filter(F.col("rank") <= k)


def _chunks_of(session: SparkSession, sizes: np.ndarray) -> DataFrame:
    """Leaves with more than one chunk; no more rows than leaves."""
    many = [(int(i), int(-(-n // CHUNK))) for i, n in enumerate(sizes) if n > CHUNK]
    return session.createDataFrame(many, "leaf int, parts int")


def _first(gaps: np.ndarray, k: int) -> np.ndarray:
    """Places of the k least, in order, the first ones among equals."""
    some = np.flatnonzero(gaps <= np.partition(gaps, k - 1)[k - 1])
    return some[np.argsort(gaps[some], kind="stable")][:k]


def _best(parts: list[tuple], k: int) -> tuple[np.ndarray, ...]:
    """The k nearest rows of each query; one found in several trees counts once."""
    query, vec, gap = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((vec, gap, query))
    query, vec, gap = query[order], vec[order], gap[order]
    fresh = np.r_[True, (query[1:] != query[:-1]) | (vec[1:] != vec[:-1])]  # the same row has the same distance
    query, vec, gap = query[fresh], vec[fresh], gap[fresh]
    head = np.flatnonzero(np.r_[True, query[1:] != query[:-1]])
    place = np.arange(len(query)) - np.repeat(head, np.diff(np.r_[head, len(query)]))
    return query[place < k], vec[place < k], gap[place < k]


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)
