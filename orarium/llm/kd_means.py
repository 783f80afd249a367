"""Nearest-centroid rounds over integer vectors by kd-tree filtering.

Each task cuts the vectors it reads into trees of up to `CHUNK`, which are written once. A node holds its vectors' count,
integer sums and bounding box. A round sends the centroids down every tree: of a node's candidates the one nearest the
box's middle stays, and any other that is farther than it at the box's corner most in its favour is farther for every
vector inside, so it is dropped; a tie there keeps it. A node with one candidate left is assigned whole by its count and
sums; a leaf with several is resolved vector by vector. Integers only, so sums don't depend on order. What leaves a task
is a count and the sums of each centroid; nothing is shuffled by cluster, so a cluster of any size is no hot group.

Defined results: a vector that is null, has not exactly `size` components, or has a null, NaN or infinite one is left
out, as is one with a component of 2^20 or more in size, whose squared distances need not fit a long. A kept row without an
id is assigned like others but is no starting centroid; of equal ids the smaller vector comes first. Repeated rows are
repeated; with fewer vectors than centroids there are as many centroids as vectors; further columns are ignored; an empty
table gives no rows. An inertia that exceeds a long is null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orarium.llm.common import arrow_map, batch, pick, written

SIZE, SCALE, CENTROIDS, ROUNDS = 64, 64, 16, 3
#: Vectors of a tree and of a leaf; bound of a component before it is scaled.
CHUNK, LEAF, BOUND = 8192, 32, 1 << 20
TREE = {"ids": pa.list_(pa.int64()), "points": pa.binary(), "nodes": pa.binary(), "low": pa.binary(), "high": pa.binary(), "sums": pa.binary()}


class Tree:
    """A kd-tree over rows in an order in which each node is a range; nodes: begin, end, left, right (-1: a leaf)."""

    def __init__(self, points: np.ndarray, nodes: np.ndarray, low: np.ndarray, high: np.ndarray, sums: np.ndarray):
        self.points, self.nodes, self.low, self.high, self.sums = points, nodes, low, high, sums

    @classmethod
    def built(cls, points: np.ndarray) -> tuple[Tree, np.ndarray]:
        """The tree, and the order of the rows in it."""
        order, nodes, low, high, sums = np.arange(len(points)), [[0, len(points), -1, -1]], [], [], []
        for node in nodes:
            begin, end = node[:2]
            own = points[order[begin:end]]
            low.append(own.min(axis=0))
            high.append(own.max(axis=0))
            sums.append(own.sum(axis=0))
            wide = int(np.argmax(high[-1] - low[-1]))
            if end - begin > LEAF and high[-1][wide] > low[-1][wide]:
                middle = (end - begin) // 2
                order[begin:end] = order[begin:end][np.argpartition(own[:, wide], middle)]
                node[2:] = len(nodes), len(nodes) + 1
                nodes += [[begin, begin + middle, -1, -1], [begin + middle, end, -1, -1]]
        return cls(points[order], np.array(nodes), np.array(low), np.array(high), np.array(sums)), order

    def assigned(self, centroids: np.ndarray) -> Iterator[tuple[int, int, int, np.ndarray | int]]:
        """node, begin, end and the centroid of whole nodes, or the centroids of a leaf's rows."""
        stack = [(0, np.arange(len(centroids)))]
        while stack:
            node, near = stack.pop()
            begin, end, left, right = self.nodes[node].tolist()
            if len(near) > 1:
                near = self.undominated(node, near, centroids)
            if len(near) == 1:
                yield node, begin, end, int(near[0])
            elif left < 0:
                yield node, begin, end, near[np.argmin(distances(self.points[begin:end], centroids[near]), axis=1)]
            else:
                stack += [(left, near), (right, near)]

    def undominated(self, node: int, near: np.ndarray, centroids: np.ndarray) -> np.ndarray:
        low, high, c = self.low[node], self.high[node], centroids[near]
        best = c[np.argmin(((2 * c - (low + high)) ** 2).sum(axis=1))]
        corner = np.where(c > best, high, low)
        return near[((c - corner) ** 2).sum(axis=1) <= ((best - corner) ** 2).sum(axis=1)]


def distances(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return (points**2).sum(axis=1)[:, None] - 2 * (points @ centroids.T) + (centroids**2).sum(axis=1)


def trees(vectors: DataFrame) -> DataFrame:
    """vec_id, v -> rows of TREE, each of up to CHUNK vectors of one partition."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, rows, held = [], [], 0

        def flush() -> pa.RecordBatch:
            tree, order = Tree.built(np.concatenate(rows))
            row = [pa.concat_arrays(ids).take(pa.array(order)).to_pylist(), tree.points.astype(np.int32).tobytes(), tree.nodes.astype(np.int32).tobytes(), tree.low.astype(np.int32).tobytes(), tree.high.astype(np.int32).tobytes(), tree.sums.astype(np.int64).tobytes()]
            ids.clear()
            rows.clear()
            return batch(TREE, *([x] for x in row))

        for b in batches:
            for at in range(0, b.num_rows, CHUNK):
                part = b.slice(at, CHUNK)
                if held + part.num_rows > CHUNK:
                    yield flush()
                    held = 0
                if part.num_rows:
                    ids.append(part.column("vec_id"))
                    rows.append(part.column("v").flatten().to_numpy().astype(np.int64).reshape(part.num_rows, -1))
                    held += part.num_rows
        if held:
            yield flush()

    return arrow_map(vectors, build, "ids array<long>, points binary, nodes binary, low binary, high binary, sums binary")


def read_trees(b: pa.RecordBatch, size: int) -> Iterator[tuple[pa.Array, Tree]]:
    for row in range(b.num_rows):
        of = lambda name, kind, width: np.frombuffer(b.column(name)[row].as_py(), kind).astype(np.int64).reshape(-1, width)  # noqa: B023, E731
        yield b.column("ids")[row].values, Tree(of("points", np.int32, size), of("nodes", np.int32, 4), of("low", np.int32, size), of("high", np.int32, size), of("sums", np.int64, size))


def moved(forest: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: floors of the means; one without vectors stays."""
    k, size = centroids.shape

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros(k, np.int64), np.zeros((k, size), np.int64)
        for b in batches:
            for _, tree in read_trees(b, size):
                for node, begin, end, to in tree.assigned(centroids):
                    if isinstance(to, int):
                        counts[to] += end - begin
                        sums[to] += tree.sums[node]
                    else:
                        np.add.at(counts, to, 1)
                        np.add.at(sums, to, tree.points[begin:end])
        yield batch({"cluster": pa.int32(), "sums": pa.list_(pa.int64())}, np.arange(k, dtype=np.int32).tolist(), np.column_stack([counts, sums]).tolist())

    parts = arrow_map(forest, gather, "cluster int, sums array<long>").select("cluster", F.posexplode("sums").alias("d", "x"))
    found = parts.groupBy("cluster", "d").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect()
    total = {(r.cluster, r.d): int(r.x) for r in found}
    out = centroids.copy()
    for c in range(k):
        if n := total.get((c, 0), 0):
            out[c] = [total[c, d + 1] // n for d in range(size)]
    return out


def kept_vectors(vectors: DataFrame, id_col: str, vector_col: str, size: int, scale: int) -> DataFrame:
    """vec_id and v (integers) of the vectors that are whole and finite."""
    whole = (F.size("x") == size) & F.forall("x", lambda x: x.isNotNull() & (F.abs(x.cast("double")) < BOUND))
    return pick(vectors, vec_id=id_col, x=vector_col).where(whole).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("x", lambda x: F.floor(x.cast("double") * scale).cast("int")).alias("v"))


def starting(vectors: DataFrame, count: int) -> np.ndarray:
    """The vectors whose ids have the smallest hashes, in their order."""
    h = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256)
    first = vectors.where("vec_id IS NOT NULL").select(h.alias("h"), "v").orderBy("h", "v").limit(count).collect()
    return np.array([r.v for r in first], np.int64)


def kd_means(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", size: int = SIZE, scale: int = SCALE, count: int = CENTROIDS, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every vector kept."""
    kept = kept_vectors(vectors, id_col, vector_col, size, scale)
    centroids = starting(kept, count)
    if not len(centroids):
        centroids = np.zeros((1, size), np.int64)  # no vector has an id: one centroid at zero
    forest = written(trees(kept), "kd-trees")
    for _ in range(rounds):
        centroids = moved(forest, centroids)
    types = {"vec_id": pa.int64(), "cluster": pa.int32(), "distance": pa.int64()}

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, tree in read_trees(b, size):
                to = np.zeros(len(tree.points), np.int32)
                for _, begin, end, own in tree.assigned(centroids):
                    to[begin:end] = own
                yield batch(types, ids, pa.array(to), pa.array(((tree.points - centroids[to]) ** 2).sum(axis=1)))

    found = written(arrow_map(forest, assign, "vec_id long, cluster int, distance long"), "assigned")
    each = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()
    whole, fits = sum((r.s for r in each), Decimal(0)), lambda s: int(s) if s < 1 << 63 else None
    digest = lambda c: hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()
    rows = [(r.cluster, fits(r.s), fits(whole), digest(r.cluster)) for r in each]
    about = found.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
