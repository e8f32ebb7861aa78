"""Exact k-means in whole numbers, with kd-trees that filter the centroids.

The vectors of a partition are put into kd-trees once. A node holds how many vectors it has, their sum, the sum of their
squares and their box. A round goes down each tree with the centroids: one that is farther than another from every point
of a node's box is struck out below it; a node with one centroid left gives it all its vectors at once, by count and
sum; at a leaf with several, each vector is compared with them. What a round gathers is a count and a sum for each
centroid, added up before it is shuffled.
"""

from __future__ import annotations

import hashlib
from decimal import Decimal
from io import BytesIO

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import written

#: Vectors of a tree and of a leaf at most.
TREE_VECTORS, LEAF_VECTORS = 8192, 32
#: Components stay within this, far beyond where a distance is a long.
LARGEST = 1 << 44
LONG = (1 << 63) - 1
#: Places of a sum's rows that aren't components.
COUNT, SQUARES = -1, -2


def whole(column, dims: int, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors of an Arrow list column take part, and their components as whole numbers."""
    import pyarrow.compute as pc

    fits = pc.fill_null(pc.equal(pc.list_value_length(column), dims), False).to_numpy(zero_copy_only=False)
    flat = pc.list_flatten(column.filter(fits)).to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)  # null components become NaN
    finite = np.isfinite(flat).all(axis=1)
    fits[np.flatnonzero(fits)] = finite
    with np.errstate(over="ignore"):
        return fits, np.clip(np.floor(flat[finite] * scale), -LARGEST, LARGEST).astype(np.int64)


def narrow(dims: int) -> int:
    """Components below this: doubles hold every sum that is compared, and longs every sum of a tree."""
    return int((2**48 / max(dims, 1)) ** 0.5)


class Tree:
    """Vectors in the order of the leaves, and nodes: first and after last vector, first child (0: a leaf), box, sums."""

    FIELDS = ("points", "begin", "end", "child", "low", "high", "sums", "squares")

    def __init__(self, **arrays: np.ndarray):
        self.__dict__.update(arrays)

    @classmethod
    def of(cls, points: np.ndarray) -> tuple[Tree, np.ndarray]:
        """The tree and the vectors' order: nodes are halved where their box is widest."""
        order, spans, child = np.arange(len(points)), [(0, len(points))], [0]
        for node, (a, b) in enumerate(spans):  # grows while it is read
            if b - a > LEAF_VECTORS:
                mine = points[order[a:b]]
                widest = (mine.max(0).astype(np.float64) - mine.min(0)).argmax()
                mid = (a + b) // 2
                order[a:b] = order[a:b][np.argpartition(mine[:, widest], mid - a)]
                child[node] = len(spans)
                spans += [(a, mid), (mid, b)]
                child += [0, 0]
        begin, end = np.array(spans).T
        placed = points[order]
        low, high = (np.array([f(placed[a:b], 0) for a, b in spans]) for f in (np.min, np.max))
        exact = placed if np.abs(placed).max() < narrow(points.shape[1]) else placed.astype(object)
        sums = np.array([exact[a:b].sum(0) for a, b in spans])
        squares = np.array([(exact[a:b] ** 2).sum() for a, b in spans])
        return cls(points=placed, begin=begin, end=end, child=np.array(child), low=low, high=high, sums=sums, squares=squares), order

    def packed(self) -> bytes:
        """Small whole numbers as four bytes; what doesn't fit eight (sums of very large components) as text."""

        def small(x: np.ndarray) -> np.ndarray:
            if x.dtype == object:
                return x.astype(str)
            return x.astype(np.int32) if np.abs(x).max() < 1 << 31 else x

        out = BytesIO()
        np.savez(out, **{name: small(getattr(self, name)) for name in self.FIELDS})
        return out.getvalue()

    @classmethod
    def unpacked(cls, data: bytes) -> Tree:
        with np.load(BytesIO(data)) as held:
            return cls(**{name: np.vectorize(int, otypes=[object])(held[name]) if held[name].dtype.kind == "U" else held[name].astype(np.int64) for name in cls.FIELDS})

    def visits(self, centroids: np.ndarray):
        """(nodes, centroid) of vectors that go to one centroid as a whole; then (vectors' places, their centroids)."""
        wide = max(np.abs(self.low).max(), np.abs(self.high).max(), np.abs(centroids).max()) >= narrow(centroids.shape[1])
        kind = object if wide else np.float64
        z = centroids.astype(kind)
        far = (z * z).sum(1)
        nodes, left = np.zeros(1, np.int64), np.ones((1, len(z)), bool)
        while len(nodes):
            low, high = self.low[nodes].astype(kind), self.high[nodes].astype(kind)
            # The candidate nearest to the middle of the box: |z|^2 - 2 z m, where 2 m = low + high.
            to_mid = np.where(left, far - (low + high) @ z.T, np.inf)
            star = to_mid.argmin(1)
            for s in np.unique(star).tolist():
                rows = np.flatnonzero(star == s)
                # How much nearer another one can be than s: at the corner of the box that lies farthest its way.
                way = z - z[s]
                reach = high[rows] @ np.maximum(way, 0).T + low[rows] @ np.minimum(way, 0).T
                left[rows] &= ~((far - far[s])[None, :] - 2 * reach > 0).astype(bool)
            alone = left.sum(1) == 1
            for s in np.unique(star[alone]).tolist():
                yield nodes[alone & (star == s)], s
            leaf = ~alone & (self.child[nodes] == 0)
            for node, mine in zip(nodes[leaf].tolist(), left[leaf], strict=True):
                a, b = self.begin[node], self.end[node]
                some = np.flatnonzero(mine)
                near = (far[some] - 2 * (self.points[a:b].astype(kind) @ z[some].T)).argmin(1)  # of equal ones the first
                yield np.arange(a, b), some[near]
            inner = ~alone & ~leaf
            first = self.child[nodes[inner]]
            nodes, left = np.concatenate([first, first + 1]), np.concatenate([left[inner], left[inner]])

    def gathered(self, centroids: np.ndarray) -> list[list[int]]:
        """For each centroid the count, the sum of squares and the sum of each component of its vectors."""
        k, dims = centroids.shape
        total = np.zeros((k, dims + 2), object)
        for at, owner in self.visits(centroids):
            if isinstance(owner, int):  # whole nodes
                total[owner, 0] += int((self.end[at] - self.begin[at]).sum())
                total[owner, 1] += sum(map(int, self.squares[at]))
                total[owner, 2:] += _exact(self.sums[at])
            else:
                mine = self.points[at]
                for s in np.unique(owner).tolist():
                    rows = mine[owner == s]
                    total[s, 0] += len(rows)
                    total[s, 1] += int((rows.astype(object) ** 2).sum()) if np.abs(rows).max() >= narrow(dims) else int((rows * rows).sum())
                    total[s, 2:] += _exact(rows)
        return total.tolist()

    def assigned(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Centroid and squared distance of each vector, in the tree's order."""
        owner = np.empty(len(self.points), np.int64)
        for at, to in self.visits(centroids):
            if isinstance(to, int):
                for a, b in zip(self.begin[at].tolist(), self.end[at].tolist(), strict=True):
                    owner[a:b] = to
            else:
                owner[at] = to
        wide = max(np.abs(self.points).max(), np.abs(centroids).max()) >= 1 << 24
        off = self.points.astype(object if wide else np.int64) - centroids.astype(object if wide else np.int64)[owner]
        return owner, (off * off).sum(1)


def _exact(rows: np.ndarray) -> np.ndarray:
    """Sums of columns as Python's whole numbers; 8192 numbers below 2^49 can't overflow."""
    if rows.dtype != object and np.abs(rows).max() >= 1 << 49:
        rows = rows.astype(object)
    return rows.sum(0).astype(object)


def trees(vectors: DataFrame, *, dims: int, scale: float, id_col: str, vector_col: str) -> DataFrame:
    """ids, tree: one row for each kd-tree, over the vectors that take part."""
    id_type = vectors.schema[id_col].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        def made(ids, points):
            tree, order = Tree.of(points)
            values = ids.take(pa.array(order))
            held = pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
            return pa.RecordBatch.from_arrays([held, pa.array([tree.packed()], pa.binary())], names=["ids", "tree"])

        waiting, n = [], 0
        for batch in batches:
            fits, points = whole(batch.column(1), dims, scale)
            ids = batch.column(0).filter(pa.array(fits))
            for at in range(0, len(points), TREE_VECTORS):
                waiting.append((ids[at : at + TREE_VECTORS], points[at : at + TREE_VECTORS]))
                n += len(waiting[-1][1])
                if n >= TREE_VECTORS:
                    joined, points_of = pa.concat_arrays([i for i, _ in waiting]), np.concatenate([p for _, p in waiting])
                    yield made(joined[:TREE_VECTORS], points_of[:TREE_VECTORS])
                    waiting = [(joined[TREE_VECTORS:], points_of[TREE_VECTORS:])]
                    n -= TREE_VECTORS
        if n:
            yield made(pa.concat_arrays([i for i, _ in waiting]), np.concatenate([p for _, p in waiting]))

    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    return written(rows.mapInArrow(run, f"ids array<{id_type}>, tree binary"), "trees")


def first_centroids(vectors: DataFrame, k: int, *, seed: int, dims: int, scale: float, id_col: str, vector_col: str) -> np.ndarray:
    """The ``k`` vectors of the smallest hashes of their ids, as whole numbers; rows of a null id have no hash."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            fits, points = whole(batch.column(1), dims, scale)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, points.size + 1, dims), pa.int32()), pa.array(points.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(fits)), flat], names=["hash", "v"])

    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")), 256).alias("hash")
    rows = vectors.where(F.col(id_col).isNotNull()).select(hashed, F.col(vector_col).cast("array<double>").alias("v"))
    first = rows.mapInArrow(run, "hash string, v array<long>").orderBy("hash", "v").limit(k).collect()  # k rows
    return np.array([r["v"] for r in first], np.int64).reshape(-1, dims)


def summed(held: DataFrame, centroids: np.ndarray) -> dict[tuple[int, int], int]:
    """(centroid, place) to a sum over all trees; k times dims + 2 rows come to the driver."""

    def run(batches):
        import pyarrow as pa

        total = None
        for batch in batches:
            for data in batch.column(0):
                own = np.array(Tree.unpacked(data.as_buffer().to_pybytes()).gathered(centroids), object)
                total = own if total is None else total + own
        if total is not None:
            k, width = total.shape
            place = np.tile(np.r_[COUNT, SQUARES, np.arange(width - 2)], k).astype(np.int32)
            values = pa.array([Decimal(x) for x in total.ravel().tolist()], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(k, dtype=np.int32), width)), pa.array(place), values], names=["cluster", "place", "x"])

    rows = held.select("tree").mapInArrow(run, "cluster int, place int, x decimal(38,0)")
    return {(r["cluster"], r["place"]): int(r["x"]) for r in rows.groupBy("cluster", "place").agg(F.sum("x").alias("x")).collect()}


def clustered(
    vectors: DataFrame, *, k: int = 8, rounds: int = 10, dims: int = 64, scale: float = 1024.0, seed: int = 3, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256: exact k-means of ``floor(scale * x)``.

    Vectors that are null, of another length than ``dims`` or hold null or non-finite components take no part. Repeated
    rows count as often as they come and may all start as centroids; rows of a null id are clustered but start none. With
    fewer vectors than ``k`` all of them start; without any (or none with an id) there is no row. Equal distances go to
    the smaller number; a centroid without vectors stays where it is. A distance or sum of distances beyond a long is
    null, though the clusters are still exact; components beyond 2^44 are taken as that.
    """
    spark, of = vectors.sparkSession, dict(id_col=id_col, vector_col=vector_col, dims=dims, scale=scale)
    id_type = vectors.schema[id_col].dataType.simpleString()
    schema = f"vec_id {id_type}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    centroids = first_centroids(vectors, k, seed=seed, **of)
    if not len(centroids):
        return spark.createDataFrame([], schema)
    held = trees(vectors, **of)
    for _ in range(rounds):
        sums = summed(held, centroids)
        for c in range(len(centroids)):
            if n := sums.get((c, COUNT), 0):
                centroids[c] = [sums[c, j] // n for j in range(dims)]
    sums = summed(held, centroids)
    # Squared distances to z sum up to (sum of squares) - 2 z (sum) + count z^2.
    at = [[int(x) for x in z] for z in centroids]
    inertias = [sums.get((c, SQUARES), 0) - 2 * sum(z * sums.get((c, j), 0) for j, z in enumerate(zs)) + sums.get((c, COUNT), 0) * sum(z * z for z in zs) for c, zs in enumerate(at)]
    hashes = [hashlib.sha256(",".join(map(str, zs)).encode()).hexdigest() for zs in at]
    all_of = sum(inertias)

    def run(batches):
        import pyarrow as pa

        long = lambda xs: pa.array([x if x <= LONG else None for x in map(int, xs)], pa.int64())
        for batch in batches:
            for ids, data in zip(batch.column(0), batch.column(1), strict=True):
                owner, distance = Tree.unpacked(data.as_buffer().to_pybytes()).assigned(centroids)
                whose, many = owner.tolist(), len(owner)
                yield pa.RecordBatch.from_arrays(
                    [ids.values, pa.array(owner.astype(np.int32)), long(distance), long(inertias[c] for c in whose), long([all_of] * many), pa.array([hashes[c] for c in whose], pa.string())],
                    names=["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"],
                )

    return held.mapInArrow(run, schema)
