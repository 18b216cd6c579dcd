"""Centroid clustering by kd-tree filtering over integer vectors.

Every task plants kd-trees over blocks of its vectors once. A node is a range of the block's rows and holds their count,
their integer sums and their bounding box. In a round, a centroid goes down from the root with its rivals: those that lie
strictly farther than another from every point of the box are pruned; a node with one centroid left is assigned whole,
by its count and sums; leaves are resolved exactly, ties to the smaller number. All values are integers.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm import common

_MOST = 1 << 26  # components below this in magnitude: a squared distance over 64 of them fits a long
_EXACT = 1 << 22  # below this, sums of products over up to 128 components are exact in doubles too
_BLOCK = 8192  # vectors of a tree
_LEAF = 32


class Tree:
    """A kd-tree over rows of ``points`` (int64), which it puts in its own order."""

    def __init__(self, points: np.ndarray, leaf: int = _LEAF):
        order = np.arange(len(points))
        starts, ends, left = [0], [len(points)], []
        lo, hi = [], []
        at = 0
        while at < len(starts):
            a, b = starts[at], ends[at]
            part = points[order[a:b]]
            lo.append(part.min(axis=0))
            hi.append(part.max(axis=0))
            wide = hi[-1] - lo[-1]
            d = int(wide.argmax())
            if b - a <= leaf or wide[d] == 0:
                left.append(0)
            else:
                mid = (b - a) // 2
                order[a:b] = order[a:b][np.argpartition(part[:, d], mid)]
                left.append(len(starts))
                starts += [a, a + mid]
                ends += [a + mid, b]
            at += 1
        self.order, self.starts, self.ends, self.left = order, np.array(starts), np.array(ends), np.array(left)
        self.lo, self.hi, self.points = np.array(lo), np.array(hi), points[order]
        running = np.zeros((len(points) + 1, points.shape[1]), np.int64)
        np.cumsum(self.points, axis=0, out=running[1:])
        self.sums = running[self.ends] - running[self.starts]

    def dump(self) -> dict[str, bytes]:
        return {name: np.ascontiguousarray(getattr(self, name)).tobytes() for name in ("starts", "ends", "left", "lo", "hi", "points", "sums")}

    @classmethod
    def load(cls, row: dict[str, bytes], width: int) -> Tree:
        tree = cls.__new__(cls)
        for name in ("starts", "ends", "left"):
            setattr(tree, name, np.frombuffer(row[name], np.int64))
        for name in ("lo", "hi", "points", "sums"):
            setattr(tree, name, np.frombuffer(row[name], np.int64).reshape(-1, width))
        return tree

    def settle(self, cents: np.ndarray):
        """Pairs (node, centroid) of nodes that one centroid has whole, then (rows, centroid of each) of the leaves left."""
        k = len(cents)
        active, rivals = np.zeros(1, np.int64), np.ones((1, k), bool)
        nodes, owners, rows, labels = [], [], [], []
        while len(active):
            lo, hi = self.lo[active], self.hi[active]
            near = squared((lo + hi) // 2, cents).astype(np.float64)
            near[~rivals] = np.inf
            star = cents[near.argmin(axis=1)][:, None, :]
            corner = np.where(cents[None] > star, hi[:, None, :], lo[:, None, :])  # the box's corner that favours the rival most
            rivals = rivals & (((cents[None] - star) * (cents[None] + star - 2 * corner)).sum(axis=2) <= 0)
            alone = rivals.sum(axis=1) == 1
            nodes.append(active[alone])
            owners.append(rivals[alone].argmax(axis=1))
            leaf = ~alone & (self.left[active] == 0)
            if leaf.any():
                a, n = self.starts[active[leaf]], self.ends[active[leaf]] - self.starts[active[leaf]]
                at = np.repeat(a - (np.cumsum(n) - n), n) + np.arange(n.sum())
                found = squared(self.points[at], cents)
                found[~np.repeat(rivals[leaf], n, axis=0)] = np.iinfo(np.int64).max
                rows.append(at)
                labels.append(found.argmin(axis=1))
            deeper = ~alone & ~leaf
            active = np.concatenate([self.left[active[deeper]], self.left[active[deeper]] + 1])
            rivals = np.concatenate([rivals[deeper], rivals[deeper]])
        whole = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
        return whole(nodes), whole(owners), whole(rows), whole(labels)

    def totals(self, cents: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Count and sums of each centroid's vectors."""
        count, sums = np.zeros(len(cents), np.int64), np.zeros(cents.shape, np.int64)
        nodes, owners, rows, labels = self.settle(cents)
        np.add.at(count, owners, self.ends[nodes] - self.starts[nodes])
        np.add.at(sums, owners, self.sums[nodes])
        np.add.at(count, labels, 1)
        np.add.at(sums, labels, self.points[rows])
        return count, sums

    def labels(self, cents: np.ndarray) -> np.ndarray:
        """The centroid of each row, in the tree's order."""
        out = np.zeros(len(self.points), np.int64)
        nodes, owners, rows, labels = self.settle(cents)
        for node, owner in zip(nodes.tolist(), owners.tolist(), strict=True):
            out[self.starts[node] : self.ends[node]] = owner
        out[rows] = labels
        return out


def squared(points: np.ndarray, cents: np.ndarray) -> np.ndarray:
    """Exact squared distances of every point from every centroid."""
    small = max(abs(points).max(initial=0), abs(cents).max(initial=0)) < _EXACT and points.shape[1] <= 128
    kind = np.float64 if small else np.int64
    p, c = points.astype(kind), cents.astype(kind)
    out = (p * p).sum(axis=1)[:, None] - 2 * (p @ c.T) + (c * c).sum(axis=1)[None]
    return out.astype(np.int64)


_TREE = "ids binary, named binary, starts binary, ends binary, left binary, lo binary, hi binary, points binary, sums binary"


def _plant(batches, width: int):
    held, size = [], 0

    def block():
        ids = pa.concat_arrays([i for i, _ in held])
        tree = Tree(np.concatenate([p for _, p in held]))
        named = np.asarray(ids.is_valid())[tree.order]
        row = {"ids": ids.fill_null(0).to_numpy(zero_copy_only=False)[tree.order].tobytes(), "named": named.tobytes()} | tree.dump()
        return pa.RecordBatch.from_pydict({k: pa.array([v], pa.binary()) for k, v in row.items()})

    for b in batches:
        ids, points = b.column("vec_id"), b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
        at = 0
        while at < len(ids):
            n = min(_BLOCK - size, len(ids) - at)
            held.append((ids.slice(at, n), points[at : at + n]))
            size, at = size + n, at + n
            if size == _BLOCK:
                yield block()
                held, size = [], 0
    if size:
        yield block()


def _trees(batches, width: int):
    for b in batches:
        for row in b.to_pylist():
            yield row, Tree.load(row, width)


def _totals(batches, cents: list, width: int):
    """Rows (cluster, component, total) of a task's vectors; component -1 is the count."""
    cents = np.array(cents, np.int64)
    count, sums = np.zeros(len(cents), np.int64), np.zeros(cents.shape, np.int64)
    for _, tree in _trees(batches, width):
        c, s = tree.totals(cents)
        count, sums = count + c, sums + s
    every = np.concatenate([count[:, None], sums], axis=1)
    k, d = np.divmod(np.arange(every.size), width + 1)
    yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(d - 1), pa.array(every.ravel())], ["cluster", "component", "total"])


def _assigned(batches, cents: list, width: int):
    cents = np.array(cents, np.int64)
    for row, tree in _trees(batches, width):
        labels = tree.labels(cents)
        off = tree.points - cents[labels]
        ids = pa.array(np.frombuffer(row["ids"], np.int64), mask=~np.frombuffer(row["named"], bool))
        yield pa.RecordBatch.from_arrays([ids, pa.array(labels.astype(np.int32)), pa.array((off * off).sum(axis=1))], ["vec_id", "cluster", "distance"])


def kept_vectors(vectors: DataFrame, width: int = 64, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v): vectors of exactly ``width`` components, all finite, as integers floor(scale * x)."""
    v = F.col(vector_col).cast("array<double>")
    fine = lambda x: F.coalesce(F.abs(x) < F.lit(float(_MOST // scale)), F.lit(False)) & ~F.isnan(x)
    kept = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).filter((F.size("v") == width) & F.forall("v", fine))
    return kept.select("vec_id", F.transform("v", lambda x: F.floor(x * float(scale)).cast("long")).alias("v"))


def cluster(vectors: DataFrame, clusters: int = 40, rounds: int = 5, width: int = 64, scale: int = 256, seed: int = 2, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per kept vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Centroids start as the kept vectors with the least sha256 of ``seed:id``, are replaced ``rounds`` times by the floor of
    their vectors' mean, and vectors are assigned once more. Vectors that are null, of another length, or with a null, NaN
    or infinite component are left out; so is one with a component of 2**26 or more after scaling, whose distance need not
    fit a long. A null id hashes as no digits; equal ids are ordered by their components. With fewer vectors than
    ``clusters`` each is a centroid; with none the result is empty. Repeated rows count and are returned each for itself.
    Other columns are not read. The vectors are written once, as trees, and read once a round; what comes back from a
    round is one number a centroid, component and task, summed before it reaches the driver.
    """
    kept = kept_vectors(vectors, width, scale, id_col, vector_col)
    first = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    start = kept.withColumn("h", first).orderBy("h", "v").limit(clusters).select("v")
    cents = [list(r.v) for r in start.collect()]  # ``clusters`` rows at most
    trees = common.materialize(common.arrow_map(kept, "ledgerloom.llm.kd_clusters:_plant", _TREE, width=width), "trees")
    for _ in range(rounds if cents else 0):
        parts = common.arrow_map(trees, "ledgerloom.llm.kd_clusters:_totals", "cluster long, component long, total long", cents=cents, width=width)
        total = {(r.cluster, r.component): int(r.total) for r in parts.groupBy("cluster", "component").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()}
        cents = [[total[k, d] // total[k, -1] for d in range(width)] if total.get((k, -1)) else c for k, c in enumerate(cents)]
    rows = common.materialize(common.arrow_map(trees, "ledgerloom.llm.kd_clusters:_assigned", "vec_id long, cluster int, distance long", cents=cents, width=width), "assigned")
    common.drop_table(trees)
    inertia = rows.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))  # a row a cluster
    whole = inertia.agg(F.sum("cluster_inertia").alias("inertia"))
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    named = reduce(lambda so_far, k: so_far.when(F.col("cluster") == k, sha[k]), range(len(sha)), F.when(F.lit(False), "")) if sha else F.lit(None).cast("string")
    per_cluster = inertia.crossJoin(F.broadcast(whole)).withColumn("centroid_sha256", named)
    return rows.join(F.broadcast(per_cluster), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
