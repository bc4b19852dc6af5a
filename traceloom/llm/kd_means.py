"""Lloyd's rounds over kd-trees that filter centroids (exact integer k-means).

1. Vectors are quantised to integers once. Every task gathers the vectors of its partition in blocks of ``tree_rows``
   and builds one kd-tree for each; the trees are written to the shared folder. A node holds its count, its integer
   sums and its bounding box.
2. Each round walks every tree with the current centroids, level by level. Of a node's candidates the one nearest to
   the middle of the box is the pivot; a candidate that is strictly farther than the pivot from every point of the box
   is pruned (its own best corner decides). Where one candidate is left the node's count and sums are added whole;
   leaves with more candidates are resolved point by point, ties to the smaller number. Equal distances prune nothing,
   so the walk gives what comparing every vector with every centroid gives.
3. Only ``k`` rows of sums a task are shuffled, and only ``k`` centroids reach the driver and are sent back.

All arithmetic is on integers, so neither partitions nor the order of rows change a result. A round is one job over the
written trees: a lost executor repeats its trees of the current round only.

Defined results: vectors that are null, of another length, or with null or non-finite components are left out; a null
id is kept and never seeds a centroid before ids that are not null; repeated rows count, and are returned, one by one,
and where rows that share an id seed centroids they come in the order of their components; with fewer vectors than
``k`` there are as many centroids as vectors; an empty table gives no rows; other columns are ignored, whatever their
names. A kept component outside of ``LIMIT`` raises an error, since its distances would not fit a long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, small_batches, written

#: Quantised components are at most this large, so that squared distances over 64 components fit 63 bits.
LIMIT = 1 << 27
#: Below this the products of 64 components are exact in double precision, and a matrix product may sum them.
EXACT = 1 << 22


class Tree:
    """A kd-tree over the rows of ``points``; ``order`` lists rows such that every node owns a slice of it."""

    FIELDS = ("order", "start", "end", "left", "low", "high", "sums")

    def __init__(self, **arrays: np.ndarray):
        self.__dict__.update(arrays)

    @classmethod
    def build(cls, points: np.ndarray, leaf: int) -> Tree:
        order = np.arange(len(points), dtype=np.int64)
        start, end, left, low, high, sums = [0], [len(points)], [-1], [], [], []
        at = 0
        while at < len(start):
            a, b = start[at], end[at]
            own = points[order[a:b]]
            low.append(own.min(0)), high.append(own.max(0)), sums.append(own.sum(0))
            widths = high[-1] - low[-1]
            wide = int(widths.argmax())
            if b - a > leaf and widths[wide]:
                half = (b - a) // 2
                order[a:b] = order[a:b][np.argpartition(own[:, wide], half)]
                left[at] = len(start)  # the children are neighbours
                start += [a, a + half]
                end += [a + half, b]
                left += [-1, -1]
            at += 1
        plain = lambda x: np.array(x, np.int64)
        return cls(order=order, start=plain(start), end=plain(end), left=plain(left), low=np.stack(low), high=np.stack(high), sums=np.stack(sums))


def squared_distances(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of each point from each centroid."""
    if max(np.abs(points).max(initial=0), np.abs(centroids).max(initial=0)) < EXACT:
        p, c = points.astype(np.float64), centroids.astype(np.float64)
        return ((p * p).sum(1)[:, None] - 2 * (p @ c.T) + (c * c).sum(1)).astype(np.int64)
    return np.stack([((points - c) ** 2).sum(1) for c in centroids], 1)


def walk(tree: Tree, points: np.ndarray, centroids: np.ndarray) -> Iterator[tuple[int, np.ndarray | None, np.ndarray]]:
    """What the tree's parts are assigned to: (centroid, None, nodes) for whole nodes, (centroid, rows, []) for rows of leaves."""
    k = len(centroids)
    norms = (centroids**2).sum(1)
    nodes, open_ = np.zeros(1, np.int64), np.ones((1, k), bool)
    far = np.iinfo(np.int64).max
    while len(nodes):
        low, high = tree.low[nodes], tree.high[nodes]
        middle = squared_distances(low + high, 2 * centroids)
        pivot = np.where(open_, middle, far).argmin(1)
        for z in range(k):
            way = centroids[z] - centroids[pivot]  # the corner that favours z most lies this way
            corner = np.where(way > 0, high, low)
            open_[:, z] &= (norms[z] - norms[pivot] - 2 * (way * corner).sum(1)) <= 0
        single = open_.sum(1) == 1
        for z in np.unique(pivot[single]):
            yield int(z), None, nodes[single & (pivot == z)]
        nodes, open_ = nodes[~single], open_[~single]
        leaf = tree.left[nodes] < 0
        if leaf.any():
            sizes = (tree.end - tree.start)[nodes[leaf]]
            rows = tree.order[np.concatenate([np.arange(tree.start[n], tree.end[n]) for n in nodes[leaf]])]
            near = np.where(np.repeat(open_[leaf], sizes, 0), squared_distances(points[rows], centroids), far).argmin(1)
            for z in np.unique(near):
                yield int(z), rows[near == z], nodes[:0]
        left = tree.left[nodes[~leaf]]
        nodes, open_ = np.concatenate([left, left + 1]), np.concatenate([open_[~leaf]] * 2)


TREE_SCHEMA = "ids array<long>, points binary, " + ", ".join(f"`{f}` binary" for f in Tree.FIELDS)


def _build(dim: int, tree_rows: int, leaf: int):
    def row(ids: list[pa.Array], points: list[np.ndarray]) -> pa.RecordBatch:
        all_ids, p = pa.concat_arrays(ids), np.concatenate(points)
        tree = Tree.build(p, leaf)
        data = [p.astype("<i4").tobytes(), *(getattr(tree, f).astype("<i8").tobytes() for f in Tree.FIELDS)]
        lists = pa.ListArray.from_arrays(pa.array([0, len(all_ids)], pa.int32()), all_ids)
        return pa.RecordBatch.from_arrays([lists, *(pa.array([d], pa.binary()) for d in data)], ["ids", "points", *Tree.FIELDS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, points, held = [], [], 0
        for batch in batches:
            got = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            for a in range(0, len(got), tree_rows):
                part = got[a : a + tree_rows]
                if held and held + len(part) > tree_rows:
                    yield row(ids, points)
                    ids, points, held = [], [], 0
                ids.append(batch.column(0)[a : a + tree_rows])
                points.append(part)
                held += len(part)
        if held:
            yield row(ids, points)

    return run


def _read(batch: pa.RecordBatch, at: int, dim: int) -> tuple[pa.Array, np.ndarray, Tree]:
    get = lambda name: np.frombuffer(batch.column(name)[at].as_buffer(), "<i8")
    arrays = {f: get(f).reshape(-1, dim) if f in ("low", "high", "sums") else get(f) for f in Tree.FIELDS}
    points = np.frombuffer(batch.column("points")[at].as_buffer(), "<i4").reshape(-1, dim).astype(np.int64)
    return batch.column("ids")[at].values, points, Tree(**arrays)


def _sums(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids = sent.value
        k, dim = centroids.shape
        counts, sums = np.zeros(k, np.int64), np.zeros((k, dim), np.int64)
        by_leaf = np.zeros(k, np.int64)
        for batch in batches:
            for at in range(batch.num_rows):
                _, points, tree = _read(batch, at, dim)
                for z, rows, nodes in walk(tree, points, centroids):
                    if rows is None:
                        counts[z] += (tree.end - tree.start)[nodes].sum()
                        sums[z] += tree.sums[nodes].sum(0)
                    else:
                        counts[z] += len(rows)
                        by_leaf[z] += len(rows)
                        sums[z] += points[rows].sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k, dtype=np.int32)), pa.array(counts), pa.array(by_leaf), pa.array(list(sums), pa.list_(pa.int64()))], ["cluster", "n", "by_leaf", "sums"])

    return run


def _assigned(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids = sent.value
        for batch in batches:
            for at in range(batch.num_rows):
                ids, points, tree = _read(batch, at, centroids.shape[1])
                cluster = np.zeros(len(points), np.int32)
                for z, rows, nodes in walk(tree, points, centroids):
                    for n in nodes:
                        cluster[tree.order[tree.start[n] : tree.end[n]]] = z
                    if rows is not None:
                        cluster[rows] = z
                distance = ((points - centroids[cluster]) ** 2).sum(1)
                yield pa.RecordBatch.from_arrays([ids, pa.array(cluster), pa.array(distance)], ["vec_id", "cluster", "distance"])

    return run


def quantised(vectors: DataFrame, dim: int, scale: int, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, v) of the vectors that take part; v holds floor(scale * x) of every component as a long."""
    x = F.col(vector).cast("array<double>")
    fine = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    kept = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), x.alias("x")).where((F.size("x") == dim) & F.forall("x", fine))
    inside = F.forall("x", lambda c: F.abs(c) * scale < float(LIMIT))
    v = F.when(inside, F.transform("x", lambda c: F.floor(c * F.lit(float(scale))))).otherwise(F.raise_error(F.lit("a component is too large for distances in a long")))
    return kept.select("vec_id", v.alias("v"))


class Clustering:
    """Centroids, in order, and ``assigned``: one row per vector with its cluster and distance; ``resolved`` counts, by round, vectors decided in leaves."""

    def __init__(self, centroids: list[list[int]], assigned: DataFrame, resolved: list[int]):
        self.centroids, self.assigned, self.resolved = centroids, assigned, resolved


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, dim: int = 64, scale: int = 1024, seed: int = 3, tree_rows: int = 8192, leaf: int = 32, vec_id: str = "vec_id", vector: str = "embedding") -> Clustering:
    """``rounds`` exact rounds from the ``k`` vectors whose ids hash lowest under ``seed``, then a last assignment."""
    spark = vectors.sparkSession
    small_batches(spark)
    kept = quantised(vectors, dim, scale, vec_id, vector)
    draw = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    centroids = [r.v for r in kept.orderBy(draw.asc_nulls_last(), "v").limit(k).collect()]
    trees = written(kept.mapInArrow(_build(dim, tree_rows, leaf), TREE_SCHEMA), "kd-trees")
    if not centroids:
        return Clustering([], spark.createDataFrame([], "vec_id long, cluster int, distance long"), [])
    resolved = []
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(np.array(centroids, np.int64))
        parts = trees.mapInArrow(_sums(sent), "cluster int, n long, by_leaf long, sums array<long>")
        whole = lambda c: F.sum(c.cast("decimal(20,0)"))  # noqa: E731  sums over any number of rows stay exact
        totals = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.sum("by_leaf").alias("by_leaf"), F.array(*[whole(F.col("sums")[i]) for i in range(dim)]).alias("sums")).collect()
        for r in totals:
            if r.n:
                centroids[r.cluster] = [int(s) // r.n for s in r.sums]
        resolved.append(sum(r.by_leaf for r in totals))
    sent = spark.sparkContext.broadcast(np.array(centroids, np.int64))
    assigned = written(trees.mapInArrow(_assigned(sent), "vec_id long, cluster int, distance long"), "kd-assigned")
    discard(trees)
    return Clustering(centroids, assigned, resolved)


def digest(found: Clustering) -> DataFrame:
    """One row per vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    spark = found.assigned.sparkSession
    by = {r.cluster: int(r.s) for r in found.assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("s")).collect()}  # at most k rows
    sha = lambda c: hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()
    rows = [(z, by.get(z, 0), sum(by.values()), sha(c)) for z, c in enumerate(found.centroids)]
    about = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.assigned.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


#: DuckDB, with every round spelled out: every vector is compared with every centroid.
def oracle_sql(k: int = 8, rounds: int = 10, dim: int = 64, scale: int = 1024, seed: int = 3) -> str:
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""
a{r} AS MATERIALIZED (
  SELECT rid, arg_min(struct_pack(k := k, d := d), d * {k} + k) AS m
  FROM (SELECT rid, k, list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::HUGEINT AS d FROM kept, c{r}) GROUP BY rid)""")
        if r < rounds:
            steps.append(f"""
c{r + 1} AS MATERIALIZED (
  SELECT c{r}.k, coalesce(m.c, c{r}.c) AS c FROM c{r} LEFT JOIN (
    SELECT k, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS c
    FROM (SELECT k, i, sum(x) AS s, count(*) AS n FROM (SELECT m.k AS k, unnest(v) AS x, unnest(range({dim})) AS i FROM kept JOIN a{r} USING (rid)) GROUP BY k, i)
    GROUP BY k) m USING (k))""")
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: isfinite(x))) = {dim}),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), v) - 1 AS k, v AS c FROM kept QUALIFY k < {k}),{",".join(steps)}
SELECT vec_id, m.k::INT AS cluster, m.d::BIGINT AS distance,
  (sum(m.d) OVER (PARTITION BY m.k))::BIGINT AS cluster_inertia, (sum(m.d) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} JOIN kept USING (rid) JOIN c{rounds} ON c{rounds}.k = m.k"""
