"""Clustering around centroids in whole numbers, filtered by ball trees."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from periscan.llm.arrow import small_batches
from periscan.llm.integers import LONGEST, in_range, matrix, products, scaled
from periscan.session import Scratch

#: Vectors of a tree, and bytes of them, at most; vectors of a leaf.
TREE_ROWS, TREE_BYTES, LEAF = 8192, 16 << 20, 64
#: Relative room for rounding where balls are compared; a ball too close to call goes down to its vectors.
SLACK = 1e-9
#: Matrices of a stored tree.
PARTS = ["ids", "points", "begin", "end", "left", "count", "radius", "center", "total"]
#: Decimals hold sums that could pass a long.
SUM = "decimal(38,0)"


def build_tree(ids: np.ndarray, points: np.ndarray, leaf: int = LEAF) -> dict[str, np.ndarray]:
    """A tree of balls over the rows of a matrix of longs, which are put into the order of its leaves.

    A node has its rows (begin, end), their count and whole-number sum, their mean and the
    radius around it. Its children, ``left`` and the one after, hold the halves
    along the line between two far rows; -1 for leaves.
    """
    order, exact = np.arange(len(ids)), float(np.abs(points).max(initial=0)) * len(points) < 1 << 62
    x = points.astype(np.float64)
    spans, left, center, radius, total = [(0, len(ids))], [], [], [], []
    node = 0
    while node < len(spans):
        a, b = spans[node]
        rows = order[a:b]
        own = x[rows]
        mean = own.mean(0)
        far = np.sqrt(((own - mean) ** 2).sum(1))
        center.append(mean)
        radius.append(far.max() * (1 + SLACK))
        total.append(points[rows].sum(0) if exact else points[rows].astype(object).sum(0))
        left.append(-1)
        if b - a > leaf and far.max() > 0:
            one = own[far.argmax()]
            apart = ((own - one) ** 2).sum(1)
            along = own @ (own[apart.argmax()] - one)
            half = (b - a) // 2
            order[a:b] = rows[np.argpartition(along, half)]
            left[node] = len(spans)
            spans += [(a, a + half), (a + half, b)]
        node += 1
    begin, end = np.array(spans, np.int64).T
    sums = np.array([[str(s) for s in t] for t in total]).astype("U") if not exact else np.array(total, np.int64)
    return {"ids": ids[order], "points": points[order], "begin": begin, "end": end, "left": np.array(left), "count": end - begin, "radius": np.array(radius), "center": np.array(center), "total": sums}


def assign(tree: dict[str, np.ndarray], centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cluster of each row or -1, cluster of each node or -1): balls that lie nearest to one centroid as a whole, and the rows of the other leaves.

    A centroid is out for a ball, and all below it, if by the triangle inequality even the ball's nearest
    point to it is farther than its farthest from the closest centroid. Rows are compared in
    whole numbers; ties go to the smaller number.
    """
    cluster, ball = np.full(len(tree["ids"]), -1), np.full(len(tree["left"]), -1)
    c = centroids.astype(np.float64)
    nodes, open_to = np.array([0]), np.ones((1, len(c)), bool)
    while len(nodes):
        far = np.sqrt(((tree["center"][nodes][:, None] - c[None]) ** 2).sum(2))
        radius = tree["radius"][nodes][:, None]
        nearest = np.where(open_to, far, np.inf).min(1)[:, None]
        open_to &= far - radius <= nearest + radius + SLACK * (far + nearest + radius)
        whole = open_to.sum(1) == 1
        ball[nodes[whole]] = open_to[whole].argmax(1)
        nodes, open_to = nodes[~whole], open_to[~whole]
        leaf = tree["left"][nodes] < 0
        if leaf.any():
            rows = np.concatenate([np.arange(tree["begin"][n], tree["end"][n]) for n in nodes[leaf]])
            may = np.repeat(open_to[leaf], tree["count"][nodes[leaf]], axis=0)
            cluster[rows] = _nearest(tree["points"][rows], centroids, may)
        below = tree["left"][nodes[~leaf]]
        nodes, open_to = np.concatenate([below, below + 1]), np.tile(open_to[~leaf], (2, 1))
    return cluster, ball


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances between the rows of two matrices of longs, in whole numbers, which are Python's where they could pass a long."""
    if (float(np.abs(x).max(initial=0)) + float(np.abs(y).max(initial=0))) ** 2 * x.shape[1] >= 1 << 62:
        a, b = x.astype(object), y.astype(object)
        return (a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None]
    return (x * x).sum(1)[:, None] - 2 * products(x, y).astype(np.int64) + (y * y).sum(1)[None]


def _nearest(x: np.ndarray, centroids: np.ndarray, may: np.ndarray) -> np.ndarray:
    far = distances(x, centroids)
    far[~may] = far.max() + 1
    return far.argmin(1)


def _trees(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[pa.RecordBatch]:
    """One tree after the other, each over rows that lie in this partition."""

    def grown(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(parts)
        points = matrix(rows.column("v"), d)
        tree = build_tree(rows.column("id").to_numpy(), points)
        kind = next(t for t in ("int16", "int32", "int64") if np.abs(points).max() <= np.iinfo(t).max)
        tree["points"] = tree["points"].astype(kind)
        held = [pa.array([tree[p].tobytes()], pa.binary()) for p in PARTS]
        return pa.RecordBatch.from_arrays([pa.array([kind]), pa.array([str(tree["total"].dtype)]), *held], names=["kind", "sums", *PARTS])

    most = max(LEAF, min(TREE_ROWS, TREE_BYTES // (8 * d)))
    held, n = [], 0
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            part = batch.slice(at, most - n)
            held.append(part)
            n, at = n + part.num_rows, at + part.num_rows
            if n == most:
                yield grown(held)
                held, n = [], 0
    if n:
        yield grown(held)


def _read(batch: pa.RecordBatch, row: int, d: int, parts: list[str]) -> dict[str, np.ndarray]:
    kinds = {p: np.dtype(np.int64) for p in PARTS} | {"points": np.dtype(batch.column("kind")[row].as_py()), "radius": np.dtype(float), "center": np.dtype(float), "total": np.dtype(batch.column("sums")[row].as_py())}
    tree = {p: np.frombuffer(batch.column(p)[row].as_buffer(), kinds[p]) for p in parts}
    tree |= {p: tree[p].reshape(-1, d) for p in ("points", "center", "total") if p in tree}
    tree["points"] = tree["points"].astype(np.int64)
    return tree


def _round(centroids: np.ndarray):
    """(cluster, n, sums) of each task's trees: node sums of whole balls, and rows of the rest."""
    k, d = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros(k, np.int64), np.zeros((k, d), object)
        for batch in batches:
            for row in range(batch.num_rows):
                tree = _read(batch, row, d, PARTS)
                cluster, ball = assign(tree, centroids)
                for j in range(k):
                    mine, balls = np.flatnonzero(cluster == j), np.flatnonzero(ball == j)
                    n[j] += len(mine) + tree["count"][balls].sum()
                    exact = float(np.abs(tree["points"]).max(initial=0)) * len(mine) < 1 << 62
                    sums[j] += (tree["points"][mine] if exact else tree["points"][mine].astype(object)).sum(0).astype(object)
                    for b in balls:
                        sums[j] += np.array([int(s) for s in tree["total"][b]], object)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(n[some]), pa.array([[str(s) for s in sums[j]] for j in some], pa.list_(pa.string()))], names=["cluster", "n", "sums"])

    return run


def _place(centroids: np.ndarray):
    k, d = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                tree = _read(batch, row, d, [p for p in PARTS if p != "total"])
                cluster, ball = assign(tree, centroids)
                cluster = cluster.copy()
                for b in np.flatnonzero(ball >= 0):
                    cluster[tree["begin"][b] : tree["end"][b]] = ball[b]
                far = np.zeros(len(cluster), np.int64)
                for j in np.unique(cluster):
                    mine = np.flatnonzero(cluster == j)
                    far[mine] = np.minimum(distances(tree["points"][mine], centroids[j : j + 1])[:, 0], LONGEST)
                yield pa.RecordBatch.from_arrays([pa.array(tree["ids"]), pa.array(cluster.astype(np.int32)), pa.array(far)], names=["id", "cluster", "distance"])

    return run


def whole_centroids(vectors: DataFrame, k: int = 16, rounds: int = 3, d: int = 64, scale: int = 64, seed: Column | None = None, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``rounds`` of Lloyd's algorithm on floor(``scale`` * x) of the vectors with exactly ``d`` components, in whole numbers.

    The first centroids are the ``k`` vectors with the smallest ``seed`` (by default the hexadecimal
    sha256 of ``1:<id>``), in that order, equal ones by vector. Each round assigns every vector to its nearest centroid (ties to
    the smaller number) and moves every centroid that has any to floor(sum / count); then all are assigned once more.

    Returns a row for each vector: vec_id, cluster, distance (squared), cluster_inertia, inertia (distances summed), centroid_sha256.

    Each partition's rows are put into ball trees once, stored, and reread in every round; no row
    travels. A task sends count and sum for each centroid, so that the driver sees ``k`` x ``d`` sums a round.

    Rows with a null id or vector, another length, or a null or non-finite component (or one beyond 2^62 / ``scale``) take no part.
    Repeated rows each count. With fewer than ``k`` vectors there are as many centroids; an empty table has no rows. A
    distance or inertia beyond a long is the nearest long. Extra columns are left behind.
    """
    spark = vectors.sparkSession
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    id_, vec = F.col(id_col), F.col(vec_col)
    seed = F.sha2(F.concat(F.lit("1:"), id_.cast("long").cast("string")), 256) if seed is None else seed
    kept = vectors.where(id_.isNotNull() & (F.size(vec) == d) & in_range(vec, scale)).select(id_.cast("long").alias("id"), scaled(vec, scale).alias("v"), seed.alias("seed"))
    first = kept.orderBy("seed", "v").limit(k).select("v").collect()  # k vectors
    if not first:
        return spark.createDataFrame([], schema)
    centroids = np.array([r["v"] for r in first], np.int64)
    scratch = Scratch(spark)
    ddl = "kind string, sums string, " + ", ".join(f"{p} binary" for p in PARTS)
    trees = scratch.write(small_batches(kept.select("id", "v")).mapInArrow(lambda batches: _trees(batches, d), ddl), "trees")
    for _ in range(rounds):
        parts = trees.mapInArrow(_round(centroids), "cluster long, n long, sums array<string>").select("cluster", "n", F.posexplode(F.col("sums").cast(f"array<{SUM}>")))
        moved = parts.groupBy("cluster", "pos").agg(F.sum("col").cast("string").alias("total"), F.sum("n").alias("n")).collect()  # k x d rows at most
        centroids = centroids.copy()
        for r in moved:
            centroids[r["cluster"], r["pos"]] = int(r["total"]) // r["n"]
    placed = scratch.write(trees.mapInArrow(_place(centroids), "id long, cluster int, distance long"), "placed")
    scratch.drop(trees)
    long = lambda total: F.least(total, F.lit(LONGEST).cast(SUM)).cast("long")
    spread = placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).cast(SUM).alias("own")).collect()  # k rows at most
    sha = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    total = sum(r["own"] for r in spread)
    told = spark.createDataFrame([(r["cluster"], r["own"], total, sha[r["cluster"]]) for r in spread], f"cluster int, own {SUM}, total {SUM}, centroid_sha256 string")
    return placed.join(F.broadcast(told), "cluster").select(F.col("id").alias("vec_id"), "cluster", "distance", long(F.col("own")).alias("cluster_inertia"), long(F.col("total")).alias("inertia"), "centroid_sha256")
