"""Nearest neighbours by a forest of random-projection trees."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from periscan.llm.arrow import small_batches
from periscan.session import materialize

#: Trees, and leaves of each: at least the first number, then one for every ``LEAF_ROWS`` rows, up to the second.
TREES, LEAVES, LEAF_ROWS, MOST_LEAVES = 8, 128, 8192, 4096
#: Distinct vectors that the trees are fitted on at most (about), for each leaf.
SAMPLE_ROWS = 128
#: A search goes on until the leaves it has visited, over all trees, hold this multiple of the rows. Less is enough
#: where vectors have structure; vectors without any (64 random dimensions) need more than 1.0 for a recall well above 0.9.
SEARCH_SHARE = 1.4
#: Rows of a leaf, and searches that visit it, that a task holds at a time; more are cut into blocks.
BLOCK_ROWS, BLOCK_SEARCHES = 8192, 4096
#: Exact distances computed at a time.
EXACT_ROWS = 1 << 15


class Forest:
    """Flat arrays of the nodes of all trees; its size depends on the number of leaves alone."""

    def __init__(self, sample: np.ndarray, trees: int, leaves: int, seed: int):
        rng = np.random.default_rng(seed)
        self.normals, self.cuts, self.children, self.roots, self.shares = [], [], [], [], []
        smallest = max(4, -(-len(sample) // leaves))
        for _ in range(trees):
            self._grow(sample, smallest, rng)
        d = sample.shape[1]
        self.normals = np.array(self.normals).reshape(-1, d)
        self.cuts = np.array(self.cuts)
        self.children = np.array(self.children, np.int64).reshape(-1, 2)
        #: The part of the rows that each leaf holds.
        self.shares = np.array(self.shares)

    def _grow(self, x: np.ndarray, smallest: int, rng: np.random.Generator) -> None:
        """Halve by planes between two random points until the halves are small. Leaves are numbered -1, -2, ... over all trees."""
        todo = [(np.arange(len(x)), -1, 0)]
        while todo:
            rows, parent, side = todo.pop()
            me = None
            if len(rows) > smallest:
                a, b = x[rng.choice(rows, 2, replace=False)]
                length = np.linalg.norm(a - b)
                if length > 0:
                    normal = (a - b) / length
                    along = x[rows] @ normal
                    cut = np.median(along)
                    low = along < cut
                    if low.any() and not low.all():
                        me = len(self.normals)
                        self.normals.append(normal)
                        self.cuts.append(cut)
                        self.children.append([0, 0])
                        todo += [(rows[low], me, 0), (rows[~low], me, 1)]
            if me is None:
                self.shares.append(len(rows) / max(1, len(x)))
                me = -len(self.shares)
            if parent < 0:
                self.roots.append(me)
            else:
                self.children[parent][side] = me

    def leaves_of(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row in each tree: (rows, trees)."""
        out = np.empty((len(x), len(self.roots)), np.int64)
        for t, root in enumerate(self.roots):
            at = np.full(len(x), root)
            while len(live := np.flatnonzero(at >= 0)):
                node = at[live]
                right = np.einsum("ij,ij->i", x[live], self.normals[node]) >= self.cuts[node]
                at[live] = self.children[node, right.astype(np.int64)]
            out[:, t] = -at - 1
        return out

    def search(self, x: np.ndarray, share: float) -> list[list[int]]:
        """The leaves to visit for each row, nearest planes first, from one queue over all trees."""
        children, shares, out = self.children.tolist(), self.shares.tolist(), []
        for margins in x @ self.normals.T - self.cuts if len(self.cuts) else np.zeros((len(x), 0)):
            margin = margins.tolist()
            queue = [(0.0, root) for root in self.roots]
            heapq.heapify(queue)
            found, held = [], 0.0
            while queue and held < share:
                far, node = heapq.heappop(queue)
                if node < 0:
                    found.append(-node - 1)
                    held += shares[-node - 1]
                    continue
                m = margin[node]
                near = children[node][m >= 0]
                other = children[node][m < 0]
                heapq.heappush(queue, (far, near))
                heapq.heappush(queue, (max(far, abs(m)), other))
            out.append(found)
        return out


def _matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.float64) if len(column) else np.zeros((0, 1))


def usable(vectors: DataFrame, vec_col: str) -> DataFrame:
    """Rows whose vector has no null and no non-finite component, and is not zero."""
    v = F.col(vec_col)
    finite = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    return vectors.where(v.isNotNull() & (F.size(v) > 0)).where(finite & F.exists(v, lambda x: x != 0))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", trees: int = TREES, leaves: int | None = None, share: float = SEARCH_SHARE, sample_rows: int = SAMPLE_ROWS, seed: int = 9) -> DataFrame:
    """The ``k`` nearest rows of ``vectors`` to each row of ``queries`` by Euclidean distance, without the row of the query's own id.

    Returns query_id, rank (from 1), vec_id, score (the distance in double
    precision); fewer ranks if fewer rows were found; ties go to the smaller id.
    Rows with unusable vectors or null ids take no part, nor do those whose
    vectors have another length than most. Rows of one id with several vectors are
    not told from each other: as a query, their answers are ranked together, and as
    candidates the id may occur once for each of its vectors.

    Rows with one vector are one point of the index and one search, however many
    they are; a point carries its ``k`` + 1 smallest ids, as no query can return
    more of them. The trees are fitted on a bounded sample; all points are put
    into a leaf of every tree. A query visits leaves in the order of one queue over
    all trees. The rows of a leaf and the searches that visit it are cut into blocks
    of bounded size that meet by a shuffle, and only the best of each meeting go on
    to the final ranking: all within rounding of the last of the k + 1 nearest are compared exactly.
    """
    spark = vectors.sparkSession
    clean = usable(vectors, vec_col).where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    sizes = clean.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).first()
    if sizes is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    clean = clean.where(F.size("v") == sizes["d"]).withColumn("h", F.xxhash64("v"))
    few = F.row_number().over(Window.partitionBy("h", "v", F.pmod(F.xxhash64("id"), F.lit(64))).orderBy("id"))
    ranked = clean.withColumn("r", few).where(F.col("r") <= k + 1).drop("r")
    fewer = F.row_number().over(Window.partitionBy("h", "v").orderBy("id"))
    points = ranked.withColumn("r", fewer).where(F.col("r") <= k + 1).groupBy("h", "v").agg(F.array_sort(F.collect_set("id")).alias("ids"))
    points = materialize(points.select(F.get("ids", F.lit(0)).alias("point"), "ids", "h", "v"), "points")

    n = points.count()
    leaves = leaves or min(MOST_LEAVES, max(LEAVES, n // LEAF_ROWS))
    # about sample_rows vectors for each leaf
    sample = points.where(F.pmod(F.xxhash64("point", F.lit(seed)), F.lit(1 << 30)) < int(min(1.0, sample_rows * leaves / n) * (1 << 30))).select("point", "v").collect()
    sample = np.array([r["v"] for r in sorted(sample, key=lambda r: r["point"])] or points.select("v").limit(1).toPandas()["v"].tolist(), np.float64)
    forest = spark.sparkContext.broadcast(Forest(sample, trees, leaves, seed))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = forest.value.leaves_of(_matrix(batch.column("v")))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(found), pa.list_(pa.int64()))], names=[*batch.schema.names, "leaves"])

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k0 in range(0, batch.num_rows, 64):
                part = batch.slice(k0, 64)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(forest.value.search(_matrix(part.column("v")), share), pa.list_(pa.int64()))], names=[*part.schema.names, "leaves"])

    def meet(held: pa.Table, asked: pa.Table) -> pa.Table:
        names, types = ["q", "point", "score"], [pa.int64(), pa.int64(), pa.float64()]
        if not held.num_rows or not asked.num_rows:
            return pa.table([pa.array([], t) for t in types], names=names)
        x, q = _matrix(held.column("v")), _matrix(asked.column("v"))
        xi, qi = held.column("point").to_numpy(), asked.column("point").to_numpy()
        norms = (x * x).sum(1)
        out = []
        for a in range(0, len(q), 256):
            y = q[a : a + 256]
            squares = (y * y).sum(1)[:, None]
            rough = norms[None] + squares - 2 * (y @ x.T)
            last = min(k, len(x) - 1)
            limit = np.partition(rough, last, axis=1)[:, last : last + 1]
            slack = 8 * x.shape[1] * np.finfo(float).eps * (norms.max() + squares)
            row, col = np.nonzero(rough <= limit + slack)
            exact = np.concatenate([np.sqrt(((x[col[c : c + EXACT_ROWS]] - y[row[c : c + EXACT_ROWS]]) ** 2).sum(1)) for c in range(0, len(row), EXACT_ROWS)])
            order = np.lexsort((xi[col], exact, row))
            row, col, exact = row[order], col[order], exact[order]
            place_in_row = np.arange(len(row)) - np.searchsorted(row, row)
            best = place_in_row <= k
            out.append((qi[a + row[best]], xi[col[best]], exact[best]))
        return pa.table([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=names)

    asked = usable(queries, vec_col).where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("query_id"), F.col(vec_col).cast("array<double>").alias("v")).withColumn("h", F.xxhash64("v"))
    known = points.select("h", "v", "point")
    # Searches are for points; a query whose vector is no point of the index is one by its own id, told apart by a negative hash key.
    asked = materialize(asked.where(F.size("v") == sizes["d"]).join(known, ["h", "v"], "left").select("query_id", F.col("point"), "v"), "asked")
    inside = asked.where(F.col("point").isNotNull())
    outside = asked.where(F.col("point").isNull()).select("query_id", (-F.col("query_id") - 1).alias("point"), "v")
    searches = inside.select("point").distinct().join(points.select("point", "v"), "point").unionByName(outside.select("point", "v").distinct())
    ddl = "point long, v array<double>, leaves array<long>"
    placed = small_batches(points.select("point", "v")).mapInArrow(place, ddl).select("point", "v", F.explode("leaves").alias("leaf"))
    visits = materialize(searches.select("point", "v").mapInArrow(visit, ddl), "visits").select("point", "v", F.explode("leaves").alias("leaf"))
    asked_of = {r["leaf"]: r["n"] for r in visits.groupBy("leaf").agg(F.count("*").alias("n")).collect()}  # a row for each leaf
    layout = [(leaf, int(np.ceil(s * n / BLOCK_ROWS)) or 1, -(-asked_of[leaf] // BLOCK_SEARCHES)) for leaf, s in enumerate(forest.value.shares) if leaf in asked_of]
    layout = F.broadcast(spark.createDataFrame(layout, "leaf long, blocks long, parts long"))
    # A row of a leaf goes to one block of rows and all blocks of searches, a search the other way round.
    every = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    some = lambda c: F.pmod(F.xxhash64("point"), F.col(c)).cast("long")
    held_in = placed.join(layout, "leaf").select("leaf", some("blocks").alias("block"), every("parts").alias("part"), "point", "v")
    asked_in = visits.join(layout, "leaf").select("leaf", every("blocks").alias("block"), some("parts").alias("part"), "point", "v")
    keys = ["leaf", "block", "part"]
    met = held_in.groupBy(*keys).cogroup(asked_in.groupBy(*keys)).applyInArrow(meet, "q long, point long, score double")
    best = Window.partitionBy("q").orderBy("score", "point")
    top = met.groupBy("q", "point").agg(F.min("score").alias("score")).withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1).drop("r")
    expanded = top.join(points.select("point", "ids"), "point").select("q", "score", F.explode("ids").alias("vec_id"))
    again = F.row_number().over(Window.partitionBy("q").orderBy("score", "vec_id"))
    expanded = expanded.withColumn("r", again).where(F.col("r") <= k + 1).drop("r")
    who = inside.select("query_id", F.col("point").alias("q")).unionByName(outside.select("query_id", F.col("point").alias("q")))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    answered = who.join(expanded, "q").where("query_id <> vec_id").select("query_id", rank.cast("int").alias("rank"), "vec_id", "score")
    return answered.where(F.col("rank") <= k)
