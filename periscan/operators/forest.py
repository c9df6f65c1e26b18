"""A forest of shallow trees on rows of two kinds, and its held-out scores: every level of all trees of all folds is one pass over the rows.

Rows are written once as blocks of bin numbers, dealt and ordered by their values alone. A task adds up, for each node of each tree, how many drawn rows of
either kind fall into each bin of the node's features; Spark adds these sums over tasks, and a split is chosen for each node where its sums meet.
Sums are whole numbers, so the trees do not depend on partitions. The driver holds the trees only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from periscan.operators.quantiles import group_quantiles
from periscan.session import materialize

#: Bins of a parameter, rows of a block (about), trees whose sums travel together, and rows after which a task hands its sums on.
BINS, BLOCK, TOGETHER, HELD = 32, 4096, 10, 1 << 24
#: A row of the second kind counts 1 and this, so that one sum holds both counts.
SECOND = float(1 << 26)
#: How often a row is drawn for a tree, by 16 random bits: Poisson of mean 1.
DRAWN = np.searchsorted(np.cumsum([math.exp(-1) / math.factorial(k) for k in range(9)]), (np.arange(1 << 16) + 0.5) / (1 << 16)).astype(np.uint8)


@dataclass
class Trees:
    """Trees as heaps: the feature and the last bin of the left side at each node (255 where none splits), the share of the second kind (a leaf's goes
    down to the left), and gain times rows of each split."""

    feature: np.ndarray
    last: np.ndarray
    share: np.ndarray
    weight: np.ndarray


def edges(rows: DataFrame, parameters: list[str]) -> list[np.ndarray]:
    """The upper bounds of all bins but the last: every value of a parameter that has ``BINS`` values or fewer, exact quantiles of the others."""
    rough = rows.agg(*(F.approx_count_distinct(p).alias(p) for p in parameters)).first()
    small = [p for p in parameters if rough[p] <= 2 * BINS]
    values = rows.agg(*(F.array_sort(F.collect_set(p)).alias(p) for p in small)).first().asDict() if small else {}
    found = {p: v[:-1] for p, v in values.items() if len(v) <= BINS}
    many = [p for p in parameters if p not in found]
    if many:
        long = rows.select(F.explode(F.array(*(F.struct(F.lit(p).alias("parameter"), F.col(p).alias("x")) for p in many))).alias("v")).select("v.*")
        for r in group_quantiles(long, ["parameter"], "x", [k / BINS for k in range(1, BINS)]).collect():
            found.setdefault(r["parameter"], []).append(r["value"])
    return [np.unique(np.array(found.get(p, []), float)) for p in parameters]


def blocks(rows: DataFrame, parameters: list[str], folds: int, seed: int) -> DataFrame:
    """(block, n, cells): cells hold a row for each parameter's bins, the kind and the fold. Equal rows share a fold, and are spread over blocks."""
    bounds, count = edges(rows, parameters), max(1, -(-rows.count() // BLOCK))
    columns = [*parameters, "label"]
    each = rows.groupBy(*columns).count().select(*columns, F.explode(F.sequence(F.lit(1), F.col("count").cast("int"))).alias("copy"))
    fold = F.pmod(F.xxhash64(*columns, F.lit(seed)), F.lit(folds)).cast("int")
    dealt = each.select(*columns, fold.alias("fold"), F.pmod(F.xxhash64(*columns, "copy", F.lit(seed + 1)), F.lit(count)).alias("block"))

    def pack(table: pa.Table) -> pa.Table:
        x = [table.column(c).to_numpy() for c in columns]
        cells = np.array([*(np.searchsorted(b, v) for b, v in zip(bounds, x, strict=False)), x[-1], table.column("fold").to_numpy()]).astype(np.uint8)[:, np.lexsort(x)]
        return pa.table({"block": table.column("block").slice(0, 1), "n": pa.array([cells.shape[1]], pa.int32()), "cells": pa.array([cells.tobytes()], pa.binary())})

    return materialize(dealt.groupBy("block").applyInArrow(pack, "block long, n int, cells binary"), "blocks")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
    for batch in batches:
        for block, n, cells in zip(*(batch.column(c) for c in ("block", "n", "cells")), strict=True):
            yield block.as_py(), np.frombuffer(cells.as_buffer(), np.uint8).reshape(-1, n.as_py())


def _places(cells: np.ndarray, feature: np.ndarray, last: np.ndarray, level: int) -> np.ndarray:
    """Each column's node at ``level`` of one tree."""
    n = cells.shape[1]
    at = np.zeros(n, np.int64)
    right = (cells[feature[: 2**level - 1]] > last[: 2**level - 1, None]).ravel()
    for d in range(level):
        at = 2 * at + right[(at + 2**d - 1) * n + np.arange(n)]
    return at


def _spread(packed: DataFrame) -> DataFrame:
    """Blocks to two tasks a core, however many there are: each task hands on the sums of all trees."""
    return packed.repartition(2 * packed.sparkSession.sparkContext.defaultParallelism)


def _gini(n: np.ndarray, second: np.ndarray) -> np.ndarray:
    share = second / np.maximum(n, 1)
    return 2 * share * (1 - share)


def _level(packed: DataFrame, grown: Trees, level: int, asked: np.ndarray, fits: int, leaf: int, seed: int) -> np.ndarray:
    """For each tree and node: feature, last bin of the left side, gain, rows, those of the second kind, and both counts of the left side.

    ``asked``: the features of each tree and node. The tree of fit f leaves out the rows of fold f (the last fit none).
    """
    total, nodes, k = asked.shape
    trees, feature, last = total // fits, grown.feature, grown.last

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, held = np.zeros((total, k, nodes, BINS)), 0

        def hand_on() -> pa.RecordBatch:
            parts = range(0, total, TOGETHER)
            return pa.RecordBatch.from_arrays([pa.array([p // TOGETHER for p in parts], pa.int32()), pa.array([sums[p : p + TOGETHER].tobytes() for p in parts], pa.binary())], names=["part", "sums"])

        for block, cells in _blocks(batches):
            many = len(cells) - 2
            start = (np.arange(many) * nodes * BINS)[:, None]
            draw = np.random.default_rng((seed, block))
            for t in range(trees):
                times = DRAWN[draw.integers(0, 1 << 16, cells.shape[1], np.uint16)]
                at = np.flatnonzero(times)
                bag = cells.take(at, 1)
                value, place = times[at] * (1 + SECOND * bag[-2]), bag[:-2] + start
                for f in range(fits):
                    node = _places(bag, feature[f * trees + t], last[f * trees + t], level)
                    counted = np.bincount((place + node * BINS).ravel(), np.tile(value * (bag[-1] != f), many), many * nodes * BINS).reshape(many, nodes, BINS)
                    sums[f * trees + t] += counted[asked[f * trees + t].T, np.arange(nodes)]
            held += cells.shape[1]
            if held > HELD:
                yield hand_on()
                sums[:], held = 0, 0
        if held:
            yield hand_on()

    def choose(table: pa.Table) -> pa.Table:
        both = np.zeros((2, 0))
        for x in table.column("sums"):
            got = np.frombuffer(x.as_buffer())
            second = np.floor(got / SECOND)
            both = np.array([got - second * SECOND, second]) + (both if both.size else 0)
        first = table.column("part")[0].as_py() * TOGETHER
        both = both.reshape(2, -1, k, nodes, BINS).transpose(0, 1, 3, 2, 4)
        (ln, lp), (n, p) = both.cumsum(-1)[..., :-1], both.sum(-1, keepdims=True)
        gain = _gini(n, p) - (ln * _gini(ln, lp) + (n - ln) * _gini(n - ln, p - lp)) / np.maximum(n, 1)
        gain = np.where((ln >= leaf) & (n - ln >= leaf), gain, -1).reshape(len(gain), nodes, -1)
        best = gain.argmax(-1)[..., None]
        pick = lambda x: np.take_along_axis(np.broadcast_to(x, both.shape[1:-1] + (BINS - 1,)).reshape(gain.shape), best, -1).ravel()
        chosen = np.take_along_axis(asked[first : first + len(gain)], best // (BINS - 1), -1).ravel()
        tree, node = (x.ravel() for x in np.indices(gain.shape[:2]))
        columns = [tree + first, node, chosen, (best % (BINS - 1)).ravel(), pick(gain.reshape(ln.shape)), pick(n), pick(p), pick(ln), pick(lp)]
        return pa.table({c: pa.array(x.astype(float)) for c, x in zip(names, columns, strict=True)})

    names = ["tree", "node", "feature", "last", "gain", "n", "second", "left_n", "left_second"]
    found = _spread(packed).mapInArrow(add, "part int, sums binary").groupBy("part").applyInArrow(choose, ", ".join(f"{c} double" for c in names))
    rows = np.array(found.toArrow().columns).T  # trees times nodes, whatever the table's size
    out = np.zeros((total, nodes, len(names) - 2))
    out[rows[:, 0].astype(int), rows[:, 1].astype(int)] = rows[:, 2:]
    return out


def grow(packed: DataFrame, parameters: int, fits: int, trees: int, depth: int, leaf: int, seed: int) -> Trees:
    """``fits`` forests of ``trees`` trees, one after the other. A node looks at as many features as the root of their number (rounded up), or at all if the tree is alone.

    As in Spark's own forest, two leaves that name the same kind are one leaf in the end.
    """
    total, inner = fits * trees, 2**depth - 1
    grown = Trees(np.zeros((total, inner), np.uint8), np.full((total, inner), 255, np.uint8), np.zeros((total, 2 * inner + 1)), np.zeros((total, inner)))
    split = np.zeros((total, 2 * inner + 1), bool)
    alive = np.ones((total, 1), bool)
    draw, k = np.random.default_rng(seed), parameters if trees == 1 else math.ceil(math.sqrt(parameters))
    for level in range(depth):
        own, below = slice(2**level - 1, 2 ** (level + 1) - 1), slice(2 ** (level + 1) - 1, 2 ** (level + 2) - 1)
        asked = draw.random((total, 2**level, parameters)).argsort(-1)[..., :k]
        feature, last, gain, n, second, left_n, left_second = _level(packed, grown, level, asked, fits, leaf, seed).transpose(2, 0, 1)
        if level == 0:
            grown.share[:, own] = second / np.maximum(n, 1)
        good = split[:, own] = alive & (gain > 0)
        grown.feature[:, own], grown.last[:, own], grown.weight[:, own] = np.where(good, feature, 0), np.where(good, last, 255), np.where(good, gain * n, 0)
        sides = left_second / np.maximum(left_n, 1), (second - left_second) / np.maximum(n - left_n, 1)
        grown.share[:, below] = np.stack([np.where(good, s, grown.share[:, own]) for s in sides], -1).reshape(total, -1)
        alive = np.repeat(good, 2, -1)
    for node in reversed(range(inner)):
        left, right = 2 * node + 1, 2 * node + 2
        one = split[:, node] & ~split[:, left] & ~split[:, right] & ((grown.share[:, left] > 0.5) == (grown.share[:, right] > 0.5))
        split[one, node], grown.feature[one, node], grown.last[one, node], grown.weight[one, node] = False, 0, 255, 0
    for node in range(inner):
        alone = ~split[:, node]
        grown.share[alone, 2 * node + 1] = grown.share[alone, node]
    return grown


def held_out(packed: DataFrame, grown: Trees, trees: int, folds: int) -> DataFrame:
    """(fold, score, label): the mean share of the second kind over the trees that have not seen a row's fold."""
    feature, last, share = grown.feature, grown.last, grown.share
    inner = feature.shape[1]
    depth = inner.bit_length()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, cells in _blocks(batches):
            for f in range(folds):
                own = cells[:, cells[-1] == f]
                sums = np.zeros(own.shape[1])
                for t in range(f * trees, (f + 1) * trees):
                    sums += share[t, inner + _places(own, feature[t], last[t], depth)]
                yield pa.RecordBatch.from_arrays([pa.array(own[-1].astype(np.int32)), pa.array(sums / trees), pa.array(own[-2].astype(float))], names=["fold", "score", "label"])

    return _spread(packed).mapInArrow(score, "fold int, score double, label double")


def importances(grown: Trees, first: int, parameters: int) -> np.ndarray:
    """Of each feature, from the trees from ``first`` on: each tree's weights sum to one, and so do all in the end."""
    weight = grown.weight[first:]
    own = weight.sum(1, keepdims=True)
    mean = np.bincount(grown.feature[first:].ravel(), (weight / np.where(own > 0, own, 1)).ravel(), parameters)
    return mean / (mean.sum() or 1)
