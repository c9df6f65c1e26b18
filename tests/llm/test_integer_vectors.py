"""Hard negatives, exact inner products and clusters in whole numbers, against plain loops."""

import hashlib
import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from periscan.llm import balls, bitsliced, integers
from periscan.llm.balls import whole_centroids
from periscan.llm.bitsliced import Slices, top_products
from periscan.llm.negatives import hard_negatives
from periscan.llm.queries import ORACLES, QUERIES

SCHEMA = "vec_id long, embedding array<double>, label int, rank int, score string"


def table_of(spark, rows, parts=3):
    """(id, vector, label) rows, with columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, v, label, 7, "x") for i, v, label in rows], SCHEMA).repartition(parts)


def whole(rows, scale):
    """{id: (vector, label)} of the rows that take part."""
    kept = {}
    for i, v, label in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        mine = ([math.floor(scale * x) for x in v], label)
        kept[i] = min(kept.get(i, mine), mine, key=lambda m: (m[0], m[1] is None, m[1]))
    return kept


def dot(a, b):
    return sum(x * y for x, y in zip(a, b, strict=True))


def plain_negatives(rows, every, positives=5, negatives=3):
    kept = {i: r for i, r in whole([r for r in rows if r[2] is not None], 256).items()}
    out = []
    for a, (v, label) in kept.items():
        if a % every:
            continue
        scored = sorted((-dot(v, w), i) for i, (w, other) in kept.items() if i != a and len(w) == len(v) and other == label)
        for p, i in scored[:positives]:
            hits = sorted((-s, j) for j, (w, other) in kept.items() if len(w) == len(v) and other != label and -50 * p <= 100 * (s := dot(v, w)) <= -95 * p)
            out += [(a, i, k + 1, j, -p, -s) for k, (s, j) in enumerate(hits[:negatives])]
    return sorted(out)


def plain_top(rows, every, k=5):
    kept = whole(rows, 256)
    out = []
    for q, (v, _) in kept.items():
        if q % every == 0:
            best = sorted((-dot(v, w), i) for i, (w, _) in kept.items() if i != q and len(w) == len(v))
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best[:k])]
    return sorted(out)


def plain_clusters(rows, k=16, rounds=3, d=64):
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v, _ in rows if i is not None and v is not None and len(v) == d and all(x is not None and math.isfinite(x) for x in v)]
    seeds = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in kept)[:k]
    centers = [v for _, v in seeds]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centers))
    for _ in range(rounds):
        placed = [near(v)[1] for _, v in kept]
        for j in set(placed):
            mine = [v for (_, v), p in zip(kept, placed, strict=True) if p == j]
            centers[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    final = [(i, *near(v)) for i, v in kept]
    own = {j: sum(far for _, far, p in final if p == j) for j in range(len(centers))}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centers]
    return sorted((i, j, *(min(x, integers.LONGEST) for x in (far, own[j], sum(own.values()))), sha[j]) for i, far, j in final)


def ran(df):
    return sorted(tuple(r) for r in df.collect())


NEGATIVES = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def random_rows(n, d=6, seed=0, spread=1.0):
    rng = np.random.default_rng(seed)
    return [(i, v.tolist(), int(label)) for i, (v, label) in enumerate(zip(rng.normal(size=(n, d)) * spread, rng.integers(0, 3, n), strict=True))]


HARD = [
    (None, [1.0, 2.0], 1), (0, None, 1), (1, [None, 1.0], 1), (2, [math.nan, 1.0], 1), (3, [math.inf, 1.0], 1), (4, [1e300, 1.0], 1), (5, [1.0, 2.0], None),
    (10, [1.0, 2.0], 1), (10, [1.0, 2.0], 1), (10, [0.5, 2.0], 2), (11, [1.0, 2.0], 1), (12, [1.0, 2.0], 1), (13, [0.7, 1.5], 2), (14, [0.7, 1.5], 2), (15, [0.0, 0.0], 2), (20, [0.0, 0.0], 1),
    (16, [1.0, 2.0, 3.0], 1), (30, [1.0, 2.0, 3.0], 1), (40, [], 1), (41, [], 1), (50, [-1.0, -2.0], 1), (51, [2e9, -3e9], 1), (60, [2e9, 3e9], 2), (61, [-0.001, 0.001], 2), (-10, [1.5, 1.0], 1),
]


def test_negatives_of_random_and_hard_rows(spark):
    for rows in (random_rows(300), random_rows(200, d=3, seed=1, spread=0.01) + [(1000 + k, [0.5, 0.5, 0.5], k % 2) for k in range(120)], [r for r in HARD if r[1] is None or 1e300 not in r[1]]):
        got = ran(hard_negatives(table_of(spark, rows), F.col("vec_id") % 10 == 0).select(*NEGATIVES))
        assert got == plain_negatives(rows, 10)
    assert ran(hard_negatives(table_of(spark, HARD), F.col("vec_id") % 10 == 0)) == plain_negatives([r for r in HARD if r[1] is None or 1e300 not in r[1]], 10)


def test_negatives_in_many_blocks(spark):
    rows = random_rows(150, seed=3)
    got = ran(hard_negatives(table_of(spark, rows, 5), F.col("vec_id") % 4 == 0, block_bytes=8 * 6 * 9))
    assert got == plain_negatives(rows, 4)


@pytest.mark.parametrize("coarse", [0, 1, 2, 5])
def test_bit_sliced_sums_find_all_rows(coarse, monkeypatch):
    monkeypatch.setattr(bitsliced, "COARSE", coarse)
    rng = np.random.default_rng(coarse)
    for n, d, size in ((1, 1, 3), (70, 5, 200), (300, 9, 1), (129, 3, 1 << 40), (200, 4, 0)):
        v = rng.integers(-size, size + 1, (n, d))
        ids = rng.permutation(n) * 3
        block = Slices.of_rows(v)
        assert (block.rows(np.arange(n)) == v).all()
        for q in [*v[:5], np.zeros(d, np.int64), np.full(d, -7)]:
            exact = [dot(r, q.tolist()) for r in v.tolist()]
            for k in (1, 4, n, n + 3):
                found, score = block.best(q, ids, k)
                want = sorted(zip([-s for s in exact], ids.tolist(), strict=True))[:k]
                clipped = [max(-integers.LONGEST, min(integers.LONGEST, -s)) for s, _ in want]
                assert score.tolist() == clipped and (clipped != [-s for s, _ in want] or found.tolist() == [i for _, i in want])


def test_digits_give_the_number_again():
    q = np.array([0, 1, -1, 3, 7, -7, 171, -(1 << 61), (1 << 62) - 1, 12345])
    place, component, sign = bitsliced.digits(q)
    again = [0] * len(q)
    for p, c, s in zip(place.tolist(), component.tolist(), sign.tolist(), strict=True):
        again[c] += s << p
    assert again == q.tolist()
    assert all(abs(a - b) > 1 for c in range(len(q)) for a, b in zip(sorted(place[component == c]), sorted(place[component == c])[1:], strict=False))


def test_top_products_of_random_and_hard_rows(spark, monkeypatch):
    monkeypatch.setattr(bitsliced, "BLOCK_ROWS", 64)
    for rows in (random_rows(300), random_rows(60, d=3, seed=1) + [(1000 + k, [3.0, 3.0, 3.0], 1) for k in range(150)], [r for r in HARD if r[1] is None or 1e300 not in r[1]]):
        assert ran(top_products(table_of(spark, rows), F.col("vec_id") % 10 == 0)) == plain_top(rows, 10)
    rows = random_rows(150, seed=3)
    assert ran(top_products(table_of(spark, rows), F.col("vec_id") % 4 == 0, k=7, block_bytes=8 * 6 * 9)) == plain_top(rows, 4, 7)


def test_clusters_of_random_and_hard_rows(spark, monkeypatch):
    monkeypatch.setattr(balls, "TREE_ROWS", 90)
    monkeypatch.setattr(balls, "LEAF", 8)
    rng = np.random.default_rng(2)
    grouped = [(i, (rng.normal(size=5) * 0.05 + (i % 7)).tolist(), 1) for i in range(300)]
    copies = [(i, [0.5] * 5, 1) for i in range(200)] + [(i, [(i % 3) / 2.0] * 5, 1) for i in range(200, 260)]
    odd = [(None, [1.0] * 5, 1), (1, None, 1), (2, [1.0] * 4, 1), (3, [math.nan] * 5, 1), (4, [None] * 5, 1), (5, [math.inf] * 5, 1), (6, [1.0] * 5, 1), (6, [2.0] * 5, 1), (6, [1.0] * 5, 1)]
    for rows in (random_rows(250, d=5), grouped, copies, odd, [(i, [3e7 * i, -1e8, 0.0, 1.0, 2.0], 1) for i in range(40)]):
        assert ran(whole_centroids(table_of(spark, rows), k=4, rounds=3, d=5)) == plain_clusters(rows, 4, 3, 5)


def test_whole_balls_are_taken():
    rng = np.random.default_rng(4)
    points = np.concatenate([rng.integers(-5, 6, (200, 3)) + c for c in ([0, 0, 0], [1000, 0, 0], [0, 1000, 0])])
    tree = balls.build_tree(np.arange(600), points, leaf=16)
    centroids = np.array([[0, 0, 0], [1000, 0, 0], [0, 1000, 0]])
    cluster, ball = balls.assign(tree, centroids)
    assert (cluster < 0).sum() > 500  # most rows are never looked at
    assert tree["count"][ball >= 0].sum() + (cluster >= 0).sum() == 600
    assert all((tree["total"][b] == points[tree["ids"][tree["begin"][b] : tree["end"][b]]].sum(0)).all() for b in np.flatnonzero(ball >= 0))


def test_empty_tables(spark):
    empty = table_of(spark, random_rows(3)).limit(0)
    assert hard_negatives(empty, F.col("vec_id") % 2 == 0).columns == list(NEGATIVES) and hard_negatives(empty, F.lit(True)).count() == 0
    assert top_products(empty, F.col("vec_id") % 2 == 0).count() == 0
    assert whole_centroids(empty, d=6).count() == 0
    some = table_of(spark, random_rows(3))
    assert hard_negatives(some, F.lit(False)).count() == top_products(some, F.lit(False)).count() == 0


@pytest.mark.parametrize("name", ["op11_hard_negatives", "op12_bit_sliced_search", "op13_ball_tree_centroids"])
def test_queries_equal_their_sql(spark, sf_dir, name):
    con = duckdb.connect()
    con.sql(f"create view embeddings as from '{sf_dir}/embeddings.parquet'")
    got = QUERIES[name](spark, sf_dir)
    want = con.sql(f"select {', '.join(got.columns)} from ({ORACLES[name]})").fetchall()
    assert len(want) > 0 and ran(got) == sorted(want)
