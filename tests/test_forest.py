"""The forest of the detectability analysis, held against Spark's own and against other partitions of its rows."""

import numpy as np
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from periscan.operators import forest
from periscan.operators.detectability import forest_importance

NAMES = ["a", "b", "c", "d"]


def rows(spark, n=3000):
    """Stars of which ``a`` and, less so, ``b`` decide; ``c`` has few values, a rare one among them, and every row of a tenth of them comes twice."""
    draw = lambda k: F.pmod(F.xxhash64("id", F.lit(k)), F.lit(1_000_003)) / 1_000_003.0
    made = spark.range(n).select(draw(1).alias("a"), draw(2).alias("b"), F.when(F.col("id") % 97 == 0, 5.0).otherwise(F.floor(draw(3) * 3)).alias("c"), draw(4).alias("d"), (2 * draw(1) + draw(2) + draw(5) > 2).alias("y"))
    return made.union(made.limit(n // 10))


def test_partitions_do_not_count(spark):
    stars = rows(spark).localCheckpoint()
    found = [sorted(map(tuple, forest_importance(x, NAMES, "y", trees=8, folds=3).collect())) for x in (stars.coalesce(1), stars.repartition(7, "d"))]
    assert found[0] == found[1]


def test_importances_and_area_are_those_of_sparks_forest(spark):
    stars = rows(spark).localCheckpoint()
    got = {r.parameter: r for r in forest_importance(stars, NAMES, "y", trees=60).collect()}
    data = VectorAssembler(inputCols=NAMES, outputCol="features").transform(stars.withColumn("label", F.col("y").cast("double")))
    want = RandomForestClassifier(numTrees=60, maxDepth=5, minInstancesPerNode=20, seed=1).fit(data)
    assert np.abs(np.array([got[p].importance for p in NAMES]) - want.featureImportances.toArray()).max() < 0.06
    assert abs(sum(r.importance for r in got.values()) - 1) < 1e-9
    train, held = (data.where(F.pmod(F.xxhash64("d"), F.lit(5)) == 0 if k else F.pmod(F.xxhash64("d"), F.lit(5)) != 0) for k in (0, 1))
    area = RandomForestClassifier(numTrees=60, maxDepth=5, minInstancesPerNode=20, seed=1).fit(train).evaluate(held).areaUnderROC
    assert abs(got["a"].auc - area) < 0.04 and area > 0.8


def test_one_tree_by_hand(spark):
    """The sums of a root, and its split, against plain loops over the same draws."""
    known = rows(spark).select(*NAMES, F.col("y").cast("double").alias("label"))
    packed = forest.blocks(known, NAMES, 2, 0).localCheckpoint()
    grown = forest.grow(packed, len(NAMES), 3, 1, 1, 20, 0)
    for fit in range(3):
        cells = []
        for r in packed.collect():
            own = np.frombuffer(r.cells, np.uint8).reshape(-1, r.n)
            times = forest.DRAWN[np.random.default_rng((0, r.block)).integers(0, 1 << 16, r.n, np.uint16)]
            cells += [tuple(map(int, own[:, k])) for k in range(r.n) for _ in range(times[k]) if own[-1, k] != fit]
        best = (-1.0, 0, 0)
        gini = lambda part: 2 * (s := sum(c[-2] for c in part) / len(part)) * (1 - s)
        for p in range(len(NAMES)):
            for last in range(31):
                left, right = [c for c in cells if c[p] <= last], [c for c in cells if c[p] > last]
                if min(len(left), len(right)) >= 20:
                    gain = gini(cells) - (len(left) * gini(left) + len(right) * gini(right)) / len(cells)
                    best = max(best, (gain, p, last), key=lambda x: x[0])
        assert (grown.feature[fit, 0], grown.last[fit, 0]) == best[1:] and abs(grown.weight[fit, 0] - best[0] * len(cells)) < 1e-6
    assert sum(r.n for r in packed.collect()) == known.count()
    few = forest.edges(known, ["c"])[0]
    assert few.tolist() == sorted(r.c for r in known.select("c").distinct().collect())[:-1]
