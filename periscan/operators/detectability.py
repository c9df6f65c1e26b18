"""How parameters of a star bear on whether its period is found."""

from __future__ import annotations

from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from periscan.operators import forest as T
from periscan.session import materialize


def forest_importance(stars: DataFrame, parameters: list[str], label: str, trees: int = 500, depth: int = 5, leaf: int = 20, folds: int = 5, seed: int = 0) -> DataFrame:
    """(parameter, importance, auc): a forest's importances, and the mean area under the curve over ``folds`` held-out parts.

    Rows with a null are left out. The folds are dealt by a hash of the whole row, and nothing depends on partitions. Bins of the parameters, which know no
    labels, are those of all rows; each fold's forest is grown without its rows.
    """
    spark = stars.sparkSession
    known = materialize(stars.select(*(F.col(p).cast("double") for p in parameters), F.col(label).cast("double").alias("label")).dropna(), "stars")
    packed = T.blocks(known, parameters, folds, seed)
    grown = T.grow(packed, len(parameters), folds + 1, trees, depth, leaf, seed)
    scored = materialize(T.held_out(packed, grown, trees, folds), "scores")
    area = BinaryClassificationEvaluator(rawPredictionCol="score")
    auc = sum(area.evaluate(scored.where(F.col("fold") == k)) for k in range(folds)) / folds
    rows = [(p, float(x), auc) for p, x in zip(parameters, T.importances(grown, folds * trees, len(parameters)), strict=True)]
    return spark.createDataFrame(rows, "parameter string, importance double, auc double")
