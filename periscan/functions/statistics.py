"""Aggregates that Spark lacks, from its own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def trimmed_mean(share: float) -> Callable[[str], Column]:
    """The mean without the least and the largest ``share`` of the values, rounded down; null and not-a-number values don't count, and of none it is null."""

    def trimmed(column: str) -> Column:
        x = F.col(column).cast("double")
        cut = lambda v: F.floor(F.size(v) * F.lit(share)).cast("int")
        mean = lambda v: F.aggregate(F.slice(v, cut(v) + 1, F.size(v) - 2 * cut(v)), F.lit(0.0), lambda a, y: a + y) / (F.size(v) - 2 * cut(v))
        ordered = F.array(F.sort_array(F.collect_list(F.when(~F.isnan(x), x))))
        return F.element_at(F.transform(ordered, lambda v: F.when(F.size(v) > 2 * cut(v), mean(v))), 1)

    return trimmed
