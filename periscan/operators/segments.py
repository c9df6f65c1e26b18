"""Curves cut into segments at the gaps nearest their expected boundaries; flags of odd segments; recombination."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from periscan.operators.series import candidate_gaps, rolling_std


def _breaks(times: np.ndarray, gaps: pd.DataFrame, n_segments: int, tol_frac: float) -> list[tuple]:
    """(position, time, matched, gap start, gap end): from each boundary a segment's length on, the nearest unused gap, else that point."""
    length = (times[-1] - times[0]) / n_segments
    centers, unused = gaps["center_time"].to_numpy(float), np.ones(len(gaps), bool)
    now, out = times[0], []
    for _ in range(n_segments - 1):
        aim = now + length
        far = np.where(unused, np.abs(centers - aim), np.inf)
        if len(far) and far.min() <= tol_frac * length:
            k = int(np.flatnonzero(far == far.min())[-1])
            unused[k] = False
            start, width = int(gaps["start_i"].iloc[k]), int(gaps["width"].iloc[k])
            out.append((start + width // 2, centers[k], True, start, start + width - 1))
        else:
            at = int(np.clip(np.searchsorted(times, aim), 1, len(times) - 1))
            out.append((at, times[at], False, None, None))
        now = out[-1][1]
    return sorted(out, key=lambda b: b[0])


def breaks(lc: DataFrame, gaps: DataFrame, n_segments: int = 27, tol_frac: float = 0.4) -> DataFrame:
    """(star_id, at, break_time, matched, gap_start, gap_end) by the walk along each star; positions count a star's points from 0."""
    star_type = lc.schema["star_id"].dataType.simpleString()
    names = ["at", "break_time", "matched", "gap_start", "gap_end"]

    def run(curve: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        times = np.sort(curve["time"].to_numpy(float))
        rows = _breaks(times, found.sort_values("center_time"), n_segments, tol_frac) if len(times) > 1 else []
        out = pd.DataFrame(rows, columns=names).astype({"gap_start": "Int64", "gap_end": "Int64", "at": "int64"})
        out.insert(0, "star_id", curve["star_id"].iloc[0] if len(curve) else None)
        return out.astype({"star_id": object, "matched": object})

    both = lc.select("star_id", "time").groupBy("star_id").cogroup(gaps.select(F.col("star_id").alias("star"), "start_i", "width", "center_time").groupBy("star"))
    return both.applyInPandas(run, f"star_id {star_type}, at long, break_time double, matched boolean, gap_start long, gap_end long")


def split_segments(lc: DataFrame, n_segments: int = 27, tol_frac: float = 0.4, n_mad: float = 5.0, roll_window: int = 9, **gap_options) -> tuple[DataFrame, DataFrame]:
    """Points with segment and gap_mask, and (star_id, segment, segment_std, roll_median, flagged) of every segment.

    A segment is flagged if the deviation of its points outside gaps lies ``n_mad``
    robust deviations from its star's median either way, or the logarithm of its median rolling deviation as far below.
    """
    order = Window.partitionBy("star_id").orderBy("time")
    points = lc.withColumn("i", (F.row_number().over(order) - 1).cast("long"))
    cut = breaks(points, candidate_gaps(points, roll_window, **gap_options), n_segments, tol_frac)
    held = cut.groupBy("star_id").agg(F.collect_list("at").alias("cuts"), F.collect_list(F.when(F.col("matched"), F.struct(F.col("gap_start").alias("a"), F.col("gap_end").alias("b")))).alias("gaps"))
    marked = rolling_std(points, roll_window).join(held, "star_id", "left").select(
        *points.columns,
        "roll",
        F.expr("coalesce(size(filter(cuts, c -> c <= i)), 0)").alias("segment"),
        F.expr("coalesce(exists(gaps, g -> i between g.a and g.b), false)").alias("gap_mask"),
    )
    stats = marked.groupBy("star_id", "segment").agg(F.stddev_pop(F.when(~F.col("gap_mask"), F.col("flux"))).alias("segment_std"), F.expr("percentile(roll, 0.5)").alias("roll_median"))
    stats = stats.withColumn("log_roll", F.when(F.col("roll_median") > 0, F.log10("roll_median")))
    star = Window.partitionBy("star_id")
    for column in ("segment_std", "log_roll"):
        stats = stats.withColumn("middle", F.expr(f"percentile({column}, 0.5)").over(star)).withColumn("off", F.abs(F.col(column) - F.col("middle")))
        sigma = 1.4826 * F.expr("percentile(off, 0.5)").over(star)
        beyond = F.col("off") if column == "segment_std" else F.col("middle") - F.col(column)
        stats = stats.withColumn(f"odd_{column}", F.coalesce((sigma > 0) & (beyond > n_mad * sigma), F.lit(False)))
    zero = F.col("roll_median") == 0  # its logarithm lies below any bound
    flagged = F.col("odd_segment_std") | F.col("odd_log_roll") | F.coalesce(zero, F.lit(False))
    return marked.drop("roll"), stats.select("star_id", "segment", "segment_std", "roll_median", flagged.alias("flagged"))


def recombine(points: DataFrame, stats: DataFrame, drop_gap_points: bool = True, drop_flagged: bool = True, sectors: list[int] | None = None) -> DataFrame:
    """Points of the segments that stay. Two segments make a sector (numbered from 1).

    With ``sectors``, only those, each whole: a sector with a flagged segment goes.
    Without, flagged segments go one by one, if ``drop_flagged``.
    """
    sector = (F.floor(F.col("segment") / 2) + 1).cast("int")
    marked = stats.select("star_id", "segment", "flagged").withColumn("sector", sector)
    if sectors is None:
        kept = marked.where(~F.col("flagged")) if drop_flagged else marked
    else:
        whole = F.max("flagged").over(Window.partitionBy("star_id", "sector"))
        kept = marked.where(F.col("sector").isin(sectors)).withColumn("any", whole).where(~F.col("any"))
    out = points.join(kept.select("star_id", "segment", "sector"), ["star_id", "segment"])
    return out.where(~F.col("gap_mask")) if drop_gap_points else out
