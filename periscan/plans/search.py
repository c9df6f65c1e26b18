"""Registered queries of the whole search: gathering, fits, the batch tables and the feature table; importing this adds them to the catalogue."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from periscan.operators import comb as C
from periscan.operators import series as S
from periscan.operators.feature_table import feature_table
from periscan.operators.gather import METHODS, Curves, batch, gather
from periscan.plans.catalogue import _ACF, _LC, PEAKS_SQL, dft_sql, query, rounded
from periscan.sources import light_curves as L

_SHORT = dft_sql(8, "1 / 15.0").split(", st AS")[1]


def _second(sql: str) -> str:
    """The chain of a spectrum and its peaks under other names."""
    read = re.sub(r"\b(FROM|JOIN) (st|y|gr|sp|pk|rk)\b", r"\1 \g<2>8", sql)
    return re.sub(r"\b(st|y|gr|sp|pk|rk) AS \(SELECT", r"\g<1>8 AS (SELECT", read)


_BOTH = f"{_LC}{dft_sql()}{PEAKS_SQL}, st8 AS{_second(_SHORT)}{_second(PEAKS_SQL)}"
_POOL = "SELECT star_id, 'acf_fft' AS method, rank, p0, strength FROM rk WHERE rank <= 5 UNION ALL SELECT star_id, 'acf_fft_short', rank, p0, strength FROM rk8 WHERE rank <= 5"
_TRUTH = "tr AS (SELECT star_id, 1.0 + length(star_id) / 4.0 AS true_period FROM (SELECT DISTINCT star_id FROM lc) UNION ALL SELECT 'no curve', 3.0)"


def truths(spark, sf_dir):
    """Made-up periods of the event curves, and a star that has no curve."""
    stars = L.event_curves(spark, sf_dir).select("star_id").distinct().select("star_id", (1.0 + F.length("star_id") / 4.0).alias("true_period"))
    return stars.unionByName(spark.createDataFrame([("no curve", 3.0)], "star_id string, true_period double"))


def event_batch(spark, sf_dir):
    return batch(L.event_curves(spark, sf_dir), truths(spark, sf_dir), 1 / 24, ["acf_fft", "acf_fft_short"])


def planted(spark, sf_dir):
    return Curves.of(L.planted_stars(spark, sf_dir).drop("true_period"), 0.02)


def planted_truth(spark, sf_dir):
    return L.planted_stars(spark, sf_dir).select("star_id", "true_period").distinct()


@query("k10_gathered", f"{_BOTH} SELECT star_id, method, CAST(NULL AS DOUBLE) AS smoothing_window, rank, round(p0, 6) AS p0, round(strength, 6) AS strength FROM ({_POOL})")
def _(spark, sf_dir):
    found, _ = gather(Curves.of(L.event_curves(spark, sf_dir), 1 / 24), ["acf_fft", "acf_fft_short"])
    return rounded(found.drop("coverage"), "p0", "strength")


@query(
    "o4_batch_summary",
    f"""{_BOTH}, {_TRUTH}, po AS ({_POOL}), h AS (SELECT po.*, true_period, abs(p0 - true_period) / true_period <= 0.15 AS hit FROM po JOIN tr USING (star_id))
SELECT star_id, method, CAST(NULL AS DOUBLE) AS smoothing_window, count(*) AS n_candidates, bool_or(hit) AS found_true_period, min(CASE WHEN hit THEN rank END) AS rank_of_true_period, round(arg_min(p0, rank) FILTER (WHERE hit), 6) AS matched_p0, max(true_period) AS true_period FROM h GROUP BY 1, 2""",
)
def _(spark, sf_dir):
    return rounded(event_batch(spark, sf_dir).summary, "matched_p0")


@query("o4_batch_candidates", f"{_BOTH}, {_TRUTH}, po AS ({_POOL}) SELECT star_id, method, CAST(NULL AS DOUBLE) AS smoothing_window, rank, round(p0, 6) AS p0, round(strength, 6) AS strength, true_period, abs(p0 - true_period) / true_period <= 0.15 AS is_match FROM po JOIN tr USING (star_id)")
def _(spark, sf_dir):
    return rounded(event_batch(spark, sf_dir).candidates, "p0", "strength")


_DAILY = """WITH uc AS (SELECT user_id AS star_id, (epoch_us(ts) - 1704067200000000) / 86400000000.0 AS time, value AS flux FROM events), ut AS (SELECT star_id, min(time) AS t0, CAST(floor(max(time) - min(time) - 1e-9) AS BIGINT) AS bins FROM uc GROUP BY 1),
lc AS (SELECT star_id, CAST(floor(time - t0) AS BIGINT) AS i, avg(flux) AS flux FROM uc JOIN ut USING (star_id) WHERE floor(time - t0) < bins GROUP BY 1, 2 HAVING count(flux) > 0)"""
_INNER = "len([g for g in range(1, 2 * n + 1) if g / (4.0::DOUBLE * n) > 2::DOUBLE / (n - 1) * (1 + 1e-12) AND g / (4.0::DOUBLE * n) < 0.25::DOUBLE * (1 - 1e-12)])"


def daily_batch(spark, sf_dir):
    """Daily means of every user's curve, too short for some methods; periods are the users' numbers."""
    lc = S.bin_curve(L.user_curves(spark, sf_dir), 1.0).drop("n")
    known = L.user_curves(spark, sf_dir).select("star_id").distinct().withColumn("true_period", F.col("star_id").cast("double"))
    return batch(lc, known, 1.0, ["acf_fft", "lombscargle"])


@query(
    "o6_batch_failures",
    f"""{_DAILY}{_ACF}, sz AS (SELECT star_id, count(*) AS n FROM acf WHERE isfinite(acf) GROUP BY 1), pt AS (SELECT star_id, count(*) AS points FROM lc GROUP BY 1)
SELECT star_id, 'acf_fft' AS method, 'ValueError: fewer than three frequencies in the band' AS error FROM sz WHERE n < 4 OR {_INNER} < 3
UNION ALL SELECT star_id, 'lombscargle', 'fewer than ten finite points: ' || points FROM sz JOIN pt USING (star_id) WHERE points < 10
UNION ALL SELECT star_id, '__load_or_acf__', 'no points, or one value only' FROM (SELECT DISTINCT star_id FROM uc) WHERE star_id NOT IN (SELECT star_id FROM sz)""",
)
def _(spark, sf_dir):
    return daily_batch(spark, sf_dir).failures


@query(
    "o1_method_outcomes",
    f"{_BOTH}, {_TRUTH}, po AS ({_POOL}), ms AS (SELECT star_id, method FROM (SELECT DISTINCT star_id FROM lc), (VALUES ('acf_fft'), ('acf_fft_short')) m(method)) SELECT method, count(DISTINCT ms.star_id) AS stars, count(DISTINCT po.star_id) AS with_candidates, count(po.p0) AS candidates FROM ms LEFT JOIN po USING (star_id, method) GROUP BY 1",
)
def _(spark, sf_dir):
    """What each method that was asked for gave over the event curves."""
    curves = Curves.of(L.event_curves(spark, sf_dir), 1 / 24)
    found, failed = gather(curves, ["acf_fft", "acf_fft_short"])
    stars = found.select("star_id", "method", "p0").unionByName(failed.select("star_id", "method", F.lit(None).cast("double").alias("p0")))
    return stars.groupBy("method").agg(F.count_distinct("star_id").alias("stars"), F.count_distinct(F.when(F.col("p0").isNotNull(), F.col("star_id"))).alias("with_candidates"), F.count("p0").alias("candidates"))


@query("o5_batch_every_window")
def _(spark, sf_dir):
    """All methods over planted stars, with a row for each window of the high-pass sweep."""
    lc = L.planted_stars(spark, sf_dir)
    return rounded(batch(lc.drop("true_period"), planted_truth(spark, sf_dir), 0.02, list(METHODS), every_window=True).summary, "matched_p0")


@query("o1_methods", "SELECT unnest(['acf_fft', 'acf_fft_highpass', 'acf_fft_short', 'lombscargle', 'lombscargle_short', 'pairwise_histogram', 'wavelet']) AS method")
def _(spark, sf_dir):
    return spark.createDataFrame([(m,) for m in sorted(METHODS)], "method string")


@query("l4_outcomes")
def _(spark, sf_dir):
    """The chosen period of every planted star, from the candidates of the three default methods."""
    curves = planted(spark, sf_dir)
    found, _ = gather(curves)
    return rounded(C.outcomes(curves.series, found, C.rotation_periods(curves.series, found, curves.dt)), "p", "t0")


@query("n_feature_table")
def _(spark, sf_dir):
    return feature_table(planted(spark, sf_dir), planted_truth(spark, sf_dir))
