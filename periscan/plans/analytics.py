"""Registered queries of the detectability analytics; importing this adds them to the catalogue."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from periscan.functions.significance import correlation_p
from periscan.operators import benchmark as B
from periscan.operators import detectability as R
from periscan.operators.gather import batch
from periscan.plans.catalogue import _SUMMARY, PRIORITIES, query, rounded
from periscan.plans.evidence import _sweep_sql as _sweep_windows_sql
from periscan.sources import light_curves as L

# Parameters of the zero-candidate table, of the rank correlations, and of the sweeps.
ZERO_PARAMETERS = ["activity", "diffrot", "tspot", "minlat", "maxlat", "incl"]
RANK_PARAMETERS = ["period", "activity", "cycle", "overlap", "incl", "minlat", "maxlat", "abs_diffrot", "tspot"]
SWEEP_PARAMETERS = ["activity", "diffrot", "period", "minlat", "tspot", "incl"]
BAND_PARAMETERS = ["activity", "diffrot", "minlat", "maxlat", "tspot", "incl"]
#: Stand-in ceilings of the periods of each method.
CEILINGS = dict(zip(PRIORITIES, (59.5, 119.0, 40.0, 80.0, 20.0), strict=True))
CUTOFF = 50.0

_PARAMS = """, prm AS (SELECT c_custkey AS star_id, round(abs(c_acctbal) / 100.0, 4) AS period, (c_custkey * 31) % 97 / 10.0 + 0.1 AS activity, c_custkey % 11 + 1.0 AS cycle, (c_custkey * 7) % 13 / 10.0 AS overlap, CAST((c_custkey * 37) % 91 AS DOUBLE) AS incl,
CAST(c_custkey * 17 % 45 AS DOUBLE) AS minlat, CAST(c_custkey * 17 % 45 AS DOUBLE) + c_custkey % 40 AS maxlat, ((c_custkey * 29) % 101 - 50) / 100.0 AS diffrot, CAST((c_custkey * 53) % 1000 AS DOUBLE) AS tspot FROM customer),
sm AS (SELECT s.star_id, s.method, n_candidates, found, prm.* EXCLUDE (star_id) FROM s JOIN prm ON prm.star_id = s.star_id)"""
_CELLS = " + ".join(f"coalesce(max(found) FILTER (WHERE method = '{m}'), 1)" for m in PRIORITIES)
_STARS = f"""{_SUMMARY}{_PARAMS}, nf AS (SELECT star_id, {_CELLS} AS n_methods_found FROM s GROUP BY 1), merged AS (SELECT prm.*, abs(diffrot) AS abs_diffrot, n_methods_found, n_methods_found >= 5 AS found_by_all FROM nf JOIN prm USING (star_id)), restricted AS (SELECT * FROM merged WHERE period <= 50)"""


def summary(spark, sf_dir):
    """The stand-in summary with all parameters of its stars; those win where names clash."""
    rows = L.batch_summary(spark, sf_dir).drop("period", "activity")
    return rows.join(L.star_parameters(spark, sf_dir), "star_id")


def merged(spark, sf_dir):
    """Stars with their parameters, how many methods found them, and whether all did (nearly every star is found by one)."""
    stars = L.star_parameters(spark, sf_dir).withColumn("abs_diffrot", F.abs("diffrot"))
    counts = B.found_by_star(L.batch_summary(spark, sf_dir), PRIORITIES)
    return stars.join(counts, "star_id").withColumn("found_by_all", F.col("n_methods_found") >= len(PRIORITIES))


def restricted(spark, sf_dir):
    return merged(spark, sf_dir).where(F.col("period") <= CUTOFF)


@query("p1_ceilings", f"{_SUMMARY}, c(method, cut) AS (VALUES " + ", ".join(f"('{m}', {c!r}::DOUBLE)" for m, c in CEILINGS.items()) + ") SELECT method, cut AS predicted_cutoff_days, round(avg(CASE WHEN period <= cut THEN found END), 6) AS hit_rate_below, count(*) FILTER (WHERE period <= cut) AS n_below, round(avg(CASE WHEN period > cut THEN found END), 6) AS hit_rate_above, count(*) FILTER (WHERE period > cut) AS n_above FROM c LEFT JOIN s USING (method) GROUP BY 1, 2")
def _(spark, sf_dir):
    return rounded(B.ceilings(L.batch_summary(spark, sf_dir), CEILINGS), "hit_rate_below", "hit_rate_above")


_ZERO = " UNION ALL ".join(f"SELECT method, '{p}' AS parameter, z, {'abs(diffrot)' if p == 'diffrot' else p} AS x FROM zz" for p in ZERO_PARAMETERS)


def zero_table(spark, sf_dir):
    rows = summary(spark, sf_dir).withColumn("diffrot", F.abs("diffrot"))
    return B.zero_candidate_correlations(rows, ZERO_PARAMETERS, F.col("n_candidates") <= 1)


@query(
    "p3_zero_all_parameters",
    f"{_SUMMARY}{_PARAMS}, zz AS (SELECT *, CASE WHEN n_candidates <= 1 THEN 1 ELSE 0 END AS z FROM sm), u AS ({_ZERO}) SELECT method, parameter, round(corr(z, x), 6) AS point_biserial_r, round(avg(z), 6) AS zero_candidate_rate, round(quantile_cont(x, 0.5) FILTER (WHERE z = 1), 6) AS median_when_zero, round(quantile_cont(x, 0.5) FILTER (WHERE z = 0), 6) AS median_when_nonzero, count(*) AS n FROM u GROUP BY 1, 2 HAVING avg(z) > 0",
)
def _(spark, sf_dir):
    return rounded(zero_table(spark, sf_dir), "point_biserial_r", "zero_candidate_rate", "median_when_zero", "median_when_nonzero")


@query("p3_zero_all_parameters_p")
def _(spark, sf_dir):
    return zero_table(spark, sf_dir).withColumn("p_value", correlation_p("point_biserial_r", "n"))


@query(
    "p4_zero_rate_by_activity",
    f"{_SUMMARY}{_PARAMS}, sub AS (SELECT * FROM sm WHERE star_id IN (SELECT star_id FROM prm WHERE period <= 50)), e AS (SELECT [lo * power(hi / lo, k / 8.0) for k in range(0, 9)] AS edges FROM (SELECT greatest(min(activity), 0.01) AS lo, max(activity) AS hi FROM sub)), "
    f"b AS (SELECT *, len([v for v in edges if v < activity]) AS below FROM sub, e WHERE method IN ('{PRIORITIES[0]}', '{PRIORITIES[3]}')) SELECT method, CAST(below - 1 AS INTEGER) AS bin, round(avg(CASE WHEN n_candidates <= 1 THEN 1 ELSE 0 END), 6) AS zero_rate, count(*) AS n FROM b WHERE below BETWEEN 1 AND 8 GROUP BY 1, 2",
)
def _(spark, sf_dir):
    stars = L.star_parameters(spark, sf_dir).where(F.col("period") <= CUTOFF)
    return rounded(B.zero_rate_by_activity(summary(spark, sf_dir), stars, [PRIORITIES[0], PRIORITIES[3]], F.col("n_candidates") <= 1), "zero_rate")


@query("p5_pivot_first", f"{_STARS} SELECT star_id, period, n_methods_found, n_methods_found > 0 AS found_by_any FROM restricted")
def _(spark, sf_dir):
    return restricted(spark, sf_dir).select("star_id", "period", "n_methods_found", "found_by_any")


@query(
    "p6_spearman_all",
    f"{_STARS}, "
    + ", ".join(f"k{i} AS (SELECT rank() OVER (ORDER BY {p}) + (count(*) OVER (PARTITION BY {p}) - 1) / 2.0 AS rp, rank() OVER (ORDER BY n_methods_found) + (count(*) OVER (PARTITION BY n_methods_found) - 1) / 2.0 AS ra FROM restricted)" for i, p in enumerate(RANK_PARAMETERS))
    + ", al AS ("
    + " UNION ALL ".join(f"SELECT '{p}' AS parameter, round(corr(rp, ra), 6) AS spearman_rho, count(*) AS n FROM k{i}" for i, p in enumerate(RANK_PARAMETERS))
    + ") SELECT *, row_number() OVER (ORDER BY abs(spearman_rho) DESC, parameter) AS place FROM al",
)
def _(spark, sf_dir):
    found = rounded(B.rank_correlations(restricted(spark, sf_dir), RANK_PARAMETERS, "n_methods_found"), "spearman_rho")
    # a row for each parameter
    return found.withColumn("place", F.row_number().over(Window.orderBy(F.desc(F.abs("spearman_rho")), "parameter")))


@query("p6_spearman_all_p")
def _(spark, sf_dir):
    return B.rank_correlations(restricted(spark, sf_dir), RANK_PARAMETERS, "n_methods_found").withColumn("p_value", correlation_p("spearman_rho", "n"))


def _sweep_sql(table: str, parameters: list[str], n: int, low: str | None = None, band: str = "") -> str:
    long = " UNION ALL ".join(f"SELECT '{p}' AS parameter, {p} AS x, found_by_all AS y, period FROM {table}" for p in parameters)
    key = "band, " if band else ""
    banded = f", bd AS (SELECT CASE WHEN period > 50 THEN 4 WHEN period > 20 THEN 3 WHEN period > 10 THEN 2 WHEN period > 1 THEN 1 WHEN period > 0 THEN 0 END AS band, count(*) AS size FROM {table} GROUP BY 1 HAVING count(*) >= 10)" if band else ""
    return f"""{_STARS}, u AS ({long}), e AS (SELECT parameter AS ep, [lo + (hi - lo) * k / {n} for k in range(0, {n + 1})] AS edges FROM (SELECT parameter, {low or 'min(x)'} AS lo, max(x) AS hi FROM u WHERE {'period > 0' if band else 'true'} GROUP BY 1)){banded},
b AS (SELECT u.*, len([v for v in edges if v < x]) AS below, CASE WHEN period > 50 THEN 4 WHEN period > 20 THEN 3 WHEN period > 10 THEN 2 WHEN period > 1 THEN 1 WHEN period > 0 THEN 0 END AS band FROM u JOIN e ON ep = parameter)
SELECT parameter, {key}CAST(below - 1 AS INTEGER) AS bin, round(avg(y::INT), 6) AS rate, count(*) AS n FROM b {'JOIN bd USING (band)' if band else ''} WHERE below BETWEEN 1 AND {n} GROUP BY ALL"""


@query("p7_rate_by_diffrot", _sweep_sql("restricted", ["abs_diffrot"], 7, "0.0::DOUBLE"))
def _(spark, sf_dir):
    return rounded(B.sweeps(restricted(spark, sf_dir), ["abs_diffrot"], "found_by_all", 7, low=0.0), "rate")


@query("p8_parameter_sweeps", _sweep_sql("restricted", SWEEP_PARAMETERS, 8))
def _(spark, sf_dir):
    return rounded(B.sweeps(restricted(spark, sf_dir), SWEEP_PARAMETERS, "found_by_all", 8), "rate")


@query("p9_sweeps_by_band", _sweep_sql("merged", BAND_PARAMETERS, 6, band="band"))
def _(spark, sf_dir):
    return rounded(B.sweeps(merged(spark, sf_dir), BAND_PARAMETERS, "found_by_all", 6, bands=True), "rate")


@query("p11_star_totals", f"{_SUMMARY} SELECT star_id, CAST(sum(n_candidates) AS BIGINT) AS n_candidates, max(found) > 0 AS found, max(period) AS period FROM s GROUP BY 1")
def _(spark, sf_dir):
    return B.star_totals(L.batch_summary(spark, sf_dir))


@query("p11_missed_fast_stars", f"{_SUMMARY}, t AS (SELECT star_id, max(found) AS found, max(period) AS period FROM s GROUP BY 1), m AS (SELECT star_id, period, row_number() OVER (ORDER BY star_id) AS n FROM t WHERE period < 20 AND found = 0) SELECT star_id, period FROM m WHERE n % 10 = 1")
def _(spark, sf_dir):
    """Every tenth of the fast stars that no method found, as the report that feeds the next batch takes them."""
    missed = B.star_totals(L.batch_summary(spark, sf_dir)).where("period < 20 and not found").select("star_id", "period")
    return B.average_rank(missed, "star_id", "n").where("n % 10 = 1").drop("n")


@query("p10_feature_importance")
def _(spark, sf_dir):
    """Of all ten parameters, from five hundred trees."""
    return R.forest_importance(restricted(spark, sf_dir), [*RANK_PARAMETERS, "bfly"], "found_by_all")


_WINDOWS = (2, 5, 10, 20, 40)
_SWEPT = f"""sw AS (SELECT star_id, window_days, p0 FROM ({_sweep_windows_sql(_WINDOWS)})), wt AS (SELECT star_id, w::DOUBLE AS smoothing_window, 0.5 + length(star_id) * length(star_id) / 8.0 AS true_period FROM (SELECT DISTINCT event_type AS star_id FROM events), (VALUES (2), (5), (10), (20), (40)) v(w)),
ht AS (SELECT wt.star_id, smoothing_window, true_period, coalesce(bool_or(abs(p0 - true_period) / true_period <= 0.15), false) AS found FROM wt LEFT JOIN sw ON sw.star_id = wt.star_id AND sw.window_days = smoothing_window GROUP BY 1, 2, 3)"""


def swept_batch(spark, sf_dir):
    """The high-pass sweep over the event curves, with made-up periods of half a day to 18 days."""
    lc = L.event_curves(spark, sf_dir)
    known = lc.select("star_id").distinct().select("star_id", (0.5 + F.length("star_id") * F.length("star_id") / 8.0).alias("true_period"))
    return batch(lc, known, 1 / 24, ["acf_fft_highpass"], every_window=True).summary


@query("o8_rate_by_window", f"WITH {_SWEPT} SELECT smoothing_window, round(avg(found::INT), 6) AS hit_rate, count(*) AS n FROM ht GROUP BY 1")
def _(spark, sf_dir):
    return rounded(B.rate_by_window(swept_batch(spark, sf_dir)), "hit_rate")


@query(
    "o8_rate_by_window_and_band",
    f"WITH {_SWEPT} SELECT smoothing_window, CASE WHEN true_period > 50 THEN 4 WHEN true_period > 20 THEN 3 WHEN true_period > 10 THEN 2 WHEN true_period > 1 THEN 1 WHEN true_period > 0 THEN 0 END AS band, round(avg(found::INT), 6) AS hit_rate, count(*) AS n FROM ht GROUP BY 1, 2",
)
def _(spark, sf_dir):
    return rounded(B.rate_by_window_and_band(swept_batch(spark, sf_dir)), "hit_rate")


@query("p5_merged_stars", f"{_STARS}, mg AS (SELECT nf.star_id, period, activity, diffrot, incl FROM nf JOIN prm USING (star_id)) SELECT mg.*, n_methods_found, n_methods_found > 0 AS found_by_any FROM mg JOIN nf USING (star_id)")
def _(spark, sf_dir):
    return B.merged_stars(summary(spark, sf_dir), PRIORITIES, ["period", "activity", "diffrot", "incl"])


_OUT = "SELECT star_id, 'acf_fft_highpass' AS method, smoothing_window, count(p0) AS n_candidates, bool_or(coalesce(hit, false)) AS found_true_period, min(CASE WHEN hit THEN rank END) AS rank_of_true_period, round(arg_min(p0, rank) FILTER (WHERE hit), 6) AS matched_p0, max(true_period) AS true_period"


@query("o5_event_windows", f"WITH {_SWEPT}, sr AS (SELECT star_id, window_days, p0, rank FROM ({_sweep_windows_sql(_WINDOWS)})), rw AS (SELECT wt.*, p0, rank, abs(p0 - true_period) / true_period <= 0.15 AS hit FROM wt LEFT JOIN sr ON sr.star_id = wt.star_id AND sr.window_days = smoothing_window) {_OUT} FROM rw GROUP BY star_id, smoothing_window")
def _(spark, sf_dir):
    """A row for each event curve and window of the sweep, whatever it found."""
    return rounded(swept_batch(spark, sf_dir), "matched_p0")
