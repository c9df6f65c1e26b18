"""Registered queries for evidence of periods and for pools of candidates; importing this adds them to the catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from periscan.functions.significance import correlation_p
from periscan.operators import benchmark as B
from periscan.operators import evidence as E
from periscan.operators import pools as P
from periscan.operators import segments as G
from periscan.operators import spectra as K
from periscan.plans.catalogue import _ACF, _CANDIDATES, _DFT, _LC, _SUMMARY, _USERS, PEAKS_SQL, dense_curves, dft_sql, event_acf, event_spectrum, query, rounded, summary_candidates
from periscan.session import materialize, table
from periscan.sources import light_curves as L

TARGETS = [0.5, 1.0, 2.0]


def _stars(spark, sf_dir, name: str, values: list[float]):
    return L.event_curves(spark, sf_dir).select("star_id").distinct().select("star_id", F.explode(F.array(*map(F.lit, values))).alias(name))


@query(
    "n9_nearest_peaks",
    _LC
    + _DFT
    + """, tg AS (SELECT star_id, p FROM (SELECT DISTINCT star_id FROM sp), (SELECT unnest([0.5, 1.0, 2.0]) AS p)),
pk AS (SELECT *, lag(power) OVER w AS before, lead(power) OVER w AS after FROM sp WINDOW w AS (PARTITION BY star_id ORDER BY g)),
tp AS (SELECT star_id, g, 1 / freq AS x, power, row_number() OVER (PARTITION BY star_id ORDER BY power DESC, g) AS r FROM pk WHERE power > before AND power > after),
nr AS (SELECT tg.star_id, p, arg_min(g, abs(x - p)) AS pg, arg_min(x, abs(x - p)) AS px, arg_min(power, abs(x - p)) AS pp, arg_min(r, abs(x - p)) AS peak_rank FROM tg JOIN tp USING (star_id) GROUP BY 1, 2),
wh AS (SELECT star_id, max(power) AS most, quantile_cont(power, 0.5) AS mid, min(g) AS g0, max(g) AS g1 FROM sp GROUP BY 1),
e AS (SELECT nr.star_id, p, max(CASE WHEN sp.g < pg THEN sp.g END) AS l, min(CASE WHEN sp.g > pg THEN sp.g END) AS r FROM nr JOIN sp ON sp.star_id = nr.star_id AND sp.power <= pp / 2 GROUP BY 1, 2)
SELECT nr.star_id, nr.p, peak_rank, round(pp / most, 5) AS frac_power, round(abs(px - nr.p) / nr.p, 5) AS rel_distance, round(abs(1 / a.freq - 1 / b.freq), 5) AS width, round(pp / mid, 4) AS snr, abs(px - nr.p) / nr.p <= 0.03 AS recognised
FROM nr JOIN wh USING (star_id) LEFT JOIN e ON e.star_id = nr.star_id AND e.p = nr.p JOIN sp a ON a.star_id = nr.star_id AND a.g = coalesce(l, g0) JOIN sp b ON b.star_id = nr.star_id AND b.g = coalesce(e.r, g1)""",
)
def _(spark, sf_dir):
    spectrum = materialize(event_spectrum(spark, sf_dir), "spectrum")
    found = E.nearest_peaks(spectrum, _stars(spark, sf_dir, "p", TARGETS)).drop("peak_power")
    return rounded(rounded(found, "frac_power", "rel_distance", "width", places=5), "snr", places=4)


@query(
    "n8_trough_depths",
    _LC
    + _ACF
    + """, d AS (SELECT star_id, n, 0.5 - min(acf) AS depth FROM acf, (SELECT unnest(range(0, 5)) AS n) WHERE abs(lag - (0.13 + n)) <= 0.5 GROUP BY 1, 2),
s AS (SELECT star_id, stddev_pop(acf) AS sd FROM acf GROUP BY 1)
SELECT star_id, 1.0::DOUBLE AS p, round(avg(depth), 6) AS mean_depth, round(avg(depth) / max(sd), 6) AS mean_depth_snr, round(min(depth), 6) AS min_depth, round(min(depth) / max(sd), 6) AS min_depth_snr, round(stddev_pop(depth), 6) AS std_depth, round(stddev_pop(depth) / max(sd), 6) AS std_depth_snr FROM d JOIN s USING (star_id) GROUP BY 1""",
)
def _(spark, sf_dir):
    series = materialize(event_acf(spark, sf_dir), "acf")
    teeth = series.select("star_id").distinct().select("star_id", F.lit(1.0).alias("p"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("n")).withColumns({"center": 0.13 + F.col("n"), "height": F.lit(0.5)})
    out = E.trough_depths(teeth, series)
    return rounded(out, *out.columns[2:])


@query(
    "m3_peak_prominence",
    _LC
    + _ACF
    + """, nr AS (SELECT star_id, "at", lag, acf FROM acf, (SELECT unnest([1.01, 2.01]) AS "at") WHERE abs(lag - "at") <= 0.5),
tp AS (SELECT star_id, "at", max(acf) AS g, arg_max(lag, acf) AS pl FROM nr GROUP BY 1, 2 HAVING count(*) >= 3)
SELECT star_id, 1.0::DOUBLE AS p, "at"::DOUBLE AS "at", round(g, 6) AS g_height, round(pl, 6) AS peak_lag, round(min(acf) FILTER (WHERE lag <= pl), 6) AS left_min, round(min(acf) FILTER (WHERE lag >= pl), 6) AS right_min, round(g - (min(acf) FILTER (WHERE lag <= pl) + min(acf) FILTER (WHERE lag >= pl)) / 2, 6) AS h_rise FROM nr JOIN tp USING (star_id, "at") GROUP BY star_id, "at", g, pl""",
)
def _(spark, sf_dir):
    series = materialize(event_acf(spark, sf_dir), "acf")
    places = _stars(spark, sf_dir, "at", [1.01, 2.01]).withColumn("p", F.lit(1.0))
    return rounded(E.peak_prominence(series, places), "g_height", "peak_lag", "left_min", "right_min", "h_rise")


@query(
    "n11_competition",
    """WITH f AS (SELECT o_custkey AS star_id, o_orderkey AS cand_id, round(o_totalprice / 5000, 6) AS p, (o_orderkey % 97 + 1) / 10.0 AS redchi FROM orders),
b AS (SELECT star_id, arg_min(p, redchi * 1e9 + cand_id) AS bp, min(redchi) AS br, arg_min(cand_id, redchi * 1e9 + cand_id) AS bc FROM f GROUP BY 1),
c AS (SELECT x.star_id, x.cand_id, count(*) FILTER (WHERE abs(y.p - x.p) <= 0.03 * x.p) - 1 AS n_agreeing, min(y.redchi) FILTER (WHERE abs(y.p - x.p) > 0.03 * x.p) AS rival FROM f x JOIN f y ON x.star_id = y.star_id GROUP BY 1, 2)
SELECT f.star_id, f.cand_id, f.p, round(redchi, 6) AS redchi, n_agreeing, round(rival, 6) AS best_competing_redchi, round(redchi / rival, 6) AS ratio_to_competing, round(redchi / br, 6) AS ratio_to_best, f.cand_id = bc AS is_global_best,
round(CASE WHEN f.cand_id <> bc AND abs(p / bp - 1) > 0.03 THEN CASE WHEN abs(p / bp * 3 - 1) <= 0.03 THEN 1.0 / 3 WHEN abs(p / bp - 0.5) / 0.5 <= 0.03 THEN 0.5 WHEN abs(p / bp - 2) / 2 <= 0.03 THEN 2.0 WHEN abs(p / bp - 3) / 3 <= 0.03 THEN 3.0 END END, 6) AS harmonic_factor
FROM f JOIN b USING (star_id) JOIN c ON c.star_id = f.star_id AND c.cand_id = f.cand_id""",
)
def _(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    fits = o.select(F.col("o_custkey").alias("star_id"), F.col("o_orderkey").alias("cand_id"), F.round(F.col("o_totalprice") / 5000, 6).alias("p"), ((F.col("o_orderkey") % 97 + 1) / 10.0).alias("redchi"))
    return rounded(E.competition(fits), "redchi", "best_competing_redchi", "ratio_to_competing", "ratio_to_best", "harmonic_factor")


@query(
    "n10_band_power",
    _LC
    + """, v AS (SELECT star_id, avg(flux) AS m, min(i) AS lo, max(i) - min(i) + 1 AS n FROM lc GROUP BY 1 HAVING count(*) >= 20),
y AS (SELECT lc.star_id, i - lo AS k, n, (flux - m) * (0.5 - 0.5 * cos(2 * pi() * (i - lo) / (n - 1))) AS y FROM lc JOIN v USING (star_id)),
gr AS (SELECT star_id, n, unnest(range(1, n + 1)) AS j FROM v),
pw AS (SELECT star_id, j, n, power(sum(y * cos(2 * pi() * ((j * k) % (2 * n)) / (2 * n))), 2) + power(sum(y * sin(2 * pi() * ((j * k) % (2 * n)) / (2 * n))), 2) AS power FROM gr JOIN y USING (star_id, n) GROUP BY 1, 2, 3)
SELECT star_id, round(sum(CASE WHEN j >= n * 0.5 THEN power ELSE 0 END) / sum(power), 6) AS band_1, round(sum(CASE WHEN j >= n * 0.125 THEN power ELSE 0 END) / sum(power), 6) AS band_2, round(sum(CASE WHEN j >= n * 0.03125 THEN power ELSE 0 END) / sum(power), 6) AS band_3 FROM pw GROUP BY 1""",
)
def _(spark, sf_dir):
    return rounded(E.band_power(L.event_curves(spark, sf_dir)), "band_1", "band_2", "band_3")


_HP = """, x{k} AS (SELECT star_id || '|{d}' AS star_id, i, time, flux - CASE WHEN count(flux) OVER w >= {least} THEN avg(flux) OVER w END AS flux FROM base WINDOW w AS (PARTITION BY star_id ORDER BY i ROWS BETWEEN {half} PRECEDING AND {rest} FOLLOWING))"""


def _sweep_sql(windows: tuple[int, ...]) -> str:
    highpassed = "".join(_HP.format(k=k, d=d, least=8 * d, half=12 * d, rest=12 * d - 1) for k, d in enumerate(windows))
    union = " UNION ALL ".join(f"SELECT * FROM x{k} WHERE flux IS NOT NULL" for k in range(len(windows)))
    return f"""{_LC.replace("lc AS (", "base AS (")}{highpassed}, lc AS ({union}){dft_sql(8, "1 / 50.0")}{PEAKS_SQL}
SELECT split_part(star_id, '|', 1) AS star_id, split_part(star_id, '|', 2)::DOUBLE AS window_days, 'acf_fft_hp' || split_part(star_id, '|', 2) || 'd' AS method, rank, round(p0, 6) AS p0, round(strength, 6) AS strength FROM rk WHERE rank <= 5"""


@query("k6_highpass_sweep", _sweep_sql((2, 5)))
def _(spark, sf_dir):
    return rounded(P.highpass_sweep(L.event_curves(spark, sf_dir), 1 / 24, [2, 5]), "p0", "strength")


@query("k6_highpass_sweep_full", _sweep_sql((2, 5, 10, 20, 40)))
def _(spark, sf_dir):
    return rounded(P.highpass_sweep(L.event_curves(spark, sf_dir), 1 / 24), "p0", "strength")


@query("k12_harmonics", f"{_CANDIDATES} SELECT star_id, method, rank, round(p0 * f, 6) AS p0, round(f, 6) AS factor FROM cand, (SELECT unnest([1.0::DOUBLE, 0.5, 2.0, 1.0::DOUBLE / 3, 3.0]) AS f) WHERE p0 * f BETWEEN 5 AND 60")
def _(spark, sf_dir):
    pool = summary_candidates(spark, sf_dir).select("star_id", "method", "rank", "p0")
    return rounded(P.expand_harmonics(pool, 5, 60), "p0", "factor")


@query(
    "o8_rank_histogram",
    f"""{_CANDIDATES}, h AS (SELECT star_id, method, min(CASE WHEN coalesce(abs(p0 - true_period) / true_period <= 0.15, false) THEN rank END) AS r FROM cand GROUP BY 1, 2)
SELECT m.method, m.r AS rank_of_true_period, count(h.r) AS n FROM (SELECT DISTINCT method, unnest(range(1, 6)) AS r FROM cand) m LEFT JOIN h ON h.method = m.method AND h.r = m.r GROUP BY 1, 2""",
)
def _(spark, sf_dir):
    return P.rank_histogram(B.rank_of_true(summary_candidates(spark, sf_dir)))


def _factor_sql(column: str, least: float) -> str:
    return (
        f"{_SUMMARY}, c AS (SELECT *, greatest({column}, {least}) AS x FROM s), e AS (SELECT [lo * power(hi / lo, k / 8.0) for k in range(0, 9)] AS edges FROM (SELECT min(x) AS lo, max(x) AS hi FROM c)), "
        "b AS (SELECT *, len([v for v in edges if v < x]) AS below FROM c, e) SELECT method, CAST(below - 1 AS INTEGER) AS bin, round(avg(found), 6) AS hit_rate, count(*) AS n FROM b WHERE below BETWEEN 1 AND 8 GROUP BY 1, 2"
    )


@query("o8_rate_by_log_period", _factor_sql("period", 0.1))
def _(spark, sf_dir):
    return rounded(P.rate_by_factor(L.batch_summary(spark, sf_dir), "period", 0.1), "hit_rate")


@query("p4_rate_by_factor", _factor_sql("activity", 1.0))
def _(spark, sf_dir):
    return rounded(P.rate_by_factor(L.batch_summary(spark, sf_dir), "activity", 1.0), "hit_rate")


@query(
    "q7_phase_fold",
    f"{_USERS} SELECT star_id, p, CAST(least(floor((time / p - floor(time / p)) * 20), 19) AS INTEGER) AS bin, round(avg(flux), 6) AS mean, round(stddev_pop(flux), 6) AS std, count(*) AS n FROM lc, (SELECT unnest([0.7::DOUBLE, 2.9]) AS p) WHERE flux IS NOT NULL GROUP BY 1, 2, 3",
)
def _(spark, sf_dir):
    lc = L.user_curves(spark, sf_dir)
    periods = lc.select("star_id").distinct().select("star_id", F.explode(F.array(F.lit(0.7), F.lit(2.9))).alias("p"), F.lit(0.0).alias("t0"))
    return rounded(P.phase_fold(lc, periods), "mean", "std")


_CLIP = """, c{k} AS (SELECT star_id, i, time, flux FROM (SELECT *, quantile_cont(flux, 0.5) OVER (PARTITION BY star_id) AS m, stddev_pop(flux) OVER (PARTITION BY star_id) AS s FROM c{j} WHERE flux IS NOT NULL) WHERE flux - m >= -1.5 * s AND flux - m <= 2 * s)"""


@query("i12_sigma_clip", f"{_LC}, c0 AS (SELECT * FROM lc){_CLIP.format(k=1, j=0)}{_CLIP.format(k=2, j=1)} SELECT star_id, i, round(flux, 6) AS flux FROM c2")
def _(spark, sf_dir):
    return rounded(P.sigma_clip(L.event_curves(spark, sf_dir), "flux", 1.5, 2.0, rounds=2).select("star_id", "i", "flux"), "flux")


@query(
    "k2_false_alarm",
    _USERS
    + """, mm AS (SELECT star_id, avg(flux) AS m, min(time) AS t0, count(*) AS n, var_pop(time) AS tv FROM lc GROUP BY 1), y AS (SELECT star_id, time - t0 AS t, flux - m AS y FROM lc JOIN mm USING (star_id)),
a AS (SELECT star_id, g, y, cos(2 * pi() * (0.1 + g * 0.05) * t) AS c, sin(2 * pi() * (0.1 + g * 0.05) * t) AS s FROM y, (SELECT unnest(range(0, 39)) AS g)),
q AS (SELECT star_id, g, avg(c) AS C1, avg(s) AS S1, avg(c * c) AS CC, avg(s * s) AS SS, avg(c * s) AS CS, avg(y * c) AS YC, avg(y * s) AS YS, avg(y * y) AS YY FROM a GROUP BY 1, 2),
z AS (SELECT star_id, max((YC * YC * (SS - S1 * S1) + YS * YS * (CC - C1 * C1) - 2 * YC * YS * (CS - C1 * S1)) / (YY * nullif((CC - C1 * C1) * (SS - S1 * S1) - (CS - C1 * S1) * (CS - C1 * S1), 0))) AS z FROM q GROUP BY 1)
SELECT star_id, round(z, 6) AS power, round(CASE WHEN n >= 4 AND z < 1 THEN 1 - (1 - power(1 - z, (n - 3) / 2.0)) * exp(-sqrt(2.0 / (n - 1)) * exp(lgamma((n - 1) / 2.0) - lgamma((n - 2) / 2.0)) * 2.0 * sqrt(4 * pi() * tv) * power(1 - z, (n - 4) / 2.0) * sqrt((n - 1) * z / 2)) END, 6) AS false_alarm FROM z JOIN mm USING (star_id)""",
)
def _(spark, sf_dir):
    lc = L.user_curves(spark, sf_dir)
    spectrum = K.lomb_scargle(lc, K.grid_of(lc.select("star_id").distinct(), "0.1D", "2.0D", "0.05D"))
    top = spectrum.groupBy("star_id").agg(F.max("power").alias("power"))
    points = lc.groupBy("star_id").agg(F.count("*").alias("n"), F.var_pop("time").alias("tv"))
    out = top.join(points, "star_id").select("star_id", "power", E.false_alarm(F.col("power"), F.col("n"), F.col("tv"), 2.0).alias("false_alarm"))
    return rounded(out, "power", "false_alarm")


_GRID = """, fp AS (SELECT star_id, time, flux, time - lag(time) OVER (PARTITION BY star_id ORDER BY time) AS dt FROM lc WHERE flux IS NOT NULL),
sh AS (SELECT star_id, count(*) AS n, avg(flux) AS m, min(time) AS t0, var_pop(time) AS tv, max(time) - min(time) AS span, quantile_cont(dt, 0.5) AS dt FROM fp GROUP BY 1 HAVING count(*) >= 10),
gs AS (SELECT *, {low} AS low, 1 / ({samples} * span) AS step FROM sh WHERE span > 0 AND dt > 0),
gg AS (SELECT *, unnest(range(0, CAST(round_even((1 / (4 * dt) - low) / step, 0) AS BIGINT) + 1)) AS g FROM gs WHERE 1 / (4 * dt) >= low),
an AS (SELECT gg.star_id, g, low + g * step AS freq, flux - m AS y, 2 * pi() * (low + g * step) * (time - t0) AS a FROM gg JOIN fp USING (star_id)),
su AS (SELECT star_id, g, freq, avg(cos(a)) AS C1, avg(sin(a)) AS S1, avg(cos(a) * cos(a)) AS CC, avg(sin(a) * sin(a)) AS SS, avg(cos(a) * sin(a)) AS CS, avg(y * cos(a)) AS YC, avg(y * sin(a)) AS YS, avg(y * y) AS YY FROM an GROUP BY 1, 2, 3),
po AS (SELECT star_id, g, freq, (YC * YC * (SS - S1 * S1) + YS * YS * (CC - C1 * C1) - 2 * YC * YS * (CS - C1 * S1)) / (YY * ((CC - C1 * C1) * (SS - S1 * S1) - (CS - C1 * S1) * (CS - C1 * S1))) AS power FROM su WHERE YY > 0 AND (CC - C1 * C1) * (SS - S1 * S1) - (CS - C1 * S1) * (CS - C1 * S1) > 1e-10)"""
_TOPS = """, nb AS (SELECT *, coalesce(power > lag(power) OVER w AND power > lead(power) OVER w, false) AS top FROM po WINDOW w AS (PARTITION BY star_id ORDER BY g)),
rk AS (SELECT *, bool_or(top) OVER (PARTITION BY star_id) AS has FROM nb)
SELECT star_id, round(1 / freq, 6) AS p0, round(power, 6) AS strength, CAST(row_number() OVER (PARTITION BY star_id ORDER BY power DESC, freq) AS INTEGER) AS rank, '{method}' AS method FROM rk WHERE top = has QUALIFY row_number() OVER (PARTITION BY star_id ORDER BY power DESC, freq) <= CASE WHEN has THEN 5 ELSE 1 END"""


@query("k2_periodogram", f"{_USERS}{_GRID.format(low='2 / span', samples=1)} SELECT star_id, g, round(freq, 6) AS freq, round(power, 6) AS power FROM po")
def _(spark, sf_dir):
    return rounded(K.periodogram(L.user_curves(spark, sf_dir)).where("power is not null"), "freq", "power")


@query("k2_lombscargle_candidates", f"{_USERS}{_GRID.format(low='2 / span', samples=1)}{_TOPS.format(method='lombscargle')}")
def _(spark, sf_dir):
    return rounded(K.guess_lombscargle(L.user_curves(spark, sf_dir)), "p0", "strength")


@query("k4_lombscargle_short_candidates", f"{_USERS}{_GRID.format(low='1 / 15.0', samples=5)}{_TOPS.format(method='lombscargle_short')}")
def _(spark, sf_dir):
    return rounded(K.guess_lombscargle(L.user_curves(spark, sf_dir), "lombscargle_short", samples_per_peak=5, max_period=15.0), "p0", "strength")


@query(
    "k2_false_alarm_own_grid",
    f"""{_USERS}{_GRID.format(low='2 / span', samples=1)}, z AS (SELECT star_id, max(power) AS z, max(freq) AS fm FROM po GROUP BY 1)
SELECT star_id, round(z, 6) AS power, round(CASE WHEN n >= 4 AND z < 1 THEN 1 - (1 - power(1 - z, (n - 3) / 2.0)) * exp(-sqrt(2.0 / (n - 1)) * exp(lgamma((n - 1) / 2.0) - lgamma((n - 2) / 2.0)) * fm * sqrt(4 * pi() * tv) * power(1 - z, (n - 4) / 2.0) * sqrt((n - 1) * z / 2)) END, 6) AS false_alarm FROM z JOIN sh USING (star_id)""",
)
def _(spark, sf_dir):
    lc = K.finite_points(L.user_curves(spark, sf_dir))
    top = K.periodogram(lc).where("power is not null").groupBy("star_id").agg(F.max("power").alias("power"), F.max("freq").alias("f_max"))
    points = lc.groupBy("star_id").agg(F.count("*").alias("n"), F.var_pop("time").alias("tv"))
    out = top.join(points, "star_id").select("star_id", "power", E.false_alarm(F.col("power"), F.col("n"), F.col("tv"), F.col("f_max")).alias("false_alarm"))
    return rounded(out, "power", "false_alarm")


@query("p3_zero_candidates_p")
def _(spark, sf_dir):
    summary = L.batch_summary(spark, sf_dir)
    r = B.zero_candidates(summary, F.col("n_candidates") <= 1)
    n = summary.groupBy("method").agg(F.count("*").alias("n"))
    return r.join(n, "method").withColumn("p_value", correlation_p("point_biserial_r", "n"))


@query("i8_sectors")
def _(spark, sf_dir):
    points, stats = G.split_segments(dense_curves(spark, sf_dir), n_segments=10)
    return P.sector_collection(points, stats)
