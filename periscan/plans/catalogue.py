"""Every registered query of the library, with its DuckDB equivalent where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from periscan.functions.significance import correlation_p
from periscan.operators import acf as A
from periscan.operators import benchmark as B
from periscan.operators import comb as C
from periscan.operators import diagnostics as D
from periscan.operators import features as N
from periscan.operators import segments as G
from periscan.operators import series as S
from periscan.operators import spacing as H
from periscan.operators import spectra as K
from periscan.operators import wavelet as W
from periscan.session import materialize, table
from periscan.sources import light_curves as L
from periscan.streaming import bins as T

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def query(name: str, sql: str | None = None):
    def add(f):
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _QUERIES


def oracle_sql() -> dict[str, str]:
    return _SQL


def rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})


_LC = """WITH cells AS (SELECT event_type AS star_id, CAST(floor(epoch_us(ts) / 3600000000.0) AS BIGINT) AS hour, avg(value) AS flux FROM events GROUP BY 1, 2),
lc AS (SELECT star_id, hour - (SELECT min(hour) FROM cells) AS i, (hour - (SELECT min(hour) FROM cells)) / 24.0 AS time, flux FROM cells)"""
_USERS = """WITH lc AS (SELECT user_id AS star_id, event_id, (epoch_us(ts) - 1704067200000000) / 86400000000.0 AS time, value AS flux FROM events)"""
_SUMMARY = """WITH per AS (SELECT o_custkey AS star_id, o_orderpriority AS method, count(*) AS n_candidates, max(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS found, round(max(o_totalprice) / 5000.0, 6) AS activity FROM orders GROUP BY 1, 2),
s AS (SELECT per.*, round(abs(c_acctbal) / 100.0, 4) AS period FROM per JOIN customer ON c_custkey = star_id)"""


@query("i0_event_curves", f"{_LC} SELECT star_id, i, round(time, 6) AS time, round(flux, 6) AS flux FROM lc")
def _(spark, sf_dir):
    return rounded(L.event_curves(spark, sf_dir), "time", "flux")


@query("e1_rolling_std", f"{_LC} SELECT star_id, i, round(stddev_samp(flux) OVER (PARTITION BY star_id ORDER BY i ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING), 6) AS roll FROM lc")
def _(spark, sf_dir):
    return rounded(S.rolling_std(L.event_curves(spark, sf_dir)).select("star_id", "i", "roll"), "roll")


@query(
    "e2_rolling_median",
    f"{_LC} SELECT star_id, i, round(CASE WHEN count(flux) OVER w >= 12 THEN quantile_cont(flux, 0.5) OVER w END, 6) AS baseline FROM lc WINDOW w AS (PARTITION BY star_id ORDER BY i ROWS BETWEEN 24 PRECEDING AND 24 FOLLOWING)",
)
def _(spark, sf_dir):
    return rounded(S.rolling_median(L.event_curves(spark, sf_dir), "flux", 49, 12).select("star_id", "i", "baseline"), "baseline")


@query("e3_boxcar_mean", f"{_LC} SELECT star_id, i, round(CASE WHEN count(flux) OVER w >= 2 THEN avg(flux) OVER w END, 9) AS trend FROM lc WINDOW w AS (PARTITION BY star_id ORDER BY i ROWS BETWEEN 4 PRECEDING AND 3 FOLLOWING)")
def _(spark, sf_dir):
    return rounded(S.boxcar(L.event_curves(spark, sf_dir), 8).select("star_id", "i", "trend"), "trend", places=9)


@query("k6_highpass_flux", f"{_LC} SELECT star_id, i, round(flux - CASE WHEN count(flux) OVER w >= 16 THEN avg(flux) OVER w END, 9) AS flux FROM lc WINDOW w AS (PARTITION BY star_id ORDER BY i ROWS BETWEEN 24 PRECEDING AND 23 FOLLOWING)")
def _(spark, sf_dir):
    return rounded(S.highpass(L.event_curves(spark, sf_dir), 48).select("star_id", "i", "flux"), "flux", places=9)


@query("e5_differences", f"{_LC} SELECT star_id, i, round(flux - lag(flux) OVER w, 6) AS d1, round(flux - 2 * lag(flux) OVER w + lag(flux, 2) OVER w, 6) AS d2 FROM lc WINDOW w AS (PARTITION BY star_id ORDER BY i)")
def _(spark, sf_dir):
    return rounded(S.differences(L.event_curves(spark, sf_dir)).select("star_id", "i", "d1", "d2"), "d1", "d2")


_ISLANDS = """, n AS (SELECT *, row_number() OVER (PARTITION BY star_id ORDER BY i) AS n FROM {src}), r AS (SELECT *, n - row_number() OVER (PARTITION BY star_id ORDER BY i) AS run FROM n WHERE {flag})
SELECT star_id, min(i) AS start_i, max(i) AS end_i, count(*) AS width, round(avg(time), 6) AS center_time FROM r GROUP BY star_id, run HAVING count(*) >= {least}"""


@query("e6_gap_islands", _LC + _ISLANDS.format(src="lc", flag="flux > 50", least=3))
def _(spark, sf_dir):
    return rounded(S.islands(L.event_curves(spark, sf_dir), F.col("flux") > 50, 3), "center_time")


@query(
    "i3_candidate_gaps",
    _LC
    + """, a AS (SELECT *, stddev_samp(flux) OVER (PARTITION BY star_id ORDER BY i ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS roll FROM lc),
b AS (SELECT *, CASE WHEN count(roll) OVER w >= 12 THEN quantile_cont(roll, 0.5) OVER w END AS baseline FROM a WINDOW w AS (PARTITION BY star_id ORDER BY i ROWS BETWEEN 24 PRECEDING AND 24 FOLLOWING))"""
    + _ISLANDS.format(src="b", flag="roll < 0.8 * baseline", least=3),
)
def _(spark, sf_dir):
    return rounded(S.candidate_gaps(L.event_curves(spark, sf_dir), 9, 49, 0.8, 3), "center_time")


_EVEN = """, t AS (SELECT star_id, min(time) AS t0, max(time) AS t1 FROM lc GROUP BY 1),
g AS (SELECT star_id, t0, unnest(range(0, CAST(round_even((t1 - t0) / {step}, 0) AS BIGINT) + 1)) AS i FROM t),
p AS (SELECT lc.star_id, CAST(round_even((time - t0) / {step}, 0) AS BIGINT) AS i, max(struct_pack(time := time, flux := flux)) AS o FROM lc JOIN t USING (star_id) GROUP BY 1, 2)"""


@query("i1_even_cadence", _USERS + _EVEN.format(step="0.25") + " SELECT g.star_id, g.i, round(t0 + g.i * 0.25, 6) AS time, round(o.flux, 6) AS flux FROM g LEFT JOIN p ON g.star_id = p.star_id AND g.i = p.i")
def _(spark, sf_dir):
    return rounded(S.even_cadence(L.user_curves(spark, sf_dir), 0.25), "time", "flux")


@query(
    "i2_bin_lc",
    _USERS
    + """, t AS (SELECT star_id, min(time) AS t0, max(time) AS t1, CAST(floor(max(time) - min(time) - 1e-9) AS BIGINT) AS bins FROM lc GROUP BY 1),
g AS (SELECT star_id, t0, unnest(range(0, bins)) AS i FROM t), c AS (SELECT lc.star_id, CAST(floor(time - t0) AS BIGINT) AS i, avg(flux) AS flux, count(flux) AS n FROM lc JOIN t USING (star_id) GROUP BY 1, 2)
SELECT g.star_id, g.i, round(t0 + g.i + 0.5, 6) AS time, round(c.flux, 6) AS flux, coalesce(n, 0) AS n FROM g LEFT JOIN c ON g.star_id = c.star_id AND g.i = c.i""",
)
def _(spark, sf_dir):
    return rounded(S.bin_curve(L.user_curves(spark, sf_dir), 1.0), "time", "flux")


_ACF = """, v AS (SELECT star_id, avg(flux) AS m, min(i) AS lo, max(i) AS hi, count(*) AS n0 FROM lc GROUP BY 1),
x AS (SELECT lc.star_id, i, flux - m AS x, CAST(floor((hi - lo) / 3.0 + 1e-9) AS BIGINT) AS most, n0 FROM lc JOIN v USING (star_id)),
r AS (SELECT a.star_id, b.i - a.i AS k, avg(a.x * b.x) AS c, count(*) AS n_pairs, max(a.n0) AS n0 FROM x a JOIN x b ON a.star_id = b.star_id AND b.i >= a.i AND b.i - a.i <= a.most GROUP BY 1, 2),
m AS (SELECT *, max(CASE WHEN k = 0 THEN c END) OVER (PARTITION BY star_id) AS c0, min(CASE WHEN n_pairs < 0.3 * n0 THEN k END) OVER (PARTITION BY star_id) AS cut FROM r),
acf AS (SELECT star_id, k, k / 24.0 AS lag, c / c0 AS acf, n_pairs FROM m WHERE cut < 10 OR cut IS NULL OR k < cut)"""


def event_acf(spark, sf_dir):
    return A.acf(L.event_curves(spark, sf_dir), 1 / 24)


@query("j1_acf_gap_aware", _LC + _ACF + " SELECT star_id, k, round(lag, 6) AS lag, round(acf, 6) AS acf, n_pairs FROM acf")
def _(spark, sf_dir):
    return rounded(event_acf(spark, sf_dir), "lag", "acf")


def dft_sql(oversample: int = 4, low: str = "2 / span") -> str:
    """The spectrum of ``acf`` on the padded transform's own frequencies, strictly within the band."""
    return f"""{_ACF}, st AS (SELECT star_id, avg(acf) AS m, max(k) AS last, max(lag) AS span FROM acf GROUP BY 1),
y AS (SELECT acf.star_id, lag, (acf - m) * (0.5 - 0.5 * cos(2 * pi() * k / last)) AS y FROM acf JOIN st USING (star_id)),
gr AS (SELECT star_id, g, g * 24.0 / ({oversample} * (last + 1)) AS freq FROM (SELECT *, unnest(range(1, {oversample} * (last + 1) // 2 + 1)) AS g FROM st) WHERE g * 24.0 / ({oversample} * (last + 1)) > {low} AND g * 24.0 / ({oversample} * (last + 1)) < 6),
sp AS (SELECT star_id, g, freq, power(sum(y * cos(2 * pi() * freq * lag)), 2) + power(sum(y * sin(2 * pi() * freq * lag)), 2) AS power FROM gr JOIN y USING (star_id) GROUP BY 1, 2, 3 HAVING count(*) > 0)"""


_DFT = dft_sql()
PEAKS_SQL = """, pk AS (SELECT *, lag(power) OVER w AS a, lead(power) OVER w AS b, max(power) OVER (PARTITION BY star_id) AS most FROM sp WINDOW w AS (PARTITION BY star_id ORDER BY g)),
rk AS (SELECT star_id, 1 / freq AS p0, power / most AS strength, row_number() OVER (PARTITION BY star_id ORDER BY power DESC, freq) AS rank FROM pk WHERE power > a AND power > b)"""


def event_spectrum(spark, sf_dir):
    """Power of the event curves' autocorrelation at periods between four hours and half the range of lags."""
    return K.acf_spectrum(event_acf(spark, sf_dir))


@query("k3_spectrum", _LC + _DFT + " SELECT star_id, g, round(freq, 6) AS freq, round(power, 5) AS power FROM sp")
def _(spark, sf_dir):
    return rounded(rounded(event_spectrum(spark, sf_dir), "freq"), "power", places=5)


@query("k3_acf_fft", _LC + _DFT + PEAKS_SQL + " SELECT star_id, round(p0, 6) AS p0, round(strength, 6) AS strength, rank, 'acf_fft' AS method FROM rk WHERE rank <= 5")
def _(spark, sf_dir):
    return rounded(K.guess_acf_fft(event_acf(spark, sf_dir)), "p0", "strength")


@query("k5_acf_fft_short", _LC + dft_sql(8, "1 / 15.0") + PEAKS_SQL + " SELECT star_id, round(p0, 6) AS p0, round(strength, 6) AS strength, rank, 'acf_fft_short' AS method FROM rk WHERE rank <= 5")
def _(spark, sf_dir):
    return rounded(K.guess_acf_fft(event_acf(spark, sf_dir), "acf_fft_short", oversample=8, max_period=15.0), "p0", "strength")


@query(
    "k2_lombscargle",
    _USERS
    + """, mm AS (SELECT star_id, avg(flux) AS m, min(time) AS t0 FROM lc GROUP BY 1), y AS (SELECT star_id, time - t0 AS t, flux - m AS y FROM lc JOIN mm USING (star_id)),
a AS (SELECT star_id, g, 0.1 + g * 0.05 AS freq, y, cos(2 * pi() * (0.1 + g * 0.05) * t) AS c, sin(2 * pi() * (0.1 + g * 0.05) * t) AS s FROM y, (SELECT unnest(range(0, 39)) AS g)),
q AS (SELECT star_id, g, freq, avg(c) AS C1, avg(s) AS S1, avg(c * c) AS CC, avg(s * s) AS SS, avg(c * s) AS CS, avg(y * c) AS YC, avg(y * s) AS YS, avg(y * y) AS YY FROM a GROUP BY 1, 2, 3)
SELECT star_id, g, round(freq, 6) AS freq, round((YC * YC * (SS - S1 * S1) + YS * YS * (CC - C1 * C1) - 2 * YC * YS * (CS - C1 * S1)) / (YY * ((CC - C1 * C1) * (SS - S1 * S1) - (CS - C1 * S1) * (CS - C1 * S1))), 6) AS power FROM q""",
)
def _(spark, sf_dir):
    lc = L.user_curves(spark, sf_dir)
    return rounded(K.lomb_scargle(lc, K.grid_of(lc.select("star_id").distinct(), "0.1D", "2.0D", "0.05D")), "freq", "power")


_COMB = """, cb AS (SELECT star_id, n / 24.0 AS p, 3 / 24.0 AS t0 FROM (SELECT DISTINCT star_id FROM acf), (SELECT unnest(range(6, 37)) AS n)),
sn AS (SELECT star_id, max(lag) AS l1, max(k) AS k1 FROM acf GROUP BY 1),
te AS (SELECT star_id, p, t0, n, t0 + n * p AS at, (t0 + n * p) * 24.0 AS x, k1 FROM (SELECT *, unnest(range(0, 6)) AS n FROM cb JOIN sn USING (star_id)) WHERE t0 + n * p <= l1),
tv AS (SELECT te.star_id, p, t0, 1.0 / (n + 1) AS w, a.acf + (b.acf - a.acf) * (x - least(floor(x), k1 - 1)) AS v FROM te JOIN acf a ON a.star_id = te.star_id AND a.k = least(floor(x), k1 - 1) JOIN acf b ON b.star_id = te.star_id AND b.k = a.k + 1)
SELECT star_id, round(p, 6) AS p, round(t0, 6) AS t0, round(sum(w * v) / sum(w), 6) AS score FROM tv GROUP BY star_id, p, t0"""


@query("k11_comb_score", _LC + _ACF + _COMB)
def _(spark, sf_dir):
    series = event_acf(spark, sf_dir)
    combs = L.event_curves(spark, sf_dir).select("star_id").distinct().select("star_id", F.explode(F.sequence(F.lit(6), F.lit(36))).alias("n")).select("star_id", (F.col("n") / 24.0).alias("p"), F.lit(3 / 24.0).alias("t0"))
    return rounded(D.comb_score(series, combs), "p", "t0", "score")


_PDM = """, w AS (SELECT star_id, var_samp(flux) AS av, count(*) AS n, min(time) AS t0 FROM lc GROUP BY 1),
f AS (SELECT lc.star_id, p, least(CAST(floor(((time - t0) / p - floor((time - t0) / p)) * 10) AS BIGINT), 9) AS bin, flux, av, n FROM lc JOIN w USING (star_id), (SELECT unnest([0.7, 1.3, 2.9, 5.3]) AS p)),
b AS (SELECT star_id, p, bin, var_samp(flux) AS v, count(*) AS m, max(av) AS av, max(n) AS n FROM f GROUP BY 1, 2, 3 HAVING count(*) >= 2)
SELECT star_id, round(p, 6) AS p, round(CASE WHEN max(n) >= 20 AND max(av) > 0 AND max(n) > count(*) THEN sum((m - 1) * v) / ((max(n) - count(*)) * max(av)) END, 6) AS theta FROM b GROUP BY star_id, p"""


@query("m1_pdm_theta", _USERS + _PDM)
def _(spark, sf_dir):
    lc = L.user_curves(spark, sf_dir)
    periods = lc.select("star_id").distinct().select("star_id", F.explode(F.array(*map(F.lit, (0.7, 1.3, 2.9, 5.3)))).alias("p"))
    return rounded(D.phase_dispersion(lc, periods), "p", "theta")


@query("n10_duty_cycle", f"{_LC} SELECT star_id, round(count(flux) / CAST(max(i) - min(i) + 1 AS DOUBLE), 6) AS duty_cycle FROM lc GROUP BY 1")
def _(spark, sf_dir):
    return rounded(N.duty_cycle(L.event_curves(spark, sf_dir)), "duty_cycle")


@query(
    "n10_von_neumann",
    f"{_LC}, d AS (SELECT star_id, flux, CASE WHEN i - lag(i) OVER w = 1 THEN flux - lag(flux) OVER w END AS d FROM lc WINDOW w AS (PARTITION BY star_id ORDER BY i)) SELECT star_id, round(avg(d * d) / var_pop(flux), 6) AS von_neumann_eta FROM d GROUP BY 1",
)
def _(spark, sf_dir):
    return rounded(N.von_neumann(L.event_curves(spark, sf_dir)), "von_neumann_eta")


@query(
    "n10_r_var",
    f"{_LC}, t AS (SELECT star_id, CASE WHEN count(flux) OVER w >= 1 THEN avg(flux) OVER w END AS trend FROM lc WINDOW w AS (PARTITION BY star_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING)) SELECT star_id, round(quantile_cont(trend, 0.95) - quantile_cont(trend, 0.05), 6) AS r_var FROM t GROUP BY 1",
)
def _(spark, sf_dir):
    return rounded(N.r_var(L.event_curves(spark, sf_dir)), "r_var")


@query(
    "n10_flicker",
    f"{_LC}, t AS (SELECT star_id, flux, CASE WHEN count(flux) OVER w >= 2 THEN avg(flux) OVER w END AS trend FROM lc WINDOW w AS (PARTITION BY star_id ORDER BY i ROWS BETWEEN 4 PRECEDING AND 3 FOLLOWING)) SELECT star_id, round(stddev_pop(flux - trend), 6) AS flicker_std FROM t GROUP BY 1",
)
def _(spark, sf_dir):
    return rounded(N.flicker(L.event_curves(spark, sf_dir)), "flicker_std")


@query(
    "n7_s_ph",
    f"""{_LC}, sp AS (SELECT star_id, min(i) AS lo, CAST(floor((max(i) - min(i) + 1) / 24.0) AS BIGINT) AS bins FROM lc GROUP BY 1),
p AS (SELECT lc.star_id, CAST(floor((i - lo) / 24.0) AS BIGINT) AS b, bins, stddev_pop(flux) AS sd FROM lc JOIN sp USING (star_id) GROUP BY 1, 2, 3 HAVING count(flux) >= 8)
SELECT star_id, round(CASE WHEN max(bins) >= 5 THEN avg(sd) END, 6) AS s_ph FROM p WHERE b < bins GROUP BY 1""",
)
def _(spark, sf_dir):
    return rounded(N.s_ph(L.event_curves(spark, sf_dir), 24), "s_ph")


@query(
    "n10_moments",
    f"""{_LC}, m AS (SELECT star_id, avg(flux) AS a FROM lc GROUP BY 1), c AS (SELECT star_id, avg(power(flux - a, 2)) AS m2, avg(power(flux - a, 3)) AS m3, avg(power(flux - a, 4)) AS m4 FROM lc JOIN m USING (star_id) GROUP BY 1)
SELECT star_id, round(sqrt(m2), 6) AS flux_std, round(m3 / power(m2, 1.5), 6) AS flux_skewness, round(m4 / (m2 * m2) - 3, 6) AS flux_kurtosis FROM c""",
)
def _(spark, sf_dir):
    return rounded(N.moments(L.event_curves(spark, sf_dir)), "flux_std", "flux_skewness", "flux_kurtosis")


def summary_candidates(spark, sf_dir):
    """Orders as candidates: of each customer and priority by total price, the customer's balance as truth."""
    from pyspark.sql import Window

    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    rank = F.row_number().over(Window.partitionBy("o_custkey", "o_orderpriority").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    cand = o.select(F.col("o_custkey").alias("star_id"), F.col("o_orderpriority").alias("method"), rank.alias("rank"), F.round(F.col("o_totalprice") / 5000, 6).alias("p0"))
    return cand.join(c.select(F.col("c_custkey").alias("star_id"), F.round(F.abs("c_acctbal") / 100, 4).alias("true_period")), "star_id")


_CANDIDATES = """WITH cand AS (SELECT o_custkey AS star_id, o_orderpriority AS method, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS rank, round(o_totalprice / 5000, 6) AS p0, round(abs(c_acctbal) / 100, 4) AS true_period FROM orders JOIN customer ON c_custkey = o_custkey)"""


@query(
    "o2_rank_of_true",
    f"""{_CANDIDATES}, h AS (SELECT *, coalesce(abs(p0 - true_period) / true_period <= 0.15, false) AS hit FROM cand)
SELECT star_id, method, count(*) AS n_candidates, bool_or(hit) AS found_true_period, min(CASE WHEN hit THEN rank END) AS rank_of_true_period, arg_min(p0, rank) FILTER (WHERE hit) AS matched_p0 FROM h GROUP BY 1, 2""",
)
def _(spark, sf_dir):
    return B.rank_of_true(summary_candidates(spark, sf_dir))


@query(
    "n11_agreement",
    f"""{_CANDIDATES} SELECT a.star_id, a.method, a.rank, a.p0, count(*) FILTER (WHERE near) AS n_agreeing_candidates, count(DISTINCT CASE WHEN near AND m2 <> a.method THEN m2 END) AS n_agreeing_methods
FROM (SELECT x.star_id, x.method, x.rank, x.p0, y.method AS m2, abs(y.p0 - x.p0) <= 0.03 * x.p0 AND NOT (y.method = x.method AND y.rank = x.rank) AS near FROM cand x JOIN cand y ON x.star_id = y.star_id) a GROUP BY 1, 2, 3, 4""",
)
def _(spark, sf_dir):
    return N.agreement(summary_candidates(spark, sf_dir).select("star_id", "method", "rank", "p0"))


@query("o8_hit_rate", f"{_SUMMARY} SELECT method, round(avg(found), 6) AS hit_rate, count(*) AS n FROM s GROUP BY 1")
def _(spark, sf_dir):
    return rounded(B.hit_rate(L.batch_summary(spark, sf_dir)), "hit_rate")


@query("p1_cutoffs", f"{_SUMMARY} SELECT method, round(avg(CASE WHEN period <= 40 THEN found END), 6) AS hit_rate_below, count(*) FILTER (WHERE period <= 40) AS n_below, round(avg(CASE WHEN period > 40 THEN found END), 6) AS hit_rate_above, count(*) FILTER (WHERE period > 40) AS n_above FROM s GROUP BY 1")
def _(spark, sf_dir):
    return rounded(B.cutoffs(L.batch_summary(spark, sf_dir), 40), "hit_rate_below", "hit_rate_above")


@query("p2_rate_by_width", f"{_SUMMARY} SELECT method, CAST(ceil(period / 5.0) AS BIGINT) - 1 AS bin, round(avg(found), 6) AS hit_rate, count(*) AS n FROM s WHERE period > 0 GROUP BY 1, 2")
def _(spark, sf_dir):
    return rounded(B.rate_by_width(L.batch_summary(spark, sf_dir), "period", 5.0), "hit_rate")


@query(
    "p3_zero_candidates",
    f"{_SUMMARY}, z AS (SELECT *, CASE WHEN n_candidates <= 1 THEN 1 ELSE 0 END AS z FROM s) SELECT method, round(corr(z, activity), 6) AS point_biserial_r, round(avg(z), 6) AS zero_rate, round(quantile_cont(activity, 0.5) FILTER (WHERE z = 1), 6) AS median_when_zero, round(quantile_cont(activity, 0.5) FILTER (WHERE z = 0), 6) AS median_when_nonzero FROM z GROUP BY 1",
)
def _(spark, sf_dir):
    return rounded(B.zero_candidates(L.batch_summary(spark, sf_dir), F.col("n_candidates") <= 1), "point_biserial_r", "zero_rate", "median_when_zero", "median_when_nonzero")


@query("p5_restricted", f"{_SUMMARY} SELECT star_id, sum(found) AS n_methods_found, max(found) AS found_by_any, max(period) AS period, max(activity) AS activity FROM s WHERE period <= 50 GROUP BY 1")
def _(spark, sf_dir):
    return B.restricted(L.batch_summary(spark, sf_dir), 50)


_RANKS = "SELECT {p} AS x, found_by_any AS y, rank() OVER (ORDER BY {p}) + (count(*) OVER (PARTITION BY {p}) - 1) / 2.0 AS rp, rank() OVER (ORDER BY found_by_any) + (count(*) OVER (PARTITION BY found_by_any) - 1) / 2.0 AS ra FROM r"


@query(
    "p6_spearman",
    f"{_SUMMARY}, r AS (SELECT star_id, max(found) AS found_by_any, max(period) AS period, max(activity) AS activity FROM s WHERE period <= 50 GROUP BY 1) "
    + " UNION ALL ".join(f"SELECT '{p}' AS parameter, round(corr(rp, ra), 6) AS spearman_rho FROM ({_RANKS.format(p=p)})" for p in ("period", "activity")),
)
def _(spark, sf_dir):
    return rounded(B.spearman(B.restricted(L.batch_summary(spark, sf_dir), 50), ["period", "activity"], "found_by_any"), "spearman_rho")


@query(
    "p9_band_pivot",
    f"{_SUMMARY}, b AS (SELECT *, CASE WHEN period > 50 THEN 4 WHEN period > 20 THEN 3 WHEN period > 10 THEN 2 WHEN period > 1 THEN 1 WHEN period > 0 THEN 0 END AS band FROM s) SELECT band, "
    + ", ".join(f"round(avg(found) FILTER (WHERE method = '{p}'), 6) AS m{k}" for k, p in enumerate(PRIORITIES))
    + " FROM b WHERE band IS NOT NULL GROUP BY 1",
)
def _(spark, sf_dir):
    wide = B.hit_rate_by_band(L.batch_summary(spark, sf_dir), PRIORITIES)
    return wide.select("band", *(F.round(F.col(f"`{p}`"), 6).alias(f"m{k}") for k, p in enumerate(PRIORITIES)))


@query("m2_pdm_refine")
def _(spark, sf_dir):
    """The periods of planted stars, refined from values half a percent off."""
    lc = L.planted_stars(spark, sf_dir)
    return D.refine_by_dispersion(lc, lc.select("star_id", (F.col("true_period") * 1.005).alias("p")).distinct())


_PHASES = """, cb AS (SELECT star_id, 1.0::DOUBLE AS p, 3 * (1::DOUBLE / 24) + 1.0::DOUBLE * j / 200 AS t0 FROM (SELECT DISTINCT star_id FROM lc), (SELECT unnest(range(0, 200)) AS j)), sn AS (SELECT star_id, max(lag) AS l1, max(k) AS k1 FROM acf GROUP BY 1),
te AS (SELECT star_id, p, t0, n, (t0 + n * p) * 24.0 AS x, k1 FROM (SELECT *, unnest(range(0, 6)) AS n FROM cb JOIN sn USING (star_id)) WHERE t0 + n * p <= l1),
tv AS (SELECT te.star_id, p, t0, 1.0::DOUBLE / (n + 1) AS w, a.acf + (b.acf - a.acf) * (x - least(floor(x), k1 - 1)) AS v FROM te JOIN acf a ON a.star_id = te.star_id AND a.k = least(floor(x), k1 - 1) JOIN acf b ON b.star_id = te.star_id AND b.k = a.k + 1),
sc AS (SELECT star_id, p, t0, round(sum(w * v) / sum(w), 9) AS score FROM tv GROUP BY 1, 2, 3)
SELECT star_id, p, round(arg_max(t0, (score, -t0)), 6) AS t0, round(max(score), 6) AS score FROM sc GROUP BY 1, 2"""


@query("k11_t0_grid", _LC + _ACF + _PHASES)
def _(spark, sf_dir):
    series = event_acf(spark, sf_dir)
    return rounded(D.best_phase(series, L.event_curves(spark, sf_dir).select("star_id").distinct().withColumn("p", F.lit(1.0)), 1 / 24), "t0", "score")


def planted_acf(spark, sf_dir):
    return materialize(A.acf(L.planted_stars(spark, sf_dir), 0.02), "acf")


@query("k1_pairwise_histogram")
def _(spark, sf_dir):
    return H.peak_spacings(planted_acf(spark, sf_dir), 0.02)


def dense_curves(spark, sf_dir):
    return S.interpolate(S.even_cadence(L.event_curves(spark, sf_dir).select("star_id", "i", "time", "flux"), 1 / 24))


@query("k7_wavelet")
def _(spark, sf_dir):
    return W.wavelet_candidates(dense_curves(spark, sf_dir), 1 / 24)


@query("k7_wavelet_planted")
def _(spark, sf_dir):
    return W.wavelet_candidates(L.planted_stars(spark, sf_dir), 0.02)


@query("l4_rotation_period")
def _(spark, sf_dir):
    series = planted_acf(spark, sf_dir)
    told = ["star_id", "p0", "method", "rank", "strength"]
    pool = H.peak_spacings(series, 0.02).select(*told).unionByName(W.wavelet_candidates(L.planted_stars(spark, sf_dir), 0.02).select(*told))
    return C.rotation_periods(series, pool, 0.02)


@query("i4_segments")
def _(spark, sf_dir):
    return G.split_segments(dense_curves(spark, sf_dir), n_segments=10)[1]


@query("i7_recombine")
def _(spark, sf_dir):
    return G.recombine(*G.split_segments(dense_curves(spark, sf_dir), n_segments=10))


@query("s1_streamed_hours", "SELECT event_type AS star_id, epoch_us(date_trunc('hour', ts)) AS hour_us, round(avg(value), 6) AS flux, count(value) AS n FROM events GROUP BY 1, 2")
def _(spark, sf_dir):
    out = T.replay(spark, sf_dir)
    # in the session's zone, as the events were read
    local = F.expr(L.MICROS.format("cast(hour as timestamp_ntz)"))
    return rounded(out.select("star_id", local.alias("hour_us"), "flux", "n"), "flux")


@query("p6_spearman_p")
def _(spark, sf_dir):
    stars = B.restricted(L.batch_summary(spark, sf_dir), 50)
    rho = B.spearman(stars, ["period", "activity"], "found_by_any")
    n = stars.agg(F.count("*").alias("n"))  # one row
    return rho.crossJoin(F.broadcast(n)).withColumn("p_value", correlation_p("spearman_rho", "n"))
