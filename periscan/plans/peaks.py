"""Registered queries of peaks, their spacings and combs over the given tables; importing this adds them to the catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from periscan.functions import guessers
from periscan.functions.statistics import trimmed_mean
from periscan.operators import comb as C
from periscan.operators import diagnostics as D
from periscan.operators import pools as P
from periscan.operators import quantiles as Q
from periscan.operators import series as S
from periscan.operators import spacing as H
from periscan.operators import spectra as K
from periscan.operators.feature_table import feature_table
from periscan.operators.gather import Curves, gather
from periscan.plans.catalogue import _ACF, _LC, _USERS, PEAKS_SQL, dense_curves, dft_sql, event_acf, query, rounded
from periscan.plans.evidence import _GRID, _TOPS
from periscan.session import table
from periscan.sources import light_curves as L
from periscan.streaming import open_bins as O

#: Peaks of the event curves stand out of their neighbours by less than those of a spotted star.
SIGMAS = 0.3

_PEAKS = f"""{_ACF}, dd AS (SELECT star_id, {SIGMAS} * stddev_pop(d2) AS least FROM (SELECT star_id, acf - 2 * lag(acf, 1) OVER w + lag(acf, 2) OVER w AS d2 FROM acf WINDOW w AS (PARTITION BY star_id ORDER BY k)) GROUP BY 1),
la AS (SELECT * FROM acf WHERE lag >= 3 / 24.0 - 1e-9), nb AS (SELECT *, lag(acf) OVER w AS before, lead(acf) OVER w AS after FROM la WINDOW w AS (PARTITION BY star_id ORDER BY k)),
tp AS (SELECT star_id, k, lag, acf AS height FROM nb WHERE acf > before AND acf > after),
hi AS (SELECT tp.star_id, tp.k, tp.lag, height, max(CASE WHEN acf > height AND la.k < tp.k THEN la.k END) AS fr, min(CASE WHEN acf > height AND la.k > tp.k THEN la.k END) AS upto FROM tp JOIN la ON la.star_id = tp.star_id GROUP BY ALL),
ba AS (SELECT hi.star_id, hi.k, hi.lag, height, min(acf) FILTER (WHERE la.k <= hi.k) AS a, min(acf) FILTER (WHERE la.k >= hi.k) AS b FROM hi JOIN la ON la.star_id = hi.star_id AND (fr IS NULL OR la.k > fr) AND (upto IS NULL OR la.k < upto) GROUP BY ALL),
pk AS (SELECT star_id, k, lag, height FROM ba JOIN dd USING (star_id) WHERE height - greatest(a, b) >= least)"""

_HIST = """, sx AS (SELECT a.star_id, b.k - a.k AS d, count(*) AS c, (b.k - a.k) * (1::DOUBLE / 24) AS x FROM pk a JOIN pk b ON a.star_id = b.star_id AND b.k > a.k GROUP BY ALL),
s1 AS (SELECT star_id, min(x) AS x0, max(x) AS x1, greatest(4 * (1::DOUBLE / 24), (max(x) - min(x)) / 200) AS w FROM sx GROUP BY 1),
s2 AS (SELECT *, greatest(0, x0 - w) AS lo, x1 + w AS hi FROM s1), s3 AS (SELECT *, greatest(CAST(floor((hi - lo) / w) AS BIGINT), 10) AS n FROM s2),
ce AS (SELECT star_id, least(CAST(floor((x - lo) / (hi - lo) * n) AS BIGINT), n - 1) AS g, sum(c)::BIGINT AS c FROM sx JOIN s3 USING (star_id) GROUP BY 1, 2),
hs AS (SELECT s3.star_id, b.g, lo + (b.g + 0.5::DOUBLE) * (hi - lo) / n AS mid, coalesce(ce.c, 0) AS power FROM s3 CROSS JOIN LATERAL (SELECT unnest(range(0, n)) AS g) b LEFT JOIN ce ON ce.star_id = s3.star_id AND ce.g = b.g)"""

_RANKED = """, ch AS (SELECT *, CASE WHEN power = lag(power) OVER (PARTITION BY star_id ORDER BY g) THEN 0 ELSE 1 END AS new FROM hs), ru AS (SELECT *, sum(new) OVER (PARTITION BY star_id ORDER BY g) AS run FROM ch),
fl AS (SELECT star_id, run, min(g) AS g0, max(g) AS g1, min(power) AS power FROM ru GROUP BY 1, 2), fn AS (SELECT *, lag(power) OVER w AS before, lead(power) OVER w AS after FROM fl WINDOW w AS (PARTITION BY star_id ORDER BY run)),
mx AS (SELECT fn.star_id, hs.mid AS p0, fn.power FROM fn JOIN hs ON hs.star_id = fn.star_id AND hs.g = (g0 + g1) // 2 WHERE fn.power > before AND fn.power > after),
al AS (SELECT * FROM mx UNION ALL (SELECT star_id, arg_max(mid, (power, -g)), max(power) FROM hs WHERE star_id NOT IN (SELECT star_id FROM mx) GROUP BY 1)),
rk AS (SELECT *, CAST(row_number() OVER (PARTITION BY star_id ORDER BY power DESC, p0 DESC) AS INTEGER) AS rank FROM al), ff AS (SELECT star_id, min(lag) AS first, count(*) AS n FROM pk GROUP BY 1)
SELECT rk.star_id, rank, round(p0, 6) AS p0, round(max(power) / greatest(max(n) - 1, 1), 6) AS strength, max(power)::BIGINT AS support, round(avg(CASE WHEN abs(lag - first - round_even((lag - first) / p0, 0) * p0) <= 0.1::DOUBLE * p0 THEN 1 ELSE 0 END), 6) AS coverage, 'pairwise_histogram' AS method
FROM rk JOIN ff USING (star_id) JOIN pk ON pk.star_id = rk.star_id WHERE rank <= 5 GROUP BY rk.star_id, rank, p0"""


def event_peaks(spark, sf_dir):
    return H.acf_peaks(event_acf(spark, sf_dir), 1 / 24, SIGMAS)


@query("e9_prominent_peaks", f"{_LC}{_PEAKS} SELECT star_id, k, round(lag, 6) AS lag, round(height, 6) AS height FROM pk")
def _(spark, sf_dir):
    return rounded(event_peaks(spark, sf_dir), "lag", "height")


@query("k1_spacing_histogram", f"{_LC}{_PEAKS}{_HIST} SELECT star_id, g, round(mid, 6) AS spacing, power AS n FROM hs")
def _(spark, sf_dir):
    return H.spacing_histogram(event_peaks(spark, sf_dir), 1 / 24).select("star_id", "g", F.round("freq", 6).alias("spacing"), F.col("power").alias("n"))


@query("k1_pairwise_events", f"{_LC}{_PEAKS}{_HIST}{_RANKED}")
def _(spark, sf_dir):
    return rounded(H.peak_spacings(event_acf(spark, sf_dir), 1 / 24, sigmas=SIGMAS), "p0", "strength", "coverage")


_SHARES = [0.05, 0.25, 0.5, 0.75, 0.95]


@query("d9_group_quantiles", "SELECT l_returnflag, l_linestatus, share, round(quantile_cont(l_extendedprice, [0.05, 0.25, 0.5, 0.75, 0.95])[k], 6) AS value FROM lineitem, (VALUES (1, 0.05::DOUBLE), (2, 0.25), (3, 0.5), (4, 0.75), (5, 0.95)) s(k, share) GROUP BY l_returnflag, l_linestatus, share, k")
def _(spark, sf_dir):
    """A few groups that hold all rows of the largest table."""
    return rounded(Q.group_quantiles(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice", _SHARES), "value")


def _view(curves, name: str) -> str:
    curves.createOrReplaceTempView(name)
    guessers.register(curves.sparkSession)
    return name


@query("t_guess_acf_fft", f"{_LC}{dft_sql()}{PEAKS_SQL} SELECT star_id, CAST(rank AS INTEGER) AS rank, round(p0, 6) AS p0, round(strength, 6) AS strength, 'acf_fft' AS method FROM rk WHERE rank <= 5")
def _(spark, sf_dir):
    view = _view(L.event_curves(spark, sf_dir), "periscan_event_curves")
    return rounded(spark.sql(f"SELECT * FROM guess_acf_fft(1 / 24D, 5, TABLE({view}) PARTITION BY star_id)"), "p0", "strength")


@query("t_guess_lombscargle", f"{_USERS}{_GRID.format(low='2 / span', samples=1)}{_TOPS.format(method='lombscargle').replace('SELECT star_id, round(1', 'SELECT CAST(star_id AS VARCHAR) AS star_id, round(1')}")
def _(spark, sf_dir):
    view = _view(L.user_curves(spark, sf_dir), "periscan_user_curves")
    return rounded(spark.sql(f"SELECT * FROM guess_lombscargle(1, 5, TABLE({view}) PARTITION BY star_id)"), "p0", "strength")


_BINNED = """, t AS (SELECT star_id, min(time) AS t0, CAST(floor(max(time) - min(time) - 1e-9) AS BIGINT) AS bins FROM lc GROUP BY 1), g AS (SELECT star_id, unnest(range(0, bins)) AS i FROM t),
b AS (SELECT lc.star_id, CAST(floor(time - t0) AS BIGINT) AS i, flux, row_number() OVER (PARTITION BY lc.star_id, floor(time - t0) ORDER BY flux) AS r, count(*) OVER (PARTITION BY lc.star_id, floor(time - t0)) AS n FROM lc JOIN t USING (star_id) WHERE flux IS NOT NULL)"""


@query("d16_bin_medians", f"{_USERS}{_BINNED} SELECT g.star_id, g.i, round(median(flux), 6) AS flux, count(flux) AS n FROM g LEFT JOIN b ON b.star_id = g.star_id AND b.i = g.i GROUP BY 1, 2")
def _(spark, sf_dir):
    return rounded(S.bin_curve(L.user_curves(spark, sf_dir), 1.0, F.median).select("star_id", "i", "flux", "n"), "flux")


@query("d16_bin_trimmed_means", f"{_USERS}{_BINNED} SELECT g.star_id, g.i, round(avg(flux) FILTER (WHERE r > floor(n * 0.2::DOUBLE) AND r <= n - floor(n * 0.2::DOUBLE)), 6) AS flux, count(flux) AS n FROM g LEFT JOIN b ON b.star_id = g.star_id AND b.i = g.i GROUP BY 1, 2")
def _(spark, sf_dir):
    return rounded(S.bin_curve(L.user_curves(spark, sf_dir), 1.0, trimmed_mean(0.2)).select("star_id", "i", "flux", "n"), "flux")


@query("q7_phase_medians", f"{_USERS} SELECT star_id, 2.9::DOUBLE AS p, CAST(least(floor((time / 2.9::DOUBLE - floor(time / 2.9::DOUBLE)) * 20), 19) AS INTEGER) AS bin, round(median(flux), 6) AS median, count(*) AS n FROM lc WHERE flux IS NOT NULL GROUP BY 1, 3")
def _(spark, sf_dir):
    lc = L.user_curves(spark, sf_dir)
    periods = lc.select("star_id").distinct().select("star_id", F.lit(2.9).alias("p"), F.lit(0.0).alias("t0"))
    return P.phase_fold(lc, periods, statistic=F.median).select("star_id", "p", "bin", F.round("mean", 6).alias("median"), "n")


_WEIGHTS = """, cb AS (SELECT star_id, n / 24.0 AS p, 3 / 24.0 AS t0 FROM (SELECT DISTINCT star_id FROM acf), (SELECT unnest(range(6, 37)) AS n)), sn AS (SELECT star_id, max(lag) AS l1, max(k) AS k1 FROM acf GROUP BY 1),
te AS (SELECT star_id, p, n, (t0 + n * p) * 24.0 AS x, k1 FROM (SELECT *, unnest(range(0, 6)) AS n FROM cb JOIN sn USING (star_id)) WHERE t0 + n * p <= l1),
tv AS (SELECT te.star_id, p, n, a.acf + (b.acf - a.acf) * (x - least(floor(x), k1 - 1)) AS v FROM te JOIN acf a ON a.star_id = te.star_id AND a.k = least(floor(x), k1 - 1) JOIN acf b ON b.star_id = te.star_id AND b.k = a.k + 1)
SELECT star_id, round(p, 6) AS p, round(avg(v), 6) AS flat, round(sum(exp(-n / 2.0) * v) / sum(exp(-n / 2.0)), 6) AS falling FROM tv GROUP BY star_id, p"""


@query("k11_comb_score_weights", f"{_LC}{_ACF}{_WEIGHTS}")
def _(spark, sf_dir):
    series = event_acf(spark, sf_dir)
    combs = L.event_curves(spark, sf_dir).select("star_id").distinct().select("star_id", F.explode(F.sequence(F.lit(6), F.lit(36))).alias("n")).select("star_id", (F.col("n") / 24.0).alias("p"), F.lit(3 / 24.0).alias("t0"))
    flat = D.comb_score(series, combs, weight=lambda n: F.lit(1.0)).withColumnRenamed("score", "flat")
    falling = D.comb_score(series, combs, weight=lambda n: F.exp(-n / 2)).withColumnRenamed("score", "falling")
    return rounded(flat.join(falling, ["star_id", "p", "t0"]).drop("t0"), "p", "flat", "falling")


_SECTORS = """, sg AS (SELECT star_id, time, flux, CAST(floor(time / 2.5) AS INTEGER) AS segment FROM lc WHERE flux IS NOT NULL), sc AS (SELECT *, segment // 2 + 1 AS sector, (star_id + 3 * segment) % 5 = 0 AS flagged FROM sg)"""
_DIVIDED = "SELECT star_id, CAST(sector AS INTEGER) AS sector, segment, round(time, 6) AS time, round(flux / nullif(median(flux) OVER (PARTITION BY star_id, sector), 0), 6) AS flux FROM"


def user_segments(spark, sf_dir):
    """Segments of two and a half days of the users' curves, and a stand-in for their flags."""
    points = L.user_curves(spark, sf_dir).where("flux is not null").withColumn("segment", F.floor(F.col("time") / 2.5).cast("int"))
    return points, points.select("star_id", "segment").distinct().withColumn("flagged", (F.col("star_id") + 3 * F.col("segment")) % 5 == 0)


@query("i8_sector_points", f"{_USERS}{_SECTORS} {_DIVIDED} (SELECT * FROM sc WHERE NOT flagged)")
def _(spark, sf_dir):
    return rounded(P.sector_points(*user_segments(spark, sf_dir), exclude_flagged=True), "time", "flux")


@query("i8_chosen_sectors", f"{_USERS}{_SECTORS} {_DIVIDED} (SELECT * FROM sc WHERE sector IN (1, 2, 4, 99) AND (star_id, sector) NOT IN (SELECT (star_id, sector) FROM sc WHERE flagged))")
def _(spark, sf_dir):
    return rounded(P.sector_points(*user_segments(spark, sf_dir), sectors=[1, 2, 4, 99]), "time", "flux")


def event_ensemble(spark, sf_dir):
    """The candidates of the event curves, with their halves, doubles and thirds."""
    series = event_acf(spark, sf_dir)
    return series, C.ensemble(series, K.guess_acf_fft(series, n_guesses=3), 1 / 24)


@query("k12_ensemble")
def _(spark, sf_dir):
    return event_ensemble(spark, sf_dir)[1].select("star_id", "place", "n_tried", "p0", "p", "p_err", "t0", "t0_err", "redchi", "n_peaks_used", "frac_positive")


@query("q_comb_fit_curve")
def _(spark, sf_dir):
    """The best fit of each event curve at the lags that it was fitted to."""
    series, fits = event_ensemble(spark, sf_dir)
    return C.comb_curve(fits.where("place = 1"), series)


@query(
    "s2_streamed_bins",
    """WITH c AS (SELECT user_id AS star_id, CAST(floor((epoch_ms(ts) - 1704067200000) / 86400000.0) AS BIGINT) AS i, value FROM events), m AS (SELECT max(epoch_ms(ts)) - 2 * 86400000 AS mark FROM events)
SELECT star_id, i, i + 0.5::DOUBLE AS time, round(avg(value), 6) AS flux, count(value) AS n FROM c, m WHERE 1704067200000 + (i + 1) * 86400000 <= mark GROUP BY star_id, i""",
)
def _(spark, sf_dir):
    """Daily bins of every user's curve, from a stream of the events; those still open at its end are left out."""
    return rounded(O.replay_bins(spark, sf_dir), "flux")


@query(
    "m2_pdm_refine_users",
    f"""{_USERS}, w AS (SELECT star_id, var_samp(flux) AS av, count(*) AS n, min(time) AS t0 FROM lc GROUP BY 1), tr AS (SELECT 2.9::DOUBLE * (1 - 0.02::DOUBLE + 2 * 0.02::DOUBLE * j / 200) AS p FROM (SELECT unnest(range(0, 201)) AS j)),
f AS (SELECT lc.star_id, p, least(CAST(floor(((time - t0) / p - floor((time - t0) / p)) * 10) AS BIGINT), 9) AS bin, flux, av, n FROM lc JOIN w USING (star_id), tr),
b AS (SELECT star_id, p, bin, var_samp(flux) AS v, count(*) AS m, max(av) AS av, max(n) AS n FROM f GROUP BY 1, 2, 3 HAVING count(*) >= 2),
t AS (SELECT star_id, p, round(CASE WHEN max(n) >= 20 AND max(av) > 0 AND max(n) > count(*) THEN sum((m - 1) * v) / ((max(n) - count(*)) * max(av)) END, 9) AS theta FROM b GROUP BY star_id, p)
SELECT star_id, 2.9::DOUBLE AS p0, round(arg_min(p, (theta, p)), 6) AS p, round(min(theta), 6) AS theta FROM t WHERE theta IS NOT NULL GROUP BY star_id""",
)
def _(spark, sf_dir):
    """A period of 2.9 days refined on every user's curve."""
    lc = L.user_curves(spark, sf_dir)
    return rounded(D.refine_by_dispersion(lc, lc.select("star_id").distinct().withColumn("p", F.lit(2.9))), "p", "theta")


def event_candidates(spark, sf_dir):
    curves = Curves.of(L.event_curves(spark, sf_dir), 1 / 24)
    return curves, gather(curves, ["acf_fft", "lombscargle"])[0]


@query("l4_event_outcomes")
def _(spark, sf_dir):
    """The chosen period of every event curve, with its errors."""
    curves, found = event_candidates(spark, sf_dir)
    return rounded(C.outcomes(curves.series, found, C.rotation_periods(curves.series, found, curves.dt)), "p", "t0", "p_err", "t0_err")


@query("n_event_features")
def _(spark, sf_dir):
    """The table of features of the event curves' candidates."""
    return feature_table(Curves.of(L.event_curves(spark, sf_dir), 1 / 24))


@query(
    "e14_interpolated",
    f"""{_LC}, t AS (SELECT star_id, min(i) AS lo, max(i) AS hi FROM lc GROUP BY 1), g AS (SELECT star_id, lo, unnest(range(0, hi - lo + 1)) AS i FROM t),
d AS (SELECT g.star_id, g.i, flux, last_value(CASE WHEN flux IS NOT NULL THEN g.i END IGNORE NULLS) OVER b AS i0, last_value(flux IGNORE NULLS) OVER b AS f0, first_value(CASE WHEN flux IS NOT NULL THEN g.i END IGNORE NULLS) OVER a AS i1, first_value(flux IGNORE NULLS) OVER a AS f1
FROM g LEFT JOIN lc ON lc.star_id = g.star_id AND lc.i = g.lo + g.i WINDOW b AS (PARTITION BY g.star_id ORDER BY g.i ROWS UNBOUNDED PRECEDING), a AS (PARTITION BY g.star_id ORDER BY g.i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT star_id, i, round(coalesce(flux, f0 + (f1 - f0) * (i - i0) / greatest(i1 - i0, 1), f0, f1), 6) AS flux FROM d""",
)
def _(spark, sf_dir):
    """The event curves without gaps: missing hours lie on straight lines."""
    return rounded(dense_curves(spark, sf_dir).select("star_id", "i", "flux"), "flux")
