"""Registered queries of the small table operators; importing this adds them to the catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from periscan.operators import acf as A
from periscan.operators import benchmark as B
from periscan.operators import evidence as E
from periscan.operators import pools as P
from periscan.operators import series as S
from periscan.plans.catalogue import _ACF, _CANDIDATES, _LC, _USERS, event_acf, query, rounded, summary_candidates
from periscan.session import table
from periscan.sources import light_curves as L

_ERR = _USERS.replace("value AS flux FROM", "value AS flux, abs(value) / 10 + 0.01 AS flux_err FROM")


def _with_errors(spark, sf_dir):
    return L.user_curves(spark, sf_dir).withColumn("flux_err", F.abs("flux") / 10 + 0.01)


@query("e4_trailing_std", f"{_LC} SELECT star_id, i, round(CASE WHEN count(flux) OVER w = 20 THEN stddev_samp(flux) OVER w END, 6) AS roll FROM lc WINDOW w AS (PARTITION BY star_id ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)")
def _(spark, sf_dir):
    return rounded(S.trailing_std(L.event_curves(spark, sf_dir)).select("star_id", "i", "roll"), "roll")


@query(
    "d8_modal_cadence",
    f"{_LC}, g AS (SELECT star_id, round_even((time - lag(time) OVER (PARTITION BY star_id ORDER BY time)) * 86400, 0) AS gap FROM lc), c AS (SELECT star_id, gap, count(*) AS n FROM g WHERE gap IS NOT NULL GROUP BY 1, 2), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY star_id ORDER BY n DESC, gap) AS k FROM c) SELECT star_id, gap AS cadence, NOT abs(1800 - gap) <= 1e-8 + 0.01 * abs(gap) AS differs FROM r WHERE k = 1",
)
def _(spark, sf_dir):
    return S.modal_cadence(L.event_curves(spark, sf_dir), 1800 / 86400)


@query("d14_slope", f"{_USERS} SELECT star_id, round(regr_slope(flux, time), 6) AS slope FROM lc GROUP BY 1")
def _(spark, sf_dir):
    return rounded(S.slope(L.user_curves(spark, sf_dir)), "slope")


@query(
    "d16_bin_errors",
    _ERR
    + """, t AS (SELECT star_id, min(time) AS t0, CAST(floor(max(time) - min(time) - 1e-9) AS BIGINT) AS bins FROM lc GROUP BY 1), g AS (SELECT star_id, t0, unnest(range(0, bins)) AS i FROM t),
c AS (SELECT lc.star_id, CAST(floor(time - t0) AS BIGINT) AS i, avg(flux) AS flux, sqrt(sum(flux_err * flux_err)) / count(*) AS e FROM lc JOIN t USING (star_id) GROUP BY 1, 2)
SELECT g.star_id, g.i, round(c.flux, 6) AS flux, round(c.e, 6) AS flux_err FROM g LEFT JOIN c ON g.star_id = c.star_id AND g.i = c.i""",
)
def _(spark, sf_dir):
    return rounded(S.bin_curve(_with_errors(spark, sf_dir), 1.0).select("star_id", "i", "flux", "flux_err"), "flux", "flux_err")


@query(
    "i1_even_cadence_errors",
    _ERR
    + """, t AS (SELECT star_id, min(time) AS t0, max(time) AS t1 FROM lc GROUP BY 1), g AS (SELECT star_id, unnest(range(0, CAST(round_even((t1 - t0) / 0.25, 0) AS BIGINT) + 1)) AS i FROM t),
p AS (SELECT lc.star_id, CAST(round_even((time - t0) / 0.25, 0) AS BIGINT) AS i, max(struct_pack(time := time, flux := flux, flux_err := flux_err)) AS o FROM lc JOIN t USING (star_id) GROUP BY 1, 2)
SELECT g.star_id, g.i, round(o.flux, 6) AS flux, round(o.flux_err, 6) AS flux_err FROM g LEFT JOIN p ON g.star_id = p.star_id AND g.i = p.i""",
)
def _(spark, sf_dir):
    return rounded(S.even_cadence(_with_errors(spark, sf_dir), 0.25).select("star_id", "i", "flux", "flux_err"), "flux", "flux_err")


@query(
    "d17_histogram",
    f"{_LC}, e AS (SELECT star_id, min(flux) AS a, max(flux) AS b FROM lc GROUP BY 1), c AS (SELECT lc.star_id, CAST(least(floor((flux - a) / (b - a) * 20), 19) AS INTEGER) AS bin, count(*) AS n FROM lc JOIN e USING (star_id) WHERE b > a GROUP BY 1, 2), "
    "g AS (SELECT star_id, a, b, unnest(range(0, 20)) AS bin FROM e WHERE b > a) SELECT g.star_id, CAST(g.bin AS INTEGER) AS bin, round(a + (b - a) * g.bin / 20, 6) AS lo, round(a + (b - a) * (g.bin + 1) / 20, 6) AS hi, coalesce(n, 0) AS n FROM g LEFT JOIN c ON c.star_id = g.star_id AND c.bin = g.bin",
)
def _(spark, sf_dir):
    return rounded(S.histogram(L.event_curves(spark, sf_dir), "flux", 20), "lo", "hi")


@query("g2_pool_union", f"{_CANDIDATES} SELECT DISTINCT star_id, p0 FROM cand WHERE method < '3' UNION SELECT star_id, p0 FROM cand WHERE rank = 1")
def _(spark, sf_dir):
    pool = summary_candidates(spark, sf_dir)
    return P.pool_union(pool.where("method < '3'"), pool.where("rank = 1"))


_LISTS = "SELECT o_orderkey AS i, '[' || (o_orderkey % 3 + 1) || ', ' || (o_orderkey % 5 + 10) || ', ' || (o_orderkey % 2 + 13) || ']' AS sectors FROM orders"


@query("g3_sector_lists", f"WITH l AS ({_LISTS}), p AS (SELECT i, [v for v in CAST(sectors AS INTEGER[]) if v <= 13] AS s FROM l) SELECT array_to_string(s, ',') AS sectors, min(i) AS first, count(*) AS n FROM p GROUP BY 1")
def _(spark, sf_dir):
    k = F.col("o_orderkey")
    text = F.concat(F.lit("["), F.concat_ws(", ", (k % 3 + 1).cast("string"), (k % 5 + 10).cast("string"), (k % 2 + 13).cast("string")), F.lit("]"))
    lists = P.sector_lists(table(spark, sf_dir, "orders").select(k.alias("i"), text.alias("sectors")))
    return lists.withColumn("sectors", F.array_join(F.col("sectors").cast("array<string>"), ","))


@query("d5_first_of_each", f"{_CANDIDATES}, r AS (SELECT *, row_number() OVER (PARTITION BY star_id ORDER BY rank, p0, method) AS n FROM cand) SELECT star_id, method, rank, p0 FROM r WHERE n = 1")
def _(spark, sf_dir):
    return P.first_of_each(summary_candidates(spark, sf_dir), ["star_id"], ["rank", "p0", "method"]).select("star_id", "method", "rank", "p0")


@query("c3_attached_parameters", f"{_CANDIDATES} SELECT cand.star_id, method, rank, p0, c_acctbal AS true_period, c_mktsegment AS segment FROM cand LEFT JOIN customer ON c_custkey = cand.star_id")
def _(spark, sf_dir):
    stars = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("star_id"), F.col("c_acctbal").alias("true_period"), F.col("c_mktsegment").alias("segment"))
    return P.attach(summary_candidates(spark, sf_dir), stars)


@query("c4_side_by_side", f"{_CANDIDATES}, a AS (SELECT star_id, method, rank, p0 FROM cand), b AS (SELECT star_id, method, rank, p0 > true_period AS longer FROM cand) SELECT * FROM a JOIN b USING (star_id, method, rank)")
def _(spark, sf_dir):
    pool = summary_candidates(spark, sf_dir)
    return P.side_by_side(pool.select("star_id", "method", "rank", "p0"), pool.select("star_id", "method", "rank", (F.col("p0") > F.col("true_period")).alias("longer")), ["star_id", "method", "rank"])


@query("f4_every_tenth", "SELECT c_custkey AS star_id FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS n FROM customer WHERE c_acctbal > 0) WHERE n % 10 = 1")
def _(spark, sf_dir):
    stars = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("star_id"))
    return B.average_rank(stars, "star_id", "n").where("n % 10 = 1").drop("n")  # keys are distinct, so that a rank is a number


_BIASED = """, v AS (SELECT star_id, avg(flux) AS m, min(i) AS lo, max(i) AS hi FROM lc GROUP BY 1), x AS (SELECT lc.star_id, i, flux - m AS x, CAST(floor((hi - lo) / 3.0 + 1e-9) AS BIGINT) AS most FROM lc JOIN v USING (star_id)),
r AS (SELECT a.star_id, b.i - a.i AS k, sum(a.x * b.x) AS c FROM x a JOIN x b ON a.star_id = b.star_id AND b.i >= a.i AND b.i - a.i <= a.most GROUP BY 1, 2)
SELECT star_id, k, round(c / max(CASE WHEN k = 0 THEN c END) OVER (PARTITION BY star_id), 6) AS acf FROM r"""


@query("j2_acf_biased", _LC + _BIASED)
def _(spark, sf_dir):
    return rounded(A.acf(L.event_curves(spark, sf_dir), 1 / 24, min_valid_frac=0.0, gaps=False).select("star_id", "k", "acf"), "acf")


@query(
    "m4_composite_prominence",
    _LC
    + _ACF
    + """, nr AS (SELECT star_id, lag, acf FROM acf WHERE abs(lag - 1.13) <= 0.65), tp AS (SELECT star_id, max(acf) AS g, arg_max(lag, acf) AS pl FROM nr GROUP BY 1 HAVING count(*) >= 3)
SELECT star_id, 1.3::DOUBLE AS p, 1.13::DOUBLE AS t0, round(g, 6) AS g_height, round(g - (min(acf) FILTER (WHERE lag <= pl) + min(acf) FILTER (WHERE lag >= pl)) / 2, 6) AS h_rise FROM nr JOIN tp USING (star_id) GROUP BY star_id, g, pl""",
)
def _(spark, sf_dir):
    fits = L.event_curves(spark, sf_dir).select("star_id").distinct().select("star_id", F.lit(1.3).alias("p"), F.lit(1.13).alias("t0"))
    return rounded(E.composite_prominence(event_acf(spark, sf_dir), fits).select("star_id", "p", "t0", "g_height", "h_rise"), "g_height", "h_rise")
