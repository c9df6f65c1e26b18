"""Batch jobs for spark-submit: ``periscan.jobs batch`` and ``periscan.jobs analyse``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from periscan.functions.significance import correlation_p
from periscan.operators import benchmark as B
from periscan.operators.detectability import forest_importance
from periscan.operators.gather import METHODS, batch
from periscan.operators.pools import WINDOWS
from periscan.session import materialize
from periscan.sources import files, fits

PARAMETERS = ["activity", "cycle", "overlap", "incl", "minlat", "maxlat", "diffrot", "tspot", "bfly"]


def run_batch(spark: SparkSession, args: argparse.Namespace) -> None:
    """Curves (a Parquet table, or FITS files named by a list or a pattern) and their true periods to summary, candidates and failures."""
    if args.curves:
        lc, lost = spark.read.parquet(args.curves), None
        known = files.read_csv(spark, args.parameters)
    else:
        named = files.paths(spark, args.files, args.glob)
        lc, lost = files.load_curves(spark, named, args.segments, timestep=args.timestep)
        known = fits.headers(spark, named, ["PERIOD", *(p.upper() for p in PARAMETERS)]).withColumnRenamed("PERIOD", "true_period")
    got = batch(lc, known, args.timestep / 86400, args.methods or list(METHODS), args.windows, args.every_window)
    failures = got.failures if lost is None else got.failures.unionByName(lost.select("star_id", F.lit("__read__").alias("method"), "error"))
    for name, df in (("summary", got.summary), ("candidates", got.candidates), ("failures", failures)):
        files.write_csv(df, f"{args.out}/{name}.csv")


def run_analysis(spark: SparkSession, args: argparse.Namespace) -> None:
    """Tables on when periods are found, from a summary with the parameters of its stars.

    Hit rates by method, by structural ceiling and by high-pass window and band of periods; finding nothing, against all parameters and by
    activity; stars up to the cutoff and all stars, with how many methods found them; rank correlations, sweeps of parameters, the rate by
    the size of differential rotation, and a forest's importances. Tables whose columns a summary lacks are left out.
    """
    rows = files.read_csv(spark, args.summary).withColumns({"found": F.col("found_true_period").cast("int"), "period": F.col("true_period").cast("double")})
    names = [r["method"] for r in rows.select("method").distinct().orderBy("method").collect()]  # a few methods
    given = [p for p in PARAMETERS if p in rows.columns]
    rows = rows.withColumns({p: F.col(p).cast("double") for p in given})
    if "diffrot" in given:
        rows = rows.withColumns({"signed_diffrot": F.col("diffrot"), "diffrot": F.abs("diffrot")})
    stars = materialize(B.merged_stars(rows, names, ["period", *given]), "stars")
    near = stars.where(F.col("period") <= args.cutoff)
    half, third = args.baseline / 2, args.baseline / 3
    limits = {"acf_fft": third / 2, "pairwise_histogram": third, "lombscargle": half, "wavelet": half}
    nothing = F.col("n_candidates") == 0
    out = {
        "hit_rates": B.hit_rate(rows),
        "structural_cutoffs": B.ceilings(rows, limits),
        "zero_candidate_correlations": B.zero_candidate_correlations(rows, given, nothing).withColumn("p_value", correlation_p("point_biserial_r", "n")),
        "restricted_subsample": near,
        "merged_full": stars,
        "spearman_correlations": B.rank_correlations(near, ["period", *given], "found_by_any").withColumn("p_value", correlation_p("spearman_rho", "n")),
        "sweeps": B.sweeps(near, ["period", *given], "found_by_any", 8),
        "sweeps_by_band": B.sweeps(stars, given, "found_by_any", 6, bands=True),
        "star_totals": B.star_totals(rows),
    }
    if "activity" in given:
        out["zero_rate_by_activity"] = B.zero_rate_by_activity(rows, near, names, nothing)
    if "diffrot" in given:
        out["rate_by_diffrot"] = B.sweeps(near, ["diffrot"], "found_by_any", 7, low=0.0)
    if "smoothing_window" in rows.columns:
        out |= {"rate_by_window": B.rate_by_window(rows), "rate_by_window_and_band": B.rate_by_window_and_band(rows)}
    kinds = near.where(F.col("period").isNotNull()).agg(F.count_distinct("found_by_any").alias("n")).first()["n"]
    if kinds == 2 and args.trees:  # a forest needs stars of both kinds
        out["feature_importance"] = forest_importance(near.withColumns({p: F.coalesce(p, F.lit(0.0)) for p in given}), ["period", *given], "found_by_any", trees=args.trees, leaf=args.leaf)
    for name, df in out.items():
        files.write_csv(df, f"{args.out}/{name}.csv")


def main(argv: list[str] | None = None) -> None:
    top = argparse.ArgumentParser(prog="periscan.jobs")
    jobs = top.add_subparsers(required=True)
    b = jobs.add_parser("batch", help=run_batch.__doc__)
    source = b.add_mutually_exclusive_group(required=True)
    source.add_argument("--curves", help="Parquet: star_id, i, time, flux")
    source.add_argument("--files", help="a list of FITS files")
    source.add_argument("--glob", help="a pattern of FITS files")
    b.add_argument("--parameters", help="CSV: star_id, true_period, ... (with --curves)")
    b.add_argument("--out", required=True)
    b.add_argument("--methods", nargs="+", choices=sorted(METHODS))
    b.add_argument("--windows", nargs="+", type=float, default=WINDOWS)
    b.add_argument("--every-window", action="store_true")
    b.add_argument("--timestep", type=float, default=1800.0, help="seconds")
    b.add_argument("--segments", type=int, default=27)
    b.set_defaults(run=run_batch)
    a = jobs.add_parser("analyse", help=run_analysis.__doc__)
    a.add_argument("--summary", required=True)
    a.add_argument("--out", required=True)
    a.add_argument("--cutoff", type=float, default=50.0)
    a.add_argument("--baseline", type=float, default=357.04)
    a.add_argument("--trees", type=int, default=500, help="of the forest; 0: none")
    a.add_argument("--leaf", type=int, default=20, help="stars of a leaf at least")
    a.set_defaults(run=run_analysis)
    args = top.parse_args(argv)
    args.run(SparkSession.builder.appName("periscan").getOrCreate(), args)


if __name__ == "__main__":
    main()
