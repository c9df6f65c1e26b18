"""Tables, lists and curves in files: CSV in and out, lists of paths, and FITS files through to even cadence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from periscan.operators.segments import recombine, split_segments
from periscan.operators.series import even_cadence
from periscan.sources import fits


def read_csv(spark: SparkSession, path: str, schema: str | None = None, index: bool = False) -> DataFrame:
    """A CSV table with a header. Without ``schema``, types are inferred by a pass over the data. ``index``: the first column is a row number and is left out."""
    reader = spark.read.option("header", True)
    df = reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)
    return df.drop(df.columns[0]) if index else df


def write_csv(df: DataFrame, path: str) -> None:
    """A folder of CSV parts with headers; nulls are empty fields."""
    df.write.mode("overwrite").option("header", True).csv(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line) of a text file, without blanks around it and without empty ones."""
    return spark.read.text(path).select(F.trim("value").alias("line")).where("line <> ''")


def write_lines(df: DataFrame, column: str, path: str) -> None:
    df.select(F.col(column).cast("string").alias("value")).write.mode("overwrite").text(path)


def paths(spark: SparkSession, list_file: str | None = None, glob: str | None = None) -> list[str]:
    """Paths from a list, in its order, or those that match ``glob``, sorted. They name files, not rows: the driver hands them to readers."""
    if (list_file is None) == (glob is None):
        raise ValueError("give a list or a pattern")
    if list_file is not None:
        return [r.line for r in read_lines(spark, list_file).collect()]
    return [r.path for r in spark.read.format("binaryFile").load(glob).select("path").orderBy("path").collect()]


def load_curves(
    spark: SparkSession, files: str | list[str], n_segments: int = 27, sectors: list[int] | None = None, drop_gap_points: bool = True, drop_flagged: bool = True, timestep: float = 1800.0, unit: str = "LIGHTCURVE", **split_options
) -> tuple[DataFrame, DataFrame]:
    """Curves of FITS files, ready for the search, and (star_id, error) of the files that can't be read.

    Each curve is cut into segments at its gaps, put together again without
    flagged segments and filled-in points (or of whole ``sectors`` alone), and laid on a grid of ``timestep`` seconds.
    """
    raw = fits.light_curves(spark, files, unit)
    points, stats = split_segments(raw.where("error is null and time is not null").drop("error"), n_segments, **split_options)
    kept = recombine(points, stats, drop_gap_points, drop_flagged, sectors)
    return even_cadence(kept.where("flux is not null"), timestep / 86400), raw.where("error is not null").select("star_id", "error")
