"""The FITS data source: schema, columns, row ranges, pushed filters, and what it leaves unread."""

import struct

import pytest
from pyspark.sql import functions as F
from test_evidence import cards, fits_file

from periscan.sources import fits, fits_table


def unit(name, rows, form, columns, more=()):
    width = struct.calcsize(">" + form)
    head = cards(
        ("XTENSION", "'BINTABLE'"), ("BITPIX", 8), ("NAXIS", 2), ("NAXIS1", width), ("NAXIS2", len(rows)), ("PCOUNT", 0), ("GCOUNT", 1), ("TFIELDS", len(columns)), ("EXTNAME", f"'{name}'"),
        *(x for k, (c, t) in enumerate(columns, 1) for x in ((f"TTYPE{k}", f"'{c}'"), (f"TFORM{k}", f"'{t}'"))), *more,
    )
    body = b"".join(struct.pack(">" + form, *r) for r in rows)
    return head + body.ljust(-(-len(body) // 2880) * 2880, b"\0")


def primary(period):
    return cards(("SIMPLE", "T"), ("BITPIX", 8), ("NAXIS", 0), ("PERIOD", period), ("BFLY", "T"), ("OBJECT", "'a star'"), ("CCD", 3))


@pytest.fixture
def folder(tmp_path):
    for k in range(5):
        rows = [(k + 0.5 * j, float(j), j - 1, b"T" if j % 2 else b"F", j) for j in range(40)]
        own = unit("LIGHTCURVE", rows, "dfhcb", [("TIME", "D"), ("FLUX", "E"), ("QUALITY", "I"), ("GOOD", "L"), ("LEVEL", "1B")], [("TNULL3", 7), ("TSCAL5", "0.5"), ("TZERO5", 10)])
        (tmp_path / f"star-{k}.fits").write_bytes(primary(1.0 + k) + unit("OTHER", [(1,)] * 9, "q", [("N", "K")]) + own)
    return tmp_path


def read(spark, path, **options):
    fits_table.register(spark)
    return spark.read.format("fits").options(**options).load(f"file://{path}")


def test_schema_and_values(spark, folder):
    df = read(spark, folder, keys="PERIOD,INCL,BFLY")
    assert df.dtypes == [("path", "string"), ("star_id", "string"), ("row", "bigint"), ("time", "double"), ("flux", "float"), ("quality", "double"), ("good", "boolean"), ("level", "double"), ("PERIOD", "double"), ("INCL", "double"), ("BFLY", "double")]
    rows = df.where("star_id = 'star-2'").orderBy("row").collect()
    assert len(rows) == 40 and [r.time for r in rows] == [2 + 0.5 * j for j in range(40)]
    assert rows[8].quality is None and rows[9].quality == 8 and rows[4].level == 12 and rows[3].good and not rows[4].good
    assert {(r.PERIOD, r.INCL, r.BFLY) for r in rows} == {(3.0, None, 1.0)}


def test_large_files_are_cut_into_row_ranges(spark, folder):
    whole = read(spark, folder).select("star_id", "row", "time")
    cut = read(spark, folder, split=4000).select("star_id", "row", "time")
    assert cut.rdd.getNumPartitions() > whole.rdd.getNumPartitions() and sorted(map(tuple, cut.collect())) == sorted(map(tuple, whole.collect()))


def test_filters_are_pushed_and_other_files_stay_unread(spark, folder):
    # Rows of these files are broken off: only their headers can be read.
    for k in (1, 2, 3):
        data = (folder / f"star-{k}.fits").read_bytes()
        (folder / f"star-{k}.fits").write_bytes(data[:2880])
    fits_table.register(spark)
    some = lambda: spark.read.format("fits").schema("star_id string, time double, PERIOD double, CCD double").options(keys="PERIOD,CCD").load(f"file://{folder}")
    assert some().where("PERIOD > 4.5").count() == 40 and some().where("PERIOD >= 1 and PERIOD < 2 and CCD = 3").count() == 40
    assert some().where("star_id in ('star-4')").where(F.col("star_id").startswith("star")).count() == 40 and some().where("PERIOD is not null and PERIOD = 5").count() == 40
    with pytest.raises(Exception, match="no unit named LIGHTCURVE"):
        some().count()
    heads = spark.read.format("fits").schema("star_id string, PERIOD double, OBJECT string, CCD int, BFLY boolean, NONE long").option("keys", "PERIOD,OBJECT,CCD,BFLY,NONE").load(f"file://{folder}")
    assert sorted(map(tuple, heads.collect())) == [(f"star-{k}", 1.0 + k, "a star", 3, True, None) for k in range(5)]


def test_units_before_the_table_are_passed_over(spark, tmp_path):
    """A unit of 20 GB that is not there: a hole in the file."""
    head = cards(("XTENSION", "'IMAGE'"), ("BITPIX", 8), ("NAXIS", 2), ("NAXIS1", 20_000_000), ("NAXIS2", 1000), ("PCOUNT", 0), ("GCOUNT", 1), ("EXTNAME", "'PIXELS'"))
    with open(tmp_path / "a.fits", "wb") as f:
        f.write(primary(2.0) + head)
        f.seek(-(-20_000_000_000 // 2880) * 2880, 1)
        f.write(unit("LIGHTCURVE", [(1.0, 2.0), (3.0, 4.0)], "dd", [("TIME", "D"), ("FLUX", "D")]))
    got = read(spark, tmp_path, split=1 << 40).orderBy("row").collect()
    assert [(r.time, r.flux) for r in got] == [(1.0, 2.0), (3.0, 4.0)]


def test_patterns_lists_broken_and_no_files(spark, tmp_path):
    (tmp_path / "a.fits").write_bytes(fits_file([(0.0, 1.5)]))
    (tmp_path / "b.fits").write_bytes(b"not a header".ljust(2880))
    (tmp_path / "c.txt").write_bytes(b"")
    assert read(spark, tmp_path / "a*.fits").count() == 1
    got = spark.read.format("fits").schema("star_id string, time double, error string").options(mode="permissive").load(f"file://{tmp_path}/*.fits").orderBy("star_id").collect()
    assert [(r.star_id, r.time) for r in got] == [("a", 0.0), ("b", None)] and got[0].error is None and "END" in got[1].error
    with pytest.raises(Exception, match="no files"):
        read(spark, tmp_path / "*.none").count()
    assert {r.star_id: r.PERIOD for r in fits.headers(spark, [f"file://{tmp_path}/a.fits", f"file://{tmp_path}/b.fits"], ["PERIOD"]).collect()} == {"a": 3.7, "b": None}
