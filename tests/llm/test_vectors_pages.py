"""Nearest neighbours and web archives: recall against brute force, exact round trips."""

import gzip
import hashlib

import numpy as np
from pyspark.sql import functions as F

from periscan.llm import forest, warc


def test_recall_and_exact_scores(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1500, 16)).astype("float32")
    x[700:760] = x[700]  # copies
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<float>, rank int").repartition(4)
    got = {}
    for r in forest.nearest(df, df.where("vec_id % 100 = 0")).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    hits = 0
    y = x.astype(np.float64)
    for q in range(0, 1500, 100):
        d = np.sqrt(((y - y[q]) ** 2).sum(1))
        want = [i for i in np.lexsort((np.arange(1500), d)) if i != q][:10]
        assert sorted(got[q]) == list(range(1, 11)) and all(abs(s - d[i]) < 1e-12 for i, s in got[q].values())
        hits += len(set(want) & {i for i, _ in got[q].values()})
    assert hits >= 0.9 * 150
    assert [got[700][k] for k in range(1, 11)] == [(i, 0.0) for i in range(701, 711)]


def test_recall_on_the_embeddings(spark):
    from periscan.llm.queries import op9_forest_neighbours

    sf = "/root/testdata/sf0.1"
    got = {}
    for r in op9_forest_neighbours(spark, sf).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").toPandas()
    ids, x = rows["vec_id"].to_numpy(), np.stack(rows["embedding"]).astype(np.float64)
    found = []
    for q in got:
        d = np.sqrt(((x - x[ids == q]) ** 2).sum(1))
        want = [i for i in ids[np.lexsort((ids, d))][:11] if i != q][:10]
        found.append(len(got[q] & set(want)))
    assert len(found) == (ids % 100 == 0).sum() and np.mean(found) >= 9.3


def test_ties_go_to_smaller_ids(spark):
    order = np.random.default_rng(5).permutation(600)
    rows = [(int(i), [1.0 if k == i else 0.0 for k in range(600)]) for i in order]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    got = {}
    for r in forest.nearest(df, df.where("vec_id % 100 = 0"), share=20.0, leaves=1).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    for q, found in got.items():
        assert [i for _, i in sorted(found)] == [i for i in range(12) if i != q][:10]


def test_searches_of_a_leaf_are_split(spark, monkeypatch):
    monkeypatch.setattr(forest, "BLOCK_SEARCHES", 7)
    monkeypatch.setattr(forest, "BLOCK_ROWS", 50)
    x = np.random.default_rng(1).normal(size=(300, 4))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in forest.nearest(df, df, k=3, share=100.0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    for q in range(300):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        assert [i for _, i in sorted(got[q])] == [i for i in np.argsort(d) if i != q][:3]


def test_unusable_vectors_and_few_rows(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, None), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, []), (8, [1.0, 2.0, 3.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = forest.nearest(df, df).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in got) == [(0, 1, 1), (1, 1, 0)]
    assert forest.nearest(df.limit(0), df).count() == 0


def pages(spark):
    long = "p" * 2000 + "é"
    rows = [(1, "http://a/1", long), (2, "http://a/2", long), (3, "http://b/3", "short"), (4, "http://b/4", "short"), (5, None, None), (6, "http://c/ü\r\nx", ""), (7, "http://c/7", long), (7, "http://c/7", long), (None, "http://d", long)]
    return spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, payload string").repartition(3)


def test_archive_round_trip(spark):
    df = pages(spark)
    path = warc.archive_pages(df)
    got = sorted((str(r.page_id), r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in warc.page_records(spark, path).collect())
    sha = lambda t: hashlib.sha1((t or "").encode()).hexdigest()
    long = "p" * 2000 + "é"
    want = [(str(i), "revisit" if i in (1, 2) else "response", 7 if i in (1, 2) else None, len((t or "").encode()), sha(t)) for i, t in [(1, long), (2, long), (3, "short"), (4, "short"), (5, None), (6, ""), (7, long), (7, long), (None, long)]]
    assert got == sorted(want, key=lambda r: (r[0], r[1]))
    full = spark.read.format("warc").option("path", path).load()
    assert {bytes(r.payload).decode() for r in full.where("record_type = 'response'").collect()} == {long, "short", ""}


def test_header_filters_are_pushed_down(spark):
    path = warc.archive_pages(pages(spark))
    read = spark.read.format("warc").option("path", path).option("payload", "false").load()
    assert read.where("record_type = 'revisit'").count() == 2
    assert read.where(F.col("target_uri").startswith("http://b/")).count() == 2
    assert read.where("record_type = 'warcinfo'").count() >= 1


def test_plain_archives_and_members_without_lengths(spark, tmp_path):
    one = warc.record({"WARC-Type": "resource", "WARC-Record-ID": "<urn:a>", "Content-Type": "text/plain"}, b"x" * 9000)
    two = warc.record({"WARC-Type": "resource", "WARC-Record-ID": "<urn:b>", "Content-Type": "text/plain"}, b"")
    (tmp_path / "a.warc").write_bytes(one + two)
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(one) + gzip.compress(two) + warc.member(one))
    warc.register(spark)
    got = spark.read.format("warc").option("path", f"file://{tmp_path}").load().collect()
    assert sorted((r.record_id, len(r.payload)) for r in got) == [("<urn:a>", 9000)] * 3 + [("<urn:b>", 0)] * 2


def test_members_with_many_records(spark, tmp_path):
    def rec(name, size):
        return warc.record({"WARC-Type": "resource", "WARC-Record-ID": f"<urn:{name}>", "Content-Type": "text/plain"}, name.encode() * size)

    every = [(f"r{k}", [0, 1, 5000, 3_000_000][k % 4]) for k in range(12)]
    (tmp_path / "one.warc.gz").write_bytes(gzip.compress(b"".join(rec(*x) for x in every)))
    (tmp_path / "own.warc.gz").write_bytes(warc.member(b"".join(rec(*x) for x in every[:5])) + warc.member(rec("last", 9)))
    warc.register(spark)
    for payload in ("true", "false"):
        read = spark.read.format("warc").option("path", f"file://{tmp_path}").option("payload", payload).load()
        got = sorted((r.record_id, len(r.payload) if r.payload is not None else None) for r in read.collect())
        want = [(f"<urn:{n}>", len(n) * s if payload == "true" else None) for n, s in [*every, *every[:5], ("last", 9)]]
        assert got == sorted(want)
        assert [r.record_id for r in read.where("record_id = '<urn:r7>'").collect()] == ["<urn:r7>"]


def test_payloads_are_read_back_and_checked(spark):
    import glob
    import os

    import pytest

    path = warc.archive_pages(spark.createDataFrame([(1, "u", "x" * 50)], "page_id long, url string, html string"))
    (name,) = glob.glob(path.removeprefix("file://") + "/part-*")
    with open(name, "rb") as f:
        texts = gzip.decompress(f.read())
    with open(name, "wb") as f:
        f.write(gzip.compress(texts.replace(b"xxxx", b"xxxy")))
    os.remove(path.removeprefix("file://") + "/_manifest.json")  # it has the old size
    with pytest.raises(Exception, match="differs from its headers"):
        warc.page_records(spark, path).collect()


def test_very_long_pages(spark):
    big = "<p>é</p>" * 500_000
    df = spark.createDataFrame([(1, "u", big), (2, "v", big), (3, "w", "short")], "page_id long, url string, html string")
    got = {r.page_id: (r.record_type, r.payload_bytes) for r in warc.page_records(spark, warc.archive_pages(df)).collect()}
    assert got == {1: ("revisit", 4_500_000), 2: ("response", 4_500_000), 3: ("response", 5)}


def test_pages_with_clashing_columns(spark):
    clash = {c: F.lit("clash") for c in ("record_type", "record_id", "refers_to", "payload_digest", "payload_bytes", "path", "offset", "digest", "latest")}
    rows = lambda df: sorted((str(r.page_id), r.record_type, str(r.refers_to), r.payload_bytes, r.payload_digest) for r in warc.page_records(spark, warc.archive_pages(df)).collect())
    assert rows(pages(spark).withColumns(clash)) == rows(pages(spark))


def test_empty_pages(spark):
    assert warc.page_records(spark, warc.archive_pages(pages(spark).limit(0))).count() == 0
