"""The whole pipeline against a brute-force version on the smallest tables."""

import zlib

import numpy as np
import sentencepiece
from test_documents import brute_groups

import corpus_pipeline
from periscan.llm import language
from periscan.llm.tokenize import vocabulary
from periscan.session import table


def test_pipeline_equals_brute_force(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = language.fit(docs.where(language.fold() != 2))
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    told = [(i, t, model.predict(t)) for i, t in rows]
    rows = [(i, t) for i, t, (name, _, margin) in told if name != "und" and margin >= language.MIN_MARGIN]
    groups = brute_groups(rows, 5)
    rows = [(i, t) for i, t in rows if groups[i][0] == 0 or groups[i][1] == i]
    items = [" ".join(r.text.split()) for r in table(spark, sf_dir, "benchmark").collect()]
    rows = [(i, t) for i, t in rows if not any(q in " ".join(t.split()) for q in items)]
    sp = sentencepiece.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))
    want = {i: zlib.crc32(np.array(sp.encode(t), "<u4").tobytes()) for i, t in rows}
    got = {r.doc_id: r.pieces_crc32 for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert got == want


def edge_documents(spark):
    german = "der Hund und die Katze gehen heute nicht in den Wald weil es dort sehr kalt ist und regnet"
    item = "Tom bought 12 apples and 7 pears at the market then Tom gave 12 apples to his sister who lives 5 km away near the old mill"
    rows = [
        (None, None, None, None, None),
        (1, None, "aa", "s", None),
        (2, "", "aa", None, 0),
        (3, "123 !!", None, "s", 6),
        (4, german, "de", "s", 90),
        (4, german, "de", "s", 90),
        (5, german, None, None, None),
        (6, german + " " + item, "de", "s", 200),
        (7, "x" * 300_000, "aa", "s", 300_000),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    return spark.createDataFrame([(*r, "clash", 1, 2.0) for r in rows], schema + ", lang_pred string, kept int, score double"), schema


def test_stages_on_edge_cases(spark, sf_dir):
    docs, schema = edge_documents(spark)
    names = corpus_pipeline.DOCUMENT_COLUMNS
    steps = dict(corpus_pipeline.STAGES)
    kept = steps["language"](spark, docs, sf_dir)
    assert kept.columns == names and not {r.doc_id for r in kept.collect()} & {None, 1, 2, 3}
    kept = steps["near_duplicates"](spark, docs, sf_dir)
    assert kept.columns == names
    assert sorted((r.doc_id for r in kept.collect()), key=lambda i: (i is not None, i)) == [None, 1, 2, 3, 4, 4, 6, 7]
    kept = steps["decontamination"](spark, docs, sf_dir)
    assert kept.columns == names and kept.count() == 9
    coded = steps["sentencepiece"](spark, docs, sf_dir).collect()
    assert len(coded) == 9 and all(r.same for r in coded)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, spark.createDataFrame([], schema), sf_dir).count() == 0, name


def test_queries_return_the_contracts_columns(spark, sf_dir):
    import __spark_entry__

    want = {
        "op2": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
        "op4": "doc_id bigint, held_out boolean, lang_pred string, score double",
        "op7": "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint",
        "op8": "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint",
        "op9": "query_id bigint, rank int, vec_id bigint, score double",
        "op10": "doc_id bigint, n_shingles bigint, component_id bigint, kept boolean",
        "op11": "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint",
        "op12": "query_id bigint, rank int, vec_id bigint, score bigint",
        "op13": "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string",
    }
    for name, query in __spark_entry__.queries().items():
        if (key := name.split("_")[0]) in want:
            got = dict(query(spark, sf_dir).dtypes)
            assert {c: got[c] for c in (x.split()[0] for x in want[key].split(", "))} == dict(x.split() for x in want[key].split(", ")), name
