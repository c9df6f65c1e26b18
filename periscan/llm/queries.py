"""The registered queries of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from periscan.session import table


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, counted by scanning flat token files for separators."""
    from periscan.llm.separators import document_token_counts
    from periscan.llm.tokenize import vocabulary

    return document_token_counts(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), end_id=50256)


def op2_hypergeometric_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in eight shards of equal row counts, in uniformly random order."""
    from periscan.llm.shards import shuffle_into_shards

    placed = shuffle_into_shards(table(spark, sf_dir, "documents"), 8, seed=20)
    # Of the text that arrived in the shard.
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size")
    crc = F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32")
    return placed.select("doc_id", size, crc, F.lit("rows").alias("law"), F.col("shard").cast("int"), F.col("slot").cast("long"), F.lit(None).cast("int").alias("grown_shard"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licence of every document, its own or inherited.

    ``documents`` has no paths, so this lays them out as a tree: below the source, below
    a directory for each 10,000 ids, below one for each 500; ids divisible by 10
    lie one level higher, and those divisible by 100 two.
    """
    from periscan.llm.licenses import scan

    i = F.col("doc_id")
    high, low = F.floor(i / 10_000).cast("string"), F.floor(i / 500).cast("string")
    inner = F.when(i % 100 == 0, F.array(i.cast("string"))).when(i % 10 == 0, F.array(high, i.cast("string"))).otherwise(F.array(high, low, i.cast("string")))
    path = F.concat_ws("/", F.lit(""), F.coalesce("source", F.lit("none")), inner)
    files = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), path.alias("path"), "text")
    return scan(files, first_line_speaks=True).withColumnRenamed("id", "doc_id")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those outside the held-out fold."""
    from periscan.llm.language import fit, fold, identify

    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(fold() != 2))
    named = identify(docs.select("doc_id", "text"), model)
    return named.select("doc_id", (fold() == 2).alias("held_out"), "lang_pred", "score", "margin", "accepted")


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece ids of every document, and whether decoding them gives the text again."""
    from periscan.llm.pieces import encode_checked
    from periscan.llm.tokenize import vocabulary

    coded = encode_checked(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary("piece_bpe_32k.model"))
    return coded.select("doc_id", "n_pieces", "pieces_crc32", "decoded_chars", "same")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark items, verbatim or with other numbers, names or units."""
    from periscan.llm.decontaminate import find_leaks

    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a WARC record, read back from the archive."""
    from periscan.llm.warc import archive_pages, page_records

    return page_records(spark, archive_pages(table(spark, sf_dir, "pages")))


def op8_binary_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a framed record of token ids, read back from the files."""
    from periscan.llm.idfiles import record_digests, write_records
    from periscan.llm.tokenize import vocabulary

    return record_digests(write_records(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), end_id=2))


def op9_forest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of every hundredth, among all others."""
    from periscan.llm.forest import nearest

    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 100 = 0"), k=10)


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of near copies among all documents, on sets of two-word shingles."""
    from periscan.llm.near import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), width=2)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three hard negatives for each of the five first positives of every fiftieth vector."""
    from periscan.llm.negatives import hard_negatives

    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", label), F.col("vec_id") % 50 == 0, positives=5, negatives=3, low=(1, 2), high=(19, 20))


def op12_bit_sliced_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five largest inner products of every fiftieth vector, among all others."""
    from periscan.llm.bitsliced import top_products

    return top_products(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op13_ball_tree_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors around sixteen centroids after three rounds."""
    from periscan.llm.balls import whole_centroids

    return whole_centroids(table(spark, sf_dir, "embeddings"), k=16, rounds=3, d=64)


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_hypergeometric_shards, op3_license_scan, op4_language_id, op5_sentencepiece, op6_decontamination, op7_warc, op8_binary_records, op9_forest_neighbours, op10_minhash_near_dedup, op11_hard_negatives, op12_bit_sliced_search, op13_ball_tree_centroids)}

_WHOLE = "embedding is not null and list_bool_and([x is not null and isfinite(x) for x in embedding]) is distinct from false"


def _integers(scale: int) -> str:
    return f"[floor({scale} * x::double) for x in embedding]"


def _clusters(rounds: int = 3) -> str:
    """Every round as two tables: the nearest centroid of each vector, and the centroids that follow."""
    sql = [
        f"with recursive v as materialized (select vec_id, {_integers(64)} as x from embeddings where vec_id is not null and len(embedding) = 64 and {_WHOLE})",
        "c0 as materialized (select row_number() over (order by sha256('1:' || vec_id), x) - 1 as c, x as m from v qualify row_number() over (order by sha256('1:' || vec_id), x) <= 16)",
    ]
    for r in range(rounds + 1):
        far = "list_sum([(p[1] - p[2]) * (p[1] - p[2]) for p in list_zip(x, m)])"
        sql.append(f"a{r} as materialized (select vec_id, x, arg_min(c, (far, c)) as c, min(far) as far from (select vec_id, x, c, {far} as far from v, c{r}) group by vec_id, x)")
        if r < rounds:
            sums = f"select c, i, floor(sum(x[i]) / count(*)) as y from a{r}, range(1, 65) t(i) group by c, i"
            sql.append(f"c{r + 1} as materialized (select c{r}.c, coalesce(n.m, c{r}.m) as m from c{r} left join (select c, list(y order by i) as m from ({sums}) group by c) n using (c))")
    return ",\n".join(sql) + f"""
        select vec_id, c::int as cluster, far::bigint as distance, (sum(far) over (partition by c))::bigint as cluster_inertia, (sum(far) over ())::bigint as inertia,
               sha256(array_to_string([y::bigint for y in m], ',')) as centroid_sha256
        from a{rounds} join c{rounds} using (c)"""


#: DuckDB SQL for the queries that SQL can express. The others draw from Spark's hashes, learn, or run a tokenizer; tests/llm holds them against brute force.
ORACLES: dict[str, str] = {
    "op7_warc": """
        with sized as (select page_id, strlen(coalesce(html, '')) as n, sha1(coalesce(html, '')) as digest from pages),
        latest as (select *, max(page_id) over (partition by digest) as latest from sized)
        select page_id, n::bigint as payload_bytes, digest as payload_digest,
               case when n >= 1000 and page_id <> latest then 'revisit' else 'response' end as record_type,
               case when n >= 1000 and page_id <> latest then latest end as refers_to
        from latest
    """,
    # All pairs that share a shingle are compared, which suits small scales only.
    "op10_minhash_near_dedup": r"""
        with recursive cut as (
            select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents
        ),
        pairs as (select doc_id, unnest(w[1 : len(w) - 1]) as one, unnest(w[2 : len(w)]) as next from cut where len(w) > 1),
        shingles as (
            select distinct doc_id, one || ' ' || next as shingle from pairs union all select distinct doc_id, w[1] from cut where len(w) = 1
        ),
        sizes as (select doc_id, count(*) as n from shingles group by doc_id),
        common as (
            select a.doc_id as u, b.doc_id as v, count(*) as both_have
            from shingles a join shingles b on a.shingle = b.shingle and a.doc_id < b.doc_id group by 1, 2
        ),
        linked as (
            select u, v from common join sizes a on a.doc_id = u join sizes b on b.doc_id = v where 100 * both_have >= 80 * (a.n + b.n - both_have)
        ),
        edges as (select u, v from linked union all select v, u from linked),
        reached(doc_id, other) as (
            select doc_id, doc_id from documents union select reached.doc_id, edges.v from reached join edges on edges.u = reached.other
        ),
        named as (select doc_id, min(other) as component_id from reached group by doc_id)
        select doc_id, coalesce(n, 0)::bigint as n_shingles, component_id, doc_id = component_id as kept
        from documents left join sizes using (doc_id) left join named using (doc_id)
    """,
    "op11_hard_negatives": f"""
        with v as (
            select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, {_integers(256)} as x
            from embeddings where vec_id is not null and label is not null and {_WHOLE}
        ),
        scored as (
            select a.vec_id as anchor_id, b.vec_id as other, a.label = b.label as same, list_inner_product(a.x, b.x)::bigint as score
            from v a join v b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id
        ),
        positive as (
            select anchor_id, other as positive_id, score as positive_score from scored where same
            qualify row_number() over (partition by anchor_id order by score desc, other) <= 5
        )
        select anchor_id, positive_id, (row_number() over w)::int as rank, other as negative_id, positive_score, score as negative_score
        from positive join scored using (anchor_id)
        where not same and 50 * positive_score <= 100 * score and 100 * score <= 95 * positive_score
        window w as (partition by anchor_id, positive_id order by score desc, other) qualify row_number() over w <= 3
    """,
    "op12_bit_sliced_search": f"""
        with v as (select vec_id, {_integers(256)} as x from embeddings where vec_id is not null and {_WHOLE}),
        scored as (select a.vec_id as query_id, b.vec_id, list_inner_product(a.x, b.x)::bigint as score from v a join v b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id)
        select query_id, (row_number() over w)::int as rank, vec_id, score from scored
        window w as (partition by query_id order by score desc, vec_id) qualify row_number() over w <= 5
    """,
    "op13_ball_tree_centroids": _clusters(),
}
